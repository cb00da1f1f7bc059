from gaugeworks.model import Filter, Request
from gaugeworks.plans.prechecks import pre_checks
from gaugeworks.shop import MODEL


def checks(**asked):
    return [c for c, _ in pre_checks(MODEL, Request(**asked))]


def test_all_reasons_come_in_order():
    asked = {"metrics": ("orders", "profit"), "dimensions": ("colour", "return_flag"), "definitions": ("tiny",), "window": ("1997-01-01", "1996-01-01")}
    assert checks(**asked) == ["declared", "declared", "definitions", "paths", "window"]
    assert checks(metrics=("orders", "parts"), filters=(Filter("status", "=", "F"),)) == ["one_base"]
    assert checks(window=("soon", "later"), metrics=("orders",)) == ["window"]


def test_the_compiler_has_the_last_word():
    assert checks(metrics=("orders", "last_day_revenue")) == ["plan"]
    assert checks(metrics=("segment_revenue",)) == ["plan"] and checks() == ["plan"]
    assert checks(metrics=("orders",), dimensions=("segment",), definitions=("large",), window=("1996-01-01", "1997-01-01")) == []
    assert checks(dimensions=("status", "priority")) == checks(metrics=("segment_revenue",), dimensions=("segment",)) == []
