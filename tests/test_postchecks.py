import datetime as dt

from gaugeworks.model import Entity, Metric, Model, Request
from gaugeworks.plans.postchecks import post_checks

MODEL = Model({"calls": Entity(table="calls", members={"at": "d", "who": "w", "line": "l"}, clock="at", metrics={"calls": Metric("count"), "sum": Metric("sum", "n")})})


def verdicts(spark, request, rows):
    df = spark.createDataFrame(rows, "d date, w string, l string, n int")
    got = post_checks(MODEL, lambda _: df, request).orderBy("nth").collect()
    assert [r.check for r in got] == ["empty_result", "window", "null_bucket", "tie_at_limit"]
    return [(r.verdict, r.detail) for r in got]


def test_checks_of_a_ranking(spark):
    day = dt.date(2024, 3, 10)
    rows = [(day, "a", "x", 1), (day, "b", "x", 1), (day, None, "x", 1), (day, None, "y", 1), (day, "c", "x", 1)]
    ranked = Request(metrics=("calls",), dimensions=("who",), order=(("calls", "desc"),), limit=2, window=("2024-03-01", "2024-04-01"))
    assert verdicts(spark, ranked, rows) == [("ok", 4), ("partly", 21), ("nameless", 1), ("tied", 2)]
    plain = Request(metrics=("calls",), dimensions=("who",), window=("2024-03-01", "2024-03-11"))
    assert verdicts(spark, plain, rows) == [("ok", 4), ("ok", 0), ("ok", 0), ("ok", 0)]


def test_checks_of_a_window_without_data(spark):
    late = Request(metrics=("calls",), dimensions=("who",), window=("2025-01-01", "2025-01-31"))
    assert verdicts(spark, late, [(dt.date(2024, 3, 10), "a", "x", 1)])[:2] == [("empty", 0), ("unloaded", 30)]
    assert verdicts(spark, late, [])[:2] == [("empty", 0), ("unloaded", 30)]
    assert verdicts(spark, Request(metrics=("calls",), dimensions=("who",), order=(("calls", "desc"),), limit=3), []) == [("empty", 0), ("ok", 0), ("ok", 0), ("ok", 0)]
