from datetime import datetime, timezone

import pytest

from gaugeworks.model import Entity, Filter, Join, Metric, Model, ModelError, Request
from gaugeworks.plans.compiler import answer
from gaugeworks.plans.cube import cube_of, request_of
from gaugeworks.plans.readings import clipped, readings, time_kind


def model(**more):
    return Model({"matches": Entity(table="m", members={"at": "at", "id": "id", "name": "name"}, clock="at", metrics={"n": Metric("count"), "top": Metric("max", "id")}, **more)}, timezone="Europe/Paris")


@pytest.fixture(scope="module")
def rows(spark):
    of = lambda *x: datetime(*x, tzinfo=timezone.utc)
    given = [(1, of(2026, 7, 31, 21, 30), "a"), (2, of(2026, 7, 31, 22, 30), "a"), (3, of(2026, 8, 31, 21, 59), "b"), (4, of(2026, 8, 31, 22, 0), None)]
    df = spark.createDataFrame(given, "id int, at timestamp, name string")
    return lambda _: df


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_windows_and_buckets_lie_in_the_zone_of_the_model(spark, rows, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        n = lambda **r: [tuple(x) for x in answer(model(), rows, Request(metrics=("n",), **r)).collect()]
        assert n(window=("2026-08-01", "2026-09-01")) == [(2,)]
        assert n(filters=(Filter("at", "<=", "2026-08-31"),)) == [(3,)]
        assert n(filters=(Filter("at", "=", "2026-08-31"),)) == n(filters=(Filter("at", "inDateRange", ["2026-08-31", "2026-08-31"]),)) == [(1,)]
        assert n(filters=(Filter("at", ">=", "2026-09-01 00:00"),)) == [(1,)]
        assert sorted((str(d), c) for d, c in n(grain="month")) == [("2026-07-01", 1), ("2026-08-01", 2), ("2026-09-01", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_label_groups_by_its_key(rows):
    ask = Request(metrics=("n",), dimensions=("name",))
    assert sorted(str(tuple(r)) for r in answer(model(), rows, ask).collect()) == ["('a', 2)", "('b', 1)", "(None, 1)"]
    split = answer(model(labels={"name": "id"}), rows, ask)
    assert split.columns == ["name", "n"] and sorted(str(r["name"]) for r in split.collect()) == ["None", "a", "a", "b"]


def test_requests_become_cube_queries_and_come_back():
    for ask in (
        Request(metrics=("n",), dimensions=("name",), order=(("n", "desc"),), limit=3, offset=1),
        Request(fields=("id", "name"), filters=(Filter("name", "set"),)),
        Request(metrics=("n",), grain="month", filters=(Filter("name", "contains", ["a", "b"]),), definitions=("x",)),
    ):
        back = request_of(cube_of(ask, "at"))
        assert [(f.member, f.op, f.value) for f in back.filters] == [(f.member, f.op, f.value) for f in ask.filters]
        assert (back.metrics, back.dimensions, back.fields, back.grain, back.order, back.limit, back.offset, back.definitions) == (
            ask.metrics, ask.dimensions, ask.fields, ask.grain, ask.order, ask.limit, ask.offset, ask.definitions
        )
    assert request_of(cube_of(Request(metrics=("n",), window=("2026-01-01", "2027-01-01")), "at"), model()).window == ("2026-01-01", "2027-01-01")
    assert cube_of(Request(metrics=("n",), filters=(Filter("name", "!=", "a"),)))["filters"] == [{"member": "name", "operator": "notEquals", "values": ["a", None]}]
    for bad in (Request(metrics=("n",), window=("2026-01-01", "2027-01-01 12:00:00")), Request(fields=("id",), dimensions=("name",))):
        with pytest.raises(ModelError):
            cube_of(bad, "at")
    with pytest.raises(ModelError):
        cube_of(Request(metrics=("n",), grain="day"))


def test_kinds_of_clocks_and_clipped_windows(rows):
    df = rows("m")
    assert time_kind(df.withColumnRenamed("at", "paid_at"), "paid_at", "2026-08-01") == "event"
    assert time_kind(df.withColumnRenamed("at", "due_date"), "due_date", "2026-12-01") == "schedule"
    assert time_kind(df, "at", "2026-08-01") == "schedule" and time_kind(df, "at", "2026-12-01") == "event"
    assert time_kind(df, "at", "2026-08-01", about="the day it was paid") == "event" and time_kind(df, "at", "2026-08-01", "event") == "event"
    assert time_kind(df, "at", "2026-08-01", about="paid or due") == "schedule"
    year = Request(metrics=("n",), window=("2026-01-01", "2027-01-01"))
    clip = lambda today, **k: clipped(model(), rows, year, today, **k).window[1]
    assert clip("2026-08-15", declared="event") == "2026-08-16" and clip("2026-08-15", declared="schedule") == "2027-01-01"
    assert clip("2026-12-01", declared="event") == "2027-01-01"
    with pytest.raises(ModelError):
        clip("2026-08-15", declared="other")


def test_readings_count_the_groups_that_differ(rows):
    by = {"all": Request(metrics=("n",), dimensions=("name",)), "named": Request(metrics=("n",), dimensions=("name",), filters=(Filter("name", "set"),)), "same": Request(metrics=("n",), dimensions=("name",), filters=(Filter("id", ">", 0),))}
    got = {r.reading: (r.groups, r.differing, r.alike) for r in readings(model(), rows, by, "all").collect()}
    assert got == {"named": (3, 1, False), "same": (3, 0, True)}
    totals = {"a": Request(metrics=("n",)), "b": Request(metrics=("top",))}
    assert readings(model(), rows, totals, "a").first().alike
    for bad, default in ((by | totals, "all"), (totals, "c")):
        with pytest.raises(ModelError):
            readings(model(), rows, bad, default)


@pytest.mark.parametrize("how, want", [("left", [("y", 2)]), ("inner", [("x", 1)])])
def test_joins_that_drop_rows_move_the_snapshot(spark, how, want):
    made = {
        "stock": spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], "k string, d string, n int"),
        "names": spark.createDataFrame([("a", "x")] + ([("b", "y")] if how == "left" else []), "k string, name string"),
    }
    stock = Entity("stock", {"k": "k", "at": "to_date(d)"}, {"held": Metric("sum", "n", level=True)}, (Join("names", (("k", "k"),), "many_to_one", how),), clock="at")
    given = Model({"stock": stock, "names": Entity("names", {"k": "k", "name": "name"})})
    frame = answer(given, made.get, Request(metrics=("held",), dimensions=("name",)))
    assert [tuple(r) for r in frame.collect()] == want
