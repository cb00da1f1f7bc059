import datetime as dt

import pytest

from gaugeworks.model import ModelError, Request
from gaugeworks.operators import evidence
from gaugeworks.plans.doors import variants


def test_a_zero_is_told_from_a_value(spark):
    zero = lambda rows: evidence.zero_evidence(spark.createDataFrame(rows, "n long, v double"), ["n"], ["v"]).first()["zero"]
    assert zero([(0, None)]) and zero([])
    assert not zero([(0, 0.0)]) and not zero([(1, None)]) and not zero([(0, None), (0, None)]) and not zero([(None, None)])


def test_literals_of_listed_columns_only(spark):
    df = spark.createDataFrame([(str(k % 3), str(k), None) for k in range(40)], "a string, b string, c string")
    got = {r["column"]: r for r in evidence.literal_probe(df, {"a": ["1", "7", "0"], "b": ["1"], "c": ["x"]}).collect()}
    assert (got["a"]["values"], got["a"]["missing"], got["a"]["status"]) == (["0", "1", "2"], ["7"], "missing")
    assert got["b"]["status"] == got["c"]["status"] == "unresolved" and got["b"]["missing"] is None
    assert evidence.literal_probe(df.limit(0), {"a": ["1"]}).first()["status"] == "unresolved"


def test_creation_dated_needs_one_unique_column(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 2)], "a int, b int, c int")
    told = lambda d, key: evidence.creation_dated(d, key).first()["creation_dated"]
    assert told(df, ["b", "a"]) and not told(df, ["b", "c"]) and not told(df.limit(0), ["a"])


def test_latest_readings(spark):
    days = [dt.date(2024, 1, 5), dt.date(2024, 1, 9), dt.date(2024, 2, 1), None]
    df = spark.createDataFrame([(g, d, n) for g in ("x", None) for n, d in enumerate(days)], "g string, d date, n int")
    assert sorted((r.g or "", r.n) for r in evidence.latest_readings(df, ["g"], "d").collect()) == [("", 2), ("x", 2)]
    monthly = evidence.latest_readings(df.where("g = 'x'"), ["g"], "d", "month").collect()
    assert sorted((r.bucket.month, r.n) for r in monthly) == [(1, 1), (2, 2)]


def test_gaps_by_feed_and_window(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 3, 31)), ("b", dt.date(2024, 2, 10)), ("c", None)], "f string, d date")
    rows = evidence.measure_gaps(df, "d", ["f"], {"all": {}, "own": {"f": ["b"]}, "none": {"f": ["z"]}}, [("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-04-01")]).collect()
    got = {(r.measure, r.start.month): (r.feeds, r.ending_inside, r.ending_before, r.loaded) for r in rows}
    assert got == {("all", 2): (3, 1, 1, True), ("all", 3): (3, 0, 2, True), ("own", 2): (1, 1, 0, True), ("own", 3): (1, 0, 1, False)}


def test_variants_are_all_combinations():
    got = variants(Request(metrics=("orders",)), {"grain": ["month", "year"], "limit": [5, None]})
    assert [r.grain for _, r in got] == ["month", "month", "year", "year"] and [r.limit for _, r in got] == [5, None, 5, None]
    assert got[0][0] == {"grain": "month", "limit": 5} and variants(Request(), {}) == [({}, Request())]
    with pytest.raises(ModelError):
        variants(Request(), {"colour": ["red"]})
