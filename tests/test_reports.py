import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import grading, ledger, profiling
from gaugeworks.report_queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", dt.date(2024, 1, 1), dt.date(2024, 1, 3)), (None, None, dt.date(2024, 1, 2), dt.date(2024, 1, 3)), (3, "a", None, None)],
        "n int, s string, d date, seen date",
    )
    got = {r["column"]: r.asDict() for r in profiling.column_stats(df, ["n", "s", "d"], shape_only=("n",), clock="seen").collect()}
    assert got["n"]["null_rate"] == 0.333333 and got["n"]["least"] is None and got["n"]["values"] == 2
    assert got["s"]["few_values"] and got["s"]["first_day"] is None
    assert got["d"]["offset_days"] == 1.5 and got["d"]["last_day"] == dt.date(2024, 1, 2)
    empty = profiling.column_stats(df.limit(0), ["n"]).collect()[0]
    assert (empty["rows"], empty["null_rate"], empty["exact"]) == (0, None, True)


def test_sampled_profile_says_so(spark):
    row = profiling.column_stats(spark.range(100_000), ["id"], rows=2_000_000).collect()[0]
    assert not row["exact"] and 0 < row["rows"] <= profiling.SAMPLE_ROWS


def test_registered_profile_reads_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(profiling, "EXACT_ROWS", 10)
    got = QUERIES["profile_column_stats"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert n > 10 and all(r["exact"] and r["rows"] == n for r in got)


def test_shapes(spark):
    df = spark.createDataFrame([("1.5", "2024-01", "[1]", "1,2", None), ("-2", "2024-02-03", "[]", "(3, 4)", "x")], "a string, b string, c string, d string, e string")
    got = {r["column"]: r["shape"] for r in profiling.value_shapes(df, list("abcde")).collect()}
    assert got == {"a": "numeric-text", "b": "date-text", "c": "json-array", "d": "point", "e": None}


def test_drift_and_impact(spark):
    old = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int"), ("t", "c", "int")], "table string, column string, type string")
    new = spark.createDataFrame([("t", "a", "int"), ("t", "b", "string"), ("t", "d", "int")], "table string, column string, type string")
    found = profiling.columns_changed(old, new)
    assert rows(found.select("column", "kind")) == [("b", "retyped"), ("c", "dropped"), ("d", "added")]
    read = spark.createDataFrame([("t", "b", "m1"), ("t", "b", "m2"), ("t", "d", "m1")], "table string, column string, asset string")
    assert rows(profiling.impact(found, read).select("column", "breaking")) == [("b", True), ("c", False), ("d", False)]


def test_lineage_closure(spark):
    edges = spark.createDataFrame([("raw", "stg"), ("stg", "a"), ("stg", "b"), ("a", "mart"), ("b", "mart"), ("x", "y")], "source string, target string")
    assert rows(profiling.downstream(edges, "raw")) == [("a",), ("b",), ("mart",), ("stg",)]
    assert rows(profiling.downstream(edges, "mart")) == []


def test_rolling_use_crosses_blocks(spark):
    df = spark.createDataFrame([("u", dt.datetime(2024, 1, 1, 0, 0, s)) for s in (8, 8, 12, 19, 40)] + [("u", None), (None, dt.datetime(2024, 1, 1))], "u string, t timestamp_ntz")
    got = [r["used"] for r in ledger.rolling_use(df, "u", "t", 10, 2).where("u is not null").orderBy("second").collect()]
    assert got == [2, 3, 2, 1]


def test_difference_counts_repeats(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1), (None, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1000000001), (2, 1.0)], "k int, v double")
    assert sorted(((r.k, r.surplus) for r in grading.difference(a, b).collect()), key=repr) == [(1, 1), (2, -1), (None, 1)]


def test_order_statistic_is_not_interpolated(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), "id")
    assert [grading.order_statistic(df, ["g"], "id", q).collect()[0]["band"] for q in (0.0, 0.05, 0.5, 1.0)] == [0, 0, 4, 9]


@pytest.mark.parametrize("second, routed", [([0.0, 1.0], True), ([0.9, 0.436], False)])
def test_route_needs_a_margin(spark, second, routed):
    df = spark.createDataFrame([("a", [0.9, 0.436]), ("b", second), ("c", [0.0, 0.0])], "lens string, v array<double>")
    got = {r["lens"]: r["routed"] for r in grading.route(df, "lens", "v", [1.0, 0.0]).collect()}
    assert got["a"] is routed and "c" not in got


def test_contaminated_ignores_case_and_marks(spark):
    held = spark.createDataFrame([(1, "How many Orders?"), (2, "other"), (3, None)], "id int, q string")
    known = spark.createDataFrame([(9, "how many - orders")], "id int, q string")
    assert rows(grading.contaminated(held, known, "q").select("id")) == [(1,)]
