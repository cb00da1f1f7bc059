from datetime import date

import pytest

from gaugeworks.model import Entity, Filter, Join, Metric, Model, ModelError, Request
from gaugeworks.operators import checks, monitor
from gaugeworks.plans.compare import compare, earlier
from gaugeworks.plans.compiler import answer
from gaugeworks.plans.cube import run


@pytest.fixture(scope="module")
def tables(spark):
    frames = {
        "arr_snapshots": spark.createDataFrame(
            [("2026-07-31", "a", 1, 100), ("2026-07-31", "b", 2, 50), ("2026-08-31", "a", 1, 110), ("2026-08-31", "b", 2, 60),
             ("2026-09-30", "a", 1, 120), ("2026-09-30", "b", 2, 70), ("2026-09-30", "b", 3, 5), ("2026-10-31", "a", 1, 999)],
            "snapshot_date string, plan string, customer_id int, arr int",
        ).selectExpr("cast(snapshot_date as date) as snapshot_date", "plan", "customer_id", "arr"),
        "daily_sales": spark.createDataFrame(
            [("2026-09-01", "a", 10), ("2026-09-02", "a", 20), ("2026-09-03", "a", 5), ("2026-09-01", "b", 7), ("2026-10-01", "a", 1)],
            "day string, rep_id string, amount int",
        ).selectExpr("cast(day as date) as day", "rep_id", "substr(day, 1, 7) as month", "amount"),
        "quotas": spark.createDataFrame([("a", "2026-09", 100), ("b", "2026-09", 50), ("a", "2026-10", 120)], "rep_id string, month string, quota int"),
    }
    sales = frames["daily_sales"].join(frames["quotas"], ["rep_id", "month"])
    return (frames | {"sales_with_quota": sales}).__getitem__


MODEL = Model(
    {
        "arr": Entity(
            "arr_snapshots", {"snapshot_date": "snapshot_date", "plan": "plan", "customer_id": "customer_id"}, clock="snapshot_date",
            metrics={"arr": Metric("sum", "arr", level=True), "customers": Metric("count_distinct", "customer_id", level=True), "bookings": Metric("sum", "arr"),
                     "opening": Metric("sum", "arr", level=True, snapshot="first")},
        ),
        "sales": Entity(
            "sales_with_quota", {"day": "day", "rep_id": "rep_id", "month": "month", "amount": "amount"}, clock="day",
            metrics={"sales": Metric("sum", "amount"), "quota": Metric("sum_distinct_on", "quota", keys=("rep_id", "month")),
                     "attained": Metric("ratio", num="sales", den="quota"), "loop": Metric("derived", formula="{loop} + 1")},
            joins=(Join("quotas", (("rep_id", "rep_id"),), "one_to_many"),),
        ),
        "quotas": Entity("quotas", {"rep_id": "rep_id", "quota_month": "month"}, metrics={"plans": Metric("count")}),
    }
)
Q3 = ("2026-07-01", "2026-10-01")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_level_is_read_at_the_last_snapshot_of_the_window(tables):
    assert rows(answer(MODEL, tables, Request(metrics=("arr", "customers"), window=Q3))) == [(195, 3)]
    assert rows(answer(MODEL, tables, Request(metrics=("arr",)))) == [(999,)]
    assert rows(answer(MODEL, tables, Request(metrics=("opening",), window=Q3))) == [(150,)]


def test_level_by_bucket_is_read_in_each(tables):
    got = rows(answer(MODEL, tables, Request(metrics=("arr",), grain="month", window=Q3)))
    assert got == [(date(2026, 7, 1), 150), (date(2026, 8, 1), 170), (date(2026, 9, 1), 195)]


def test_filters_do_not_move_the_snapshot(tables):
    assert rows(answer(MODEL, tables, Request(metrics=("arr",), filters=(Filter("plan", "=", "b"),)))) == [(None,)]


def test_level_beside_flow_is_refused(tables):
    with pytest.raises(ModelError):
        answer(MODEL, tables, Request(metrics=("arr", "bookings")))


def test_sum_distinct_on_counts_each_key_once_in_each_group(tables):
    assert rows(answer(MODEL, tables, Request(metrics=("quota", "sales")))) == [(270, 43)]
    assert rows(answer(MODEL, tables, Request(metrics=("quota",), dimensions=("sales.rep_id",)))) == [("a", 220), ("b", 50)]
    assert rows(answer(MODEL, tables, Request(metrics=("quota",), dimensions=("month",)))) == [("2026-09", 150), ("2026-10", 120)]


def test_unsafe_or_unknown_requests_are_refused(tables):
    for request in (
        Request(metrics=("sales",), dimensions=("quota_month",)),
        Request(metrics=("loop",)),
        Request(metrics=("nothing",)),
        Request(metrics=("sales", "plans")),
        Request(metrics=("plans",), grain="month"),
        Request(),
    ):
        with pytest.raises(ModelError):
            answer(MODEL, tables, request)


def test_comparison_keeps_groups_of_either_window(tables):
    got = rows(compare(MODEL, tables, Request(metrics=("sales",), dimensions=("sales.rep_id",), window=("2026-10-01", "2026-11-01")), "previous_period"))
    assert got == [("a", 1, 35, -34, -34 / 35), ("b", None, 7, None, None)]


def test_windows_of_comparisons():
    assert earlier(Q3, "previous_period")[0] == ("2026-04-01", "2026-07-01")
    assert earlier(("2026-03-03", "2026-03-10"), "previous_period")[0] == ("2026-02-24", "2026-03-03")
    assert earlier(Q3, "previous_year", "week")[0] == ("2025-07-02", "2025-10-02")
    with pytest.raises(ModelError):
        earlier(("2026-03-03", "2026-03-10"), "previous_period", "month")


def test_cube_query_limits_and_orders(tables):
    query = {"measures": ["sales.sales"], "dimensions": ["sales.rep_id"], "order": {"sales.sales": "desc"}, "limit": 1}
    assert rows(run(MODEL, tables, query)) == [("a", 36)]


@pytest.mark.parametrize(
    "more",
    [
        {"renewQuery": True},
        {"segments": ["sales.big"]},
        {"ungrouped": True},
        {"timeDimensions": [{"dimension": "sales.day", "dateRange": "some day"}]},
        {"timeDimensions": [{"dimension": "sales.day", "zone": "UTC"}]},
    ],
)
def test_cube_query_refuses_what_it_does_not_know(tables, more):
    with pytest.raises(ModelError):
        run(MODEL, tables, {"measures": ["sales.sales"], "dimensions": ["sales.rep_id"]} | more)


def test_cube_query_compares_ranges(tables):
    time = {"dimension": "sales.day", "compareDateRange": [["2026-09-01", "2026-09-30"], ["2026-10-01", "2026-10-31"]]}
    query = {"measures": ["sales.sales"], "dimensions": ["sales.rep_id"], "timeDimensions": [time]}
    first, second = "2026-09-01 - 2026-09-30", "2026-10-01 - 2026-10-31"
    assert rows(run(MODEL, tables, query)) == [("a", 1, second), ("a", 35, first), ("b", 7, first)]


def test_partial_months(spark):
    def flagged(values):
        df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "month int, v double")
        return [r.month for r in monitor.partial_periods(df, "month", "v").where("partial").collect()]

    assert flagged([100] * 15 + [30]) == [15]
    assert flagged([100] * 3 + [30]) == []
    assert flagged([5] * 15 + [0]) == []
    assert flagged([100] * 11 + [30] + [100] * 11 + [30]) == [11]


def test_result_equality_and_ties(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1.0)], "k int, v double")
    b = spark.createDataFrame([(2, 1.0), (1, 0.3)], "k int, v double")
    assert checks.same_rows(a, b) and not checks.same_rows(a, b.limit(1))
    c = spark.createDataFrame([(k, n) for k, n in enumerate([5, 4, 4, 1])], "k int, n int")
    assert sorted(r.n for r in checks.top_with_ties(c, "n", 2).collect()) == [4, 4, 5]


def test_feed_counts_on_a_stream(spark, tmp_path):
    from gaugeworks.streaming.feeds import feed_counts

    events = spark.createDataFrame([("2026-01-01 10:00:00", "web"), ("2026-01-01 11:00:00", "web"), ("2026-01-02 09:00:00", "shop")], "ts string, feed string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = feed_counts(stream, "ts", ["feed"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r.feed, r["rows"]) for r in spark.table("counts").collect()) == [("shop", 1), ("web", 2)]
