"""Registered queries of the metrics engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.model import Filter, Request
from gaugeworks.operators import checks, monitor
from gaugeworks.plans.compare import compare
from gaugeworks.plans.compiler import answer
from gaugeworks.plans.cube import run
from gaugeworks.shop import MODEL
from gaugeworks.sources.tables import folder
from gaugeworks.streaming.feeds import feed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared with another engine's."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _plain(build(folder(spark, sf_dir)))
    SQL[name] = sql


def _ask(name: str, request: Request, sql: str) -> None:
    _add(name, lambda t: answer(MODEL, t, request), sql)


_L = "SELECT {} FROM lineitem"
_D = "CAST({} AS DECIMAL(18, 2))"
_GROSS, _UNITS = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE)", "CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE)"
_NET = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE)"
_REV = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)"

_ask(
    "metric_by_dimensions",
    Request(metrics=("units", "gross", "net", "lines"), dimensions=("return_flag", "line_status")),
    f"SELECT l_returnflag AS return_flag, l_linestatus AS line_status, {_UNITS} AS units, {_GROSS} AS gross, {_NET} AS net, count(*) AS lines FROM lineitem GROUP BY 1, 2",
)
_ask(
    "metric_total_empty_window",
    Request(metrics=("units", "lines"), window=("1900-01-01", "1900-02-01")),
    f"SELECT {_UNITS} AS units, count(*) AS lines FROM lineitem WHERE l_shipdate < DATE '1900-02-01'",
)
_ask(
    "metric_over_join_path",
    Request(metrics=("revenue", "orders", "buyers"), dimensions=("region", "segment"), filters=(Filter("status", "in", ["O", "F"]),)),
    f"""SELECT r_name AS region, c_mktsegment AS segment, {_REV} AS revenue, count(*) AS orders, count(DISTINCT o_custkey) AS buyers
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2""",
)
_ask(
    "metric_time_bucket_window",
    Request(metrics=("gross", "orders_shipped"), grain="month", window=("1995-01-01", "1996-01-01")),
    f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS shipped_month, {_GROSS} AS gross, count(DISTINCT l_orderkey) AS orders_shipped
    FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01' GROUP BY 1""",
)
_ask(
    "metric_ratio_and_derived",
    Request(metrics=("return_rate", "discounted", "price_per_unit"), dimensions=("brand",)),
    f"""SELECT p_brand AS brand, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18, 2)) END) AS DOUBLE) / nullif({_UNITS}, 0) AS return_rate,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) - sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS discounted,
    {_GROSS} / nullif({_UNITS}, 0) AS price_per_unit FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
_ask(
    "metric_sum_distinct_on",
    Request(metrics=("order_lines_once", "lines"), dimensions=("return_flag",)),
    """SELECT return_flag, CAST(sum(CASE WHEN n = 1 THEN v END) AS BIGINT) AS order_lines_once, count(*) AS lines FROM (
    SELECT l_returnflag AS return_flag, l_linenumber AS v, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber NULLS LAST) AS n
    FROM lineitem) GROUP BY 1""",
)
_ask(
    "metric_level_last_snapshot",
    Request(metrics=("last_day_revenue",), dimensions=("priority",), window=("1996-01-01", "1997-01-01")),
    f"""SELECT o_orderpriority AS priority, {_REV} AS last_day_revenue FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders
    WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01') GROUP BY 1""",
)
_ask(
    "metric_level_first_by_month",
    Request(metrics=("first_day_revenue",), grain="month", window=("1995-01-01", "1996-01-01")),
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ordered_month, {_REV} AS first_day_revenue FROM orders JOIN (
    SELECT date_trunc('month', o_orderdate) AS m, min(o_orderdate) AS d FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' GROUP BY 1)
    ON o_orderdate = d GROUP BY 1""",
)
_ask(
    "metric_population_bound",
    Request(metrics=("events", "users", "purchase_share"), dimensions=("event",), grain="day"),
    """SELECT CAST(date_trunc('day', ts) AS DATE) AS at_day, event_type AS event, count(*) AS events, count(DISTINCT user_id) AS users,
    CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) / nullif(count(*), 0) AS purchase_share
    FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2""",
)
_ask(
    "metric_pinned_dimension",
    Request(metrics=("segment_revenue",), dimensions=("status",), filters=(Filter("segment", "=", "BUILDING"),)),
    f"SELECT o_orderstatus AS status, {_REV} AS segment_revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
)
_ask(
    "metric_ranked_top",
    Request(metrics=("balance_total", "customers"), dimensions=("nation",), order=(("balance_total", "desc"), ("nation", "asc")), limit=10),
    """SELECT n_name AS nation, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance_total, count(*) AS customers
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY balance_total DESC NULLS LAST, nation LIMIT 10""",
)
_ask(
    "metric_extremes",
    Request(metrics=("parts", "largest", "mean_size"), dimensions=("part_type",), filters=(Filter("brand", "like", "Brand#1%"),)),
    "SELECT p_type AS part_type, count(*) AS parts, max(p_size) AS largest, avg(p_size) AS mean_size FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1",
)
_ask(
    "listing_of_fields",
    Request(fields=("orders.order_id", "customer", "nation"), filters=(Filter("ordered", "=", "1995-03-15"),)),
    """SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15'""",
)

_COMPARED = """WITH a AS (SELECT {key} AS k, {value} AS v FROM {table} WHERE {clock} >= DATE '{a}' AND {clock} < DATE '{b}' GROUP BY 1),
c AS (SELECT {key2} AS k, {value} AS v FROM {table} WHERE {clock} >= DATE '{c}' AND {clock} < DATE '{d}' GROUP BY 1)
SELECT coalesce(a.k, c.k) AS {name}, CAST(a.v AS DOUBLE) AS {m}, CAST(c.v AS DOUBLE) AS {m}_compare, CAST(a.v - c.v AS DOUBLE) AS {m}_delta,
CAST(a.v - c.v AS DOUBLE) / nullif(abs(CAST(c.v AS DOUBLE)), 0) AS {m}_delta_pct FROM a FULL JOIN c ON a.k IS NOT DISTINCT FROM c.k"""
_MONEY = "sum(CAST(o_totalprice AS DECIMAL(18, 2)))"
_YEAR = {"table": "orders", "clock": "o_orderdate", "value": _MONEY, "m": "revenue", "a": "1996-01-01", "b": "1997-01-01"}
_add(
    "compare_previous_period",
    lambda t: compare(MODEL, t, Request(metrics=("revenue",), dimensions=("priority",), window=("1996-01-01", "1997-01-01")), "previous_period"),
    _COMPARED.format(key="o_orderpriority", key2="o_orderpriority", name="priority", c="1995-01-01", d="1996-01-01", **_YEAR),
)
_add(
    "compare_previous_year_by_month",
    lambda t: compare(MODEL, t, Request(metrics=("revenue",), grain="month", window=("1996-01-01", "1997-01-01")), "previous_year"),
    _COMPARED.format(
        key="CAST(date_trunc('month', o_orderdate) AS DATE)", key2="CAST(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH AS DATE)",
        name="ordered_month", c="1995-01-01", d="1996-01-01", **_YEAR,
    ),
)
_CUBE = {
    "measures": ["orders.revenue", "orders.orders"],
    "dimensions": ["orders.status"],
    "timeDimensions": [{"dimension": "orders.ordered", "granularity": "quarter", "dateRange": ["1995-01-01", "1995-12-31"]}],
    "filters": [
        {"member": "customers.segment", "operator": "notEquals", "values": ["MACHINERY"]},
        {"or": [{"member": "orders.priority", "operator": "contains", "values": ["urgent"]}, {"member": "orders.total", "operator": "gte", "values": ["100000"]}]},
    ],
    "order": {"orders.revenue": "desc"},
}
_add(
    "cube_query",
    lambda t: run(MODEL, t, _CUBE),
    f"""SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ordered_quarter, o_orderstatus AS status, {_REV} AS revenue, count(*) AS orders
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'
    AND (c_mktsegment IS NULL OR c_mktsegment <> 'MACHINERY') AND (contains(lower(o_orderpriority), 'urgent') OR o_totalprice >= 100000) GROUP BY 1, 2""",
)
_add(
    "check_grain",
    lambda t: checks.grain(t("lineitem"), ["l_orderkey", "l_linenumber"]),
    """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS keys,
    count(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 1 END) AS rows_without_key FROM lineitem""",
)
_add(
    "check_cardinality",
    lambda t: checks.cardinality(t("lineitem"), t("orders"), [("l_orderkey", "o_orderkey")]),
    """SELECT l AS left_most, r AS right_most, CASE WHEN l > 1 THEN 'many' ELSE 'one' END || '_to_' || CASE WHEN r > 1 THEN 'many' ELSE 'one' END AS relationship
    FROM (SELECT max(n) AS l FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)),
    (SELECT max(n) AS r FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey))""",
)
_add(
    "check_containment",
    lambda t: checks.containment(t("orders"), "o_custkey", t("customer"), "c_custkey"),
    """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL)
    SELECT count(*) AS child_keys, count(CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 1 END) AS contained,
    (SELECT CAST(count(DISTINCT c_custkey) AS DOUBLE) / count(c_custkey) FROM customer) AS parent_uniqueness,
    CAST(count(CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 1 END) AS DOUBLE) / count(*) AS overlap FROM k""",
)
_add(
    "check_join_conservation",
    lambda t: checks.conservation(t("lineitem"), t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey"), "left")),
    """SELECT (SELECT count(*) FROM lineitem) AS base_rows, (SELECT count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) AS joined_rows""",
)
_add(
    "check_drift",
    lambda t: checks.drift(
        t("orders").where("year(o_orderdate) = 1995").groupBy("o_custkey").agg(F.count("*").alias("n")),
        t("orders").where("year(o_orderdate) = 1996").groupBy("o_custkey").agg(F.count("*").alias("n")), ["o_custkey"], "n", 0.5,
    ),
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS o_custkey, a.n AS was, b.n AS now, CASE WHEN a.k IS NULL THEN 'appeared' WHEN b.k IS NULL THEN 'vanished' ELSE 'changed' END AS kind
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(b.n - a.n) > 0.5 * a.n""",
)
_add(
    "rank_with_ties",
    lambda t: checks.top_with_ties(t("part").groupBy("p_size").agg(F.count("*").alias("n")), "n", 5),
    "SELECT p_size, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)) WHERE r <= 5",
)
_add(
    "latest_per_key",
    lambda t: checks.latest_per_key(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], F.struct("ts", "event_id")),
    """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
_add(
    "profile_columns",
    lambda t: checks.profile(t("part"), ["p_brand", "p_size"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(CASE WHEN {c} IS NULL THEN 1 END) AS nulls, count(DISTINCT {c}) AS "values",
        CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most FROM part"""
        for c in ("p_brand", "p_size")
    ),
)
_add(
    "value_dictionary",
    lambda t: checks.value_dictionary(t("lineitem"), ["l_returnflag", "l_linenumber", "l_shipdate"], 25).drop("nth"),
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 25)"""
        if c == "l_shipdate"
        else f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 25)"""
        for c in ("l_returnflag", "l_linenumber", "l_shipdate")
    ),
)
_add(
    "monitor_data_ends",
    lambda t: monitor.data_ends(t("events"), "ts", ["event_type"]),
    """SELECT event_type, count(*) AS rows, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, (SELECT CAST(max(ts) AS DATE) FROM events) AS data_end FROM events GROUP BY 1""",
)
_add(
    "monitor_partial_periods",
    lambda t: monitor.partial_periods(monitor.monthly(t("lineitem"), "l_shipdate", ["l_returnflag"]), "month", "value", ["l_returnflag"], "1998-08-15")
    .select("month", "l_returnflag", F.col("value").alias("n"), "trailing_median", "history", "partial"),
    """WITH g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l_returnflag, CAST(unnest(generate_series(min(month), (SELECT max(month) FROM g), INTERVAL 1 MONTH)) AS DATE) AS month FROM g GROUP BY 1),
    m AS (SELECT month, l_returnflag, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (l_returnflag, month)),
    a AS (SELECT *, min(n) OVER (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low,
      least(1.0, greatest(0, DATE '1998-08-15' - month + 1) / CAST(day(last_day(month)) AS DOUBLE)) AS part, median(n) OVER w AS trailing_median, count(n) OVER w AS history, lag(n, 12) OVER (PARTITION BY l_returnflag ORDER BY month) AS y
      FROM m WINDOW w AS (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, lag(trailing_median, 12) OVER (PARTITION BY l_returnflag ORDER BY month) AS ym FROM a)
    SELECT month, l_returnflag, n, trailing_median, history, coalesce(n < 0.7 * trailing_median * part AND n < low AND history >= 6 AND trailing_median >= 20
      AND NOT coalesce(y < 0.7 * ym, false), false) AS partial FROM b""",
)
_add(
    "feed_counts",
    lambda t: feed_counts(t("events"), "ts", ["event_type"]).select(F.col("window_start").cast("date").alias("day"), "event_type", "rows"),
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS rows FROM events GROUP BY 1, 2",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["metric_over_join_path"](spark, sf_dir)
