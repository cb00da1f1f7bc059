"""Registered queries of results, definitions, roles, cube options and feed checks, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gaugeworks.model import Entity, Filter, Metric, Model, Request
from gaugeworks.operators import checks, evidence, grading, monitor, profiling, results
from gaugeworks.plans.compare import compare
from gaugeworks.plans.compiler import answer
from gaugeworks.plans.cube import cube_of, run
from gaugeworks.plans.postchecks import post_checks
from gaugeworks.plans.readings import clipped, readings
from gaugeworks.queries import _COMPARED, _MONEY, _REV, _ask
from gaugeworks.report_queries import QUERIES, SQL, _add
from gaugeworks.shop import MODEL

__all__ = ["QUERIES", "SQL"]
YEAR = ("1996-01-01", "1997-01-01")
_Y = "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'"

# The compiler.
_ask(
    "metric_with_definitions",
    Request(metrics=("revenue", "orders"), dimensions=("priority",), definitions=("large", "unfinished")),
    f"SELECT o_orderpriority AS priority, {_REV} AS revenue, count(*) AS orders FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' GROUP BY 1",
)
_ask(
    "metric_over_role_join",
    Request(metrics=("lines",), dimensions=("supplier_nations.nation", "segment")),
    """SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
_ask(
    "metric_ratio_weighted_by_period",
    Request(metrics=("load",), dimensions=("priority",), window=YEAR),
    f"""SELECT o_orderpriority AS priority, CAST(count(*) AS DOUBLE) / nullif(count(CASE WHEN o_orderdate = d THEN 1 END) * (366 / 7.0), 0) AS load
    FROM orders, (SELECT max(o_orderdate) AS d FROM orders WHERE {_Y}) WHERE {_Y} GROUP BY 1""",
)
_ask(
    "metric_level_any_in_window",
    Request(metrics=("seen_buyers",), dimensions=("status",), window=YEAR),
    f"SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS seen_buyers FROM orders WHERE {_Y} GROUP BY 1",
)
_ask(
    "metric_shared_filter_pushed",
    Request(metrics=("urgent_revenue", "urgent_orders"), window=YEAR),
    f"SELECT {_REV} AS urgent_revenue, count(*) AS urgent_orders FROM orders WHERE {_Y} AND o_orderpriority = '1-URGENT'",
)
_ask(
    "listing_distinct_dimensions",
    Request(dimensions=("status", "priority")),
    "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders",
)
_add(
    "compare_named_year",
    lambda t: compare(MODEL, t, Request(metrics=("revenue",), dimensions=("priority",), window=YEAR), "1994"),
    _COMPARED.format(key="o_orderpriority", key2="o_orderpriority", name="priority", c="1994-01-01", d="1995-01-01", table="orders", clock="o_orderdate", value=_MONEY, m="revenue", a=YEAR[0], b=YEAR[1]),
)

# The cube door.
_cube = lambda name, query, sql: _add(name, lambda t: run(MODEL, t, query, today=date(1996, 8, 20)), sql)
_cube(
    "cube_segments",
    {"measures": ["orders.orders"], "dimensions": ["orders.status"], "segments": ["orders.large"]},
    "SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
)
_cube(
    "cube_relative_range",
    {"measures": ["orders.orders"], "timeDimensions": [{"dimension": "orders.ordered", "granularity": "month", "dateRange": "last 2 quarters"}]},
    "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ordered_month, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01' GROUP BY 1",
)
_cube(
    "cube_ungrouped",
    {"dimensions": ["orders.order_id", "orders.status"], "ungrouped": True, "timeDimensions": [{"dimension": "orders.ordered", "dateRange": "last month"}]},
    "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-08-01'",
)
_cube(
    "cube_level_in_range",
    {"measures": ["orders.last_day_revenue"], "dimensions": ["orders.priority"], "timeDimensions": [{"dimension": "orders.ordered", "dateRange": ["1996-01-01", "1996-12-31"]}]},
    f"SELECT o_orderpriority AS priority, {_REV} AS last_day_revenue FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE {_Y}) GROUP BY 1",
)
_cube(
    "cube_levels_beside_flows",
    {"measures": ["orders.revenue", "orders.last_day_orders"], "dimensions": ["orders.priority"], "timeDimensions": [{"dimension": "orders.ordered", "dateRange": "this year"}]},
    f"""SELECT o_orderpriority AS priority, {_REV} AS revenue, nullif(count(CASE WHEN o_orderdate = d THEN 1 END), 0) AS last_day_orders
    FROM orders, (SELECT max(o_orderdate) AS d FROM orders WHERE {_Y}) WHERE {_Y} GROUP BY 1""",
)
_cube(
    "cube_compare_ranges",
    {"measures": ["orders.orders"], "dimensions": ["orders.status"], "timeDimensions": [{"dimension": "orders.ordered", "compareDateRange": ["last year", ["1996-01-01", "1996-03-31"]]}]},
    """SELECT o_orderstatus AS status, count(*) AS orders, '1995-01-01 - 1995-12-31' AS "compareDateRange" FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1
    UNION ALL SELECT o_orderstatus, count(*), '1996-01-01 - 1996-03-31' FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01' GROUP BY 1""",
)

# Results.
_by = lambda t, *d: answer(MODEL, t, Request(metrics=("orders",), dimensions=d))
_add(
    "result_column_totals",
    lambda t: results.column_totals(_by(t, "status", "priority"), ["orders"]),
    """SELECT 'orders' AS "column", CAST(sum(n) AS DOUBLE) AS total, count(DISTINCT n) AS distinct_values FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)""",
)
_add(
    "result_running_total",
    lambda t: results.running_total(answer(MODEL, t, Request(metrics=("orders",), dimensions=("status",), grain="month")), "ordered_month", "orders", ["status"]),
    """SELECT *, CAST(sum(orders) OVER (PARTITION BY status ORDER BY ordered_month) AS BIGINT) AS running FROM (SELECT o_orderstatus AS status,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS ordered_month, count(*) AS orders FROM orders GROUP BY 1, 2)""",
)
_add(
    "result_share",
    lambda t: results.share(_by(t, "status", "priority"), _by(t, "priority"), ["priority"], "orders"),
    """SELECT status, priority, orders, CAST(orders AS DOUBLE) / sum(orders) OVER (PARTITION BY priority) AS share FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders FROM orders GROUP BY 1, 2)""",
)
_add(
    "result_per_week",
    lambda t: results.per_period(answer(MODEL, t, Request(metrics=("orders",), dimensions=("status",), window=YEAR)), "orders", *YEAR, unit="week"),
    f"SELECT o_orderstatus AS status, count(*) AS orders, count(*) / (366 / 7.0) AS average FROM orders WHERE {_Y} GROUP BY 1",
)
_add(
    "result_collapsed",
    lambda t: results.collapsed(t("lineitem").select("l_orderkey", "l_shipdate", "l_quantity"), ["l_orderkey"]),
    "SELECT l_orderkey, min(l_shipdate) AS l_shipdate, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1",
)
_add(
    "result_without_null_buckets",
    lambda t: results.without_null_buckets(t("labels").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")), ["toxic"])[0],
    "SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1",
)
_add(
    "result_empty_side",
    lambda t: results.empty_sides(t("orders"), "o_orderdate", YEAR, ("1980-01-01", "1981-01-01")),
    f"SELECT count(CASE WHEN {_Y} THEN 1 END) AS now_rows, count(CASE WHEN o_orderdate < DATE '1981-01-01' THEN 1 END) AS then_rows, 'then' AS empty_side FROM orders",
)
_add(
    "result_window_verdicts",
    lambda t: results.window_verdicts(t("lineitem"), "l_shipdate", ["l_returnflag"], "1997-01-01", "2005-01-01"),
    """SELECT l_returnflag, w AS window_rows, e AS data_end, CASE WHEN e < DATE '1997-01-01' THEN 'not_loaded' WHEN e < DATE '2004-12-31' THEN 'partly' WHEN w = 0 THEN 'empty' ELSE 'loaded' END AS verdict,
    CAST(CASE WHEN e < DATE '2004-12-31' THEN DATE '2004-12-31' - greatest(e, DATE '1996-12-31') ELSE 0 END AS INTEGER) AS gap_days
    FROM (SELECT l_returnflag, count(CASE WHEN l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '2005-01-01' THEN 1 END) AS w, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY 1)""",
)
_add(
    "result_grain_applied",
    lambda t: results.grain_applied(t("orders"), "o_orderdate", "month"),
    """SELECT count(DISTINCT o_orderdate) AS dates, count(DISTINCT date_trunc('month', o_orderdate)) AS buckets, count(DISTINCT o_orderdate) <= 2 * count(DISTINCT date_trunc('month', o_orderdate)) AS applied FROM orders""",
)
_add(
    "result_union_conservation",
    lambda t: results.union_conservation([t("orders").where("o_totalprice > 200000"), t("orders").where("o_orderstatus = 'O'")], ["o_orderkey"]),
    """SELECT a + b AS rows, k AS keys, a + b = k AS conserved FROM (SELECT count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS a,
    count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS b, count(CASE WHEN o_totalprice > 200000 OR o_orderstatus = 'O' THEN 1 END) AS k FROM orders)""",
)
_add(
    "result_unmatched",
    lambda t: results.unmatched(_by(t, "priority"), answer(MODEL, t, Request(metrics=("orders",), dimensions=("priority",), window=YEAR)), ["priority"], ["orders"], 0.9),
    f"""SELECT lower(priority) AS priority, 1 AS a_rows, CAST(n AS DOUBLE) AS a_orders, CASE WHEN m > 0 THEN 1 END AS b_rows, CASE WHEN m > 0 THEN CAST(m AS DOUBLE) END AS b_orders FROM (
    SELECT o_orderpriority AS priority, count(*) AS n, count(CASE WHEN {_Y} THEN 1 END) AS m FROM orders GROUP BY 1) WHERE m = 0 OR n - m > 0.9 * n""",
)
_add(
    "result_all_alike",
    lambda t: results.all_alike(t("orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")), "n"),
    """SELECT count(*) AS rows, count(CASE WHEN n = 1 THEN 1 END) AS ones, 0 AS zeros, count(n) AS "values", CASE WHEN min(n) = 1 AND max(n) = 1 THEN 'all_ones' ELSE 'varied' END AS sign
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)""",
)

# Checks and profiles.
_add(
    "check_grain_verdict",
    lambda t: checks.grain_verdict(t("lineitem"), ["l_orderkey"], "one_per_key"),
    "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS keys, count(*) - count(l_orderkey) AS rows_without_key, 'contradicts' AS verdict FROM lineitem",
)
_add(
    "check_cardinality_verdict",
    lambda t: checks.cardinality_verdict(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")], "one_to_one"),
    """SELECT 1 AS left_most, max(n) AS right_most, 'one_to_many' AS relationship, 'one_to_one' AS declared, 'unsafe' AS verdict FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
)
_add(
    "profile_dictionary",
    lambda t: profiling.dictionary(t("orders"), "o_orderpriority").drop("values"),
    "SELECT true AS complete, sha256(string_agg(v, chr(10) ORDER BY v)) AS digest FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)",
)
_add(
    "profile_date_coverage",
    lambda t: profiling.date_coverage(t("orders"), "o_orderdate", "2010-01-01", "2011-01-01"),
    "SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, true AS outside FROM orders",
)
_add(
    "monitor_stale",
    lambda t: monitor.stale(t("events"), "ts", "2035-05-20", "month"),
    "SELECT CAST(max(ts) AS DATE) AS clock_end, DATE '2035-04-01' AS due, max(ts) < DATE '2035-04-01' AS stale FROM events",
)
_add(
    "monitor_stopped_feeds",
    lambda t: monitor.stopped_feeds(t("lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"], 60),
    """SELECT * FROM (SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
    (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) AS data_end FROM lineitem GROUP BY 1, 2) WHERE data_end - last_day > 60""",
)
_add(
    "monitor_load_evidence",
    lambda t: monitor.load_evidence(t("orders"), "o_orderdate", ["o_orderstatus"], "1996-08-15"),
    """SELECT *, true AS open_period, recent_rows = 0 AS no_recent_rows, coalesce(second_rate < 0.7 * first_rate, false) AS slowed FROM (SELECT o_orderstatus, CAST(max(o_orderdate) AS DATE) AS last_day,
    count(CASE WHEN d > DATE '1996-08-08' AND d <= DATE '1996-08-15' THEN 1 END) AS recent_rows,
    count(CASE WHEN d >= DATE '1996-08-01' AND d < DATE '1996-08-08' THEN 1 END) / 7.0 AS first_rate,
    count(CASE WHEN d >= DATE '1996-08-08' AND d <= DATE '1996-08-15' THEN 1 END) / 8.0 AS second_rate
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1)""",
)

# Grading and anchors.
_add(
    "anchor_cross_claims",
    lambda t: grading.cross_claims(t("embeddings"), "label", "vec_id", "embedding", 0.8).withColumn("cosine", F.round("cosine", 6)),
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.label AS lens_a, b.label AS lens_b, round(max(list_cosine_similarity(a.v, b.v)), 6) AS cosine FROM e a JOIN e b ON a.label < b.label GROUP BY 1, 2
    HAVING max(list_cosine_similarity(a.v, b.v)) >= 0.8""",
)
_add(
    "anchor_own",
    lambda t: grading.own_anchors(t("documents").where("text is not null").select("doc_id", "lang", "text"), "lang", "text").select("doc_id", "lang"),
    "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT lang) > 1)",
)
_add(
    "accuracy_trend",
    lambda t: grading.accuracy_trend(t("orders").groupBy("o_orderstatus", F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", "d", "n"),
    """SELECT o_orderstatus, count(*) AS runs, max(CASE WHEN r = 1 THEN n END) AS latest, max(CASE WHEN r = 2 THEN n END) AS before, max(CASE WHEN r = 1 THEN n END) - max(CASE WHEN r = 2 THEN n END) AS change
    FROM (SELECT o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE) DESC) AS r FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)) GROUP BY 1""",
)
_add(
    "split_accuracy",
    lambda t: grading.split_accuracy(
        t("labels").select((F.col("doc_id") % 3 == 1).alias("held_out"), F.col("quality").isNotNull().alias("c"), (F.col("quality") == 1).alias("ok")), "held_out", "c", "ok"
    ),
    """SELECT doc_id % 3 = 1 AS held_out, count(*) AS cases, CAST(count(quality) AS DOUBLE) / count(*) AS coverage, CAST(count(CASE WHEN quality = 1 THEN 1 END) AS DOUBLE) / nullif(count(quality), 0) AS accuracy FROM labels GROUP BY 1""",
)
_add(
    "literal_rewrite",
    lambda t: grading.rewritten(t("orders"), "o_orderpriority", ["1-urgent", "rush", "5-LOW", "nothing"], {"Rush": "1-URGENT"}),
    """SELECT * FROM (VALUES ('1-urgent', '1-URGENT'), ('rush', '1-URGENT'), ('5-LOW', '5-LOW'), ('nothing', NULL)) AS t(literal, value)""",
)

# What a request may mean.
#: The events once more, their moments stored with a zone and asked for in another one.
ZONED = Model(
    {
        "events": Entity(
            table="events", members={"at": "CAST(concat(CAST(ts AS STRING), ' UTC') AS TIMESTAMP)", "event": "event_type"}, clock="at", metrics={"events": Metric("count")}
        )
    },
    timezone="Asia/Kolkata",
)
_add(
    "metric_zoned_window",
    lambda t: answer(ZONED, t, Request(metrics=("events",), dimensions=("event",), grain="month", filters=(Filter("at", "<=", "2100-01-01"),), window=("1990-01-01", "2100-01-01"))),
    """SELECT CAST(date_trunc('month', ts + INTERVAL '330 minutes') AS DATE) AS at_month, event_type AS event, count(*) AS events FROM events
    WHERE ts + INTERVAL '330 minutes' >= TIMESTAMP '1990-01-01' AND ts + INTERVAL '330 minutes' < TIMESTAMP '2100-01-01' GROUP BY 1, 2""",
)
_ask(
    "metric_grouped_by_label",
    Request(metrics=("orders", "revenue"), dimensions=("customer",)),
    f"SELECT c_name AS customer, count(*) AS orders, {_REV} AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_custkey",
)
_add(
    "cube_of_request",
    lambda t: run(MODEL, t, cube_of(Request(metrics=("revenue", "orders"), dimensions=("priority",), filters=(Filter("status", "!=", "F"),), grain="month", window=YEAR), "ordered")),
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ordered_month, o_orderpriority AS priority, {_REV} AS revenue, count(*) AS orders
    FROM orders WHERE {_Y} AND o_orderstatus <> 'F' GROUP BY 1, 2""",
)
_add(
    "metric_clipped_to_today",
    lambda t: answer(MODEL, t, clipped(MODEL, t, Request(metrics=("revenue", "orders"), window=YEAR), "1996-06-30")),
    f"SELECT {_REV} AS revenue, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01'",
)
_add(
    "readings_compared",
    lambda t: readings(
        MODEL, t,
        {
            "all": Request(metrics=("revenue",), dimensions=("priority",)),
            "known": Request(metrics=("revenue",), dimensions=("priority",), filters=(Filter("status", "in", ["F", "O", "P"]),)),
            "large": Request(metrics=("revenue",), dimensions=("priority",), definitions=("large",)),
        },
        "all",
    ),
    f"""WITH a AS (SELECT o_orderpriority AS p, {_REV} AS v FROM orders GROUP BY 1),
    b AS (SELECT 'known' AS reading, o_orderpriority AS p, {_REV} AS v FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 2
    UNION ALL SELECT 'large', o_orderpriority, {_REV} FROM orders WHERE o_totalprice > 200000 GROUP BY 2)
    SELECT reading, count(*) AS groups, count(CASE WHEN abs(a.v - b.v) > 0.005 * greatest(abs(a.v), abs(b.v)) THEN 1 END) AS differing,
    count(CASE WHEN abs(a.v - b.v) > 0.005 * greatest(abs(a.v), abs(b.v)) THEN 1 END) = 0 AS alike FROM b JOIN a USING (p) GROUP BY 1""",
)

# Evidence.
_add(
    "evidence_zero_result",
    lambda t: evidence.zero_evidence(t("orders").where("o_orderstatus = 'X'").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v")), ["n"], ["v"]),
    "SELECT 1 AS rows, count(*) = 0 AND sum(o_totalprice) IS NULL AS zero FROM orders WHERE o_orderstatus = 'X'",
)
_add(
    "evidence_literal_probe",
    lambda t: evidence.literal_probe(t("orders"), {"o_orderstatus": ["F", "X"], "o_orderpriority": ["5-LOW"], "o_orderkey": ["1"]}).select(
        "column", F.array_join("values", "|").alias("listed"), F.array_join("missing", "|").alias("missing"), "status"
    ),
    """SELECT 'o_orderstatus' AS "column", string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS listed, 'X' AS missing, 'missing' AS status FROM orders
    UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority), '', 'present' FROM orders
    UNION ALL SELECT 'o_orderkey', NULL, NULL, 'unresolved'""",
)
_add(
    "evidence_creation_dated",
    lambda t: evidence.creation_dated(t("lineitem"), ["l_orderkey", "l_linenumber"]),
    """SELECT count(*) AS rows, greatest(count(DISTINCT l_orderkey), count(DISTINCT l_linenumber)) AS keys,
    greatest(count(DISTINCT l_orderkey), count(DISTINCT l_linenumber)) >= count(*) AS creation_dated FROM lineitem""",
)
_add(
    "result_latest_readings",
    lambda t: evidence.latest_readings(t("orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")), ["o_orderpriority"], "day", "quarter"),
    """SELECT o_orderpriority, CAST(date_trunc('quarter', day) AS DATE) AS bucket, max(day) AS day, max_by(n, day) AS n
    FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1, 2""",
)
_add(
    "result_measure_gaps",
    lambda t: evidence.measure_gaps(
        t("lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"], {"all": {}, "returned": {"l_returnflag": ["A", "R"]}}, [("1995-01-01", "1996-01-01"), ("1998-01-01", "1999-01-01")]
    ),
    """WITH e AS (SELECT l_returnflag AS f, l_linestatus AS s, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1, 2),
    m AS (SELECT 'all' AS measure, d FROM e UNION ALL SELECT 'returned', d FROM e WHERE f IN ('A', 'R')),
    w AS (SELECT * FROM (VALUES (DATE '1995-01-01', DATE '1996-01-01'), (DATE '1998-01-01', DATE '1999-01-01')) AS w(a, z))
    SELECT measure, a AS start, z AS "end", count(*) AS feeds, count(CASE WHEN d >= a AND d < z - 1 THEN 1 END) AS ending_inside,
    count(CASE WHEN d < a THEN 1 END) AS ending_before, min(d) AS earliest_end, count(*) > count(CASE WHEN d < a THEN 1 END) AS loaded FROM m, w GROUP BY 1, 2, 3""",
)
_add(
    "answer_post_checks",
    lambda t: post_checks(MODEL, t, Request(metrics=("lines",), dimensions=("return_flag", "line_status"), order=(("lines", "desc"),), limit=1, window=("1998-06-01", "2030-01-01"))),
    """WITH f AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' AND l_shipdate < DATE '2030-01-01' GROUP BY 1, 2),
    k AS (SELECT *, rank() OVER (ORDER BY n DESC) AS place FROM f),
    e AS (SELECT DATE '2029-12-31' - CAST(max(l_shipdate) AS DATE) AS short FROM lineitem)
    SELECT 1 AS nth, 'empty_result' AS "check", CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS verdict, count(*) AS detail FROM f
    UNION ALL SELECT 2, 'window', 'partly', short FROM e
    UNION ALL SELECT 3, 'null_bucket', CASE WHEN count(*) > 0 THEN 'nameless' ELSE 'ok' END, count(*) FROM k WHERE place = 1 AND (l_returnflag IS NULL OR l_returnflag = '' OR l_linestatus IS NULL OR l_linestatus = '')
    UNION ALL SELECT 4, 'tie_at_limit', CASE WHEN count(*) > 1 THEN 'tied' ELSE 'ok' END, greatest(count(*) - 1, 0) FROM k WHERE place = 1""",
)
