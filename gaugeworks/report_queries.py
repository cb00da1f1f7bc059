"""Registered queries of profiles, ledger reports and grading, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import grading, ledger, profiling
from gaugeworks.queries import QUERIES, SQL, _add

_STATS = """SELECT '{c}' AS "column", count(*) AS rows, round(CAST(count(CASE WHEN {c} IS NULL THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 6) AS null_rate,
count(DISTINCT {c}) AS "values", count(DISTINCT {c}) <= 25 AS few_values, {least} AS least, {most} AS most, {mean} AS mean,
{first} AS first_day, {last} AS last_day, CAST(NULL AS DOUBLE) AS offset_days, true AS exact FROM orders"""
_NUMBER = {"least": "CAST(min({c}) AS DOUBLE)", "most": "CAST(max({c}) AS DOUBLE)", "mean": "CAST(sum(CAST({c} AS DECIMAL(28, 6))) AS DOUBLE) / count({c})"}
_DAY = {"first": "CAST(min({c}) AS DATE)", "last": "CAST(max({c}) AS DATE)"}


def _stats(c: str, facts: dict[str, str]) -> str:
    empty = {k: "CAST(NULL AS DOUBLE)" for k in ("least", "most", "mean")} | {k: "CAST(NULL AS DATE)" for k in ("first", "last")}
    return _STATS.format(c=c, **empty | {k: v.format(c=c) for k, v in facts.items()})


_add(
    "profile_column_stats",
    lambda t: profiling.column_stats(t("orders"), ["o_orderstatus", "o_totalprice", "o_orderdate"], clock="o_orderdate", sampled=False),
    " UNION ALL ".join([_stats("o_orderstatus", {}), _stats("o_totalprice", _NUMBER), _stats("o_orderdate", _DAY)]),
)
_add(
    "profile_value_shapes",
    lambda t: profiling.value_shapes(t("events"), ["props", "event_type"]),
    """SELECT 'props' AS "column", count(props) AS texts, CASE WHEN count(props) < 2 THEN NULL WHEN bool_and(regexp_matches(props, '^\\s*\\{.*\\}\\s*$')) THEN 'json-object' ELSE 'text' END AS shape FROM events
    UNION ALL SELECT 'event_type', count(event_type), CASE WHEN count(event_type) < 2 THEN NULL ELSE 'text' END FROM events""",
)
_add(
    "profile_coverage",
    lambda t: profiling.coverage(t("lineitem"), "l_shipdate", "1998-06-30"),
    """SELECT first_day, least(newest, DATE '1998-06-30') AS last_day, newest > DATE '1998-06-30' AS future_rows,
    CAST(DATE '1998-06-30' - least(newest, DATE '1998-06-30') AS INTEGER) AS days_behind, DATE '1998-06-30' - least(newest, DATE '1998-06-30') > 7 AS stale
    FROM (SELECT CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS newest FROM lineitem)""",
)
_add(
    "profile_recent_slice",
    lambda t: profiling.recent_slice(t("orders"), "o_orderdate", 30).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY",
)
_add(
    "drift_values",
    lambda t: profiling.values_changed(
        t("orders").where("year(o_orderdate) = 1995"), t("orders").where("year(o_orderdate) = 1996"), "o_custkey"
    ),
    """WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE year(o_orderdate) = 1996)
    SELECT v AS value, 'vanished' AS kind FROM a WHERE v NOT IN (SELECT v FROM b) UNION ALL SELECT v, 'new' FROM b WHERE v NOT IN (SELECT v FROM a)""",
)
_add(
    "ledger_shares",
    lambda t: ledger.shares(t("events"), ["event_type"], "user_id"),
    """SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS callers, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1""",
)
_add(
    "ledger_statement",
    lambda t: ledger.statement(t("orders"), ["o_orderpriority"], "o_orderdate", "1996-01-01", "1996-04-01"),
    """SELECT *, requests - requests_before AS delta FROM (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate >= DATE '1996-01-01') AS requests,
    count(*) FILTER (WHERE o_orderdate < DATE '1996-01-01') AS requests_before FROM orders
    WHERE o_orderdate >= DATE '1996-01-01' - 91 AND o_orderdate < DATE '1996-04-01' GROUP BY 1)""",
)
_add(
    "ledger_rolling_quota",
    lambda t: ledger.rolling_use(t("events"), "user_id", "ts", 86_400, 3),
    """SELECT user_id, second, n, CAST(used AS BIGINT) AS used, used > 3 AS over FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS used
    FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2))""",
)
_add(
    "grading_difference",
    lambda t: grading.difference(
        t("lineitem").where("year(l_shipdate) = 1995").select("l_linenumber", "l_quantity"),
        t("lineitem").where("year(l_shipdate) = 1996").select("l_linenumber", "l_quantity"),
    ),
    """SELECT l_linenumber, l_quantity, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT l_linenumber, round(l_quantity, 6) AS l_quantity,
    CASE WHEN year(l_shipdate) = 1995 THEN 1 ELSE -1 END AS s FROM lineitem WHERE year(l_shipdate) IN (1995, 1996)) GROUP BY 1, 2 HAVING sum(s) <> 0""",
)
_P, _Y = "l_discount * 10", "l_returnflag = 'R'"
_BINS = f"""SELECT *, abs(confidence - accuracy) AS gap FROM (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS answers,
avg(p) AS confidence, avg(y) AS accuracy, avg((p - y) * (p - y)) AS brier FROM (SELECT {_P} AS p, CASE WHEN {_Y} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem) GROUP BY 1)"""


def _rounded(df, *keys: str):
    """Means of doubles depend on the order of rows in their last places."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


_add(
    "grading_calibration",
    lambda t: _rounded(grading.calibration(t("lineitem"), F.expr(_P), F.expr(_Y).cast("int"))),
    f"SELECT bin, answers, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy, round(brier, 9) AS brier, round(gap, 9) AS gap FROM ({_BINS})",
)
_add(
    "grading_calibration_error",
    lambda t: _rounded(grading.calibration_error(grading.calibration(t("lineitem"), F.expr(_P), F.expr(_Y).cast("int")))),
    f"SELECT round(sum(brier * answers) / sum(answers), 9) AS brier, round(sum(gap * answers) / sum(answers), 9) AS error FROM ({_BINS})",
)
_add(
    "grading_coverage_curve",
    lambda t: _rounded(grading.coverage_curve(t("lineitem"), F.expr(_P), F.expr(_Y).cast("int"), [0.25, 0.55, 0.85])),
    " UNION ALL ".join(
        f"""SELECT CAST({x} AS DOUBLE) AS threshold, round(CAST(count(*) FILTER (WHERE {_P} >= {x}) AS DOUBLE) / count(*), 9) AS coverage,
        round(avg(CASE WHEN {_Y} THEN 1.0 ELSE 0.0 END) FILTER (WHERE {_P} >= {x}), 9) AS accuracy FROM lineitem"""
        for x in (0.25, 0.55, 0.85)
    ),
)
_add(
    "grading_band",
    lambda t: grading.order_statistic(t("lineitem"), ["l_returnflag"], "l_quantity", 0.05),
    """SELECT l_returnflag, l_quantity AS band FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_quantity IS NOT NULL) WHERE r = floor(0.05 * (n - 1)) + 1""",
)
_add(
    "grading_held_out",
    lambda t: grading.held_out(t("part").select("p_partkey", "p_name"), "p_name", "a", 20),
    """SELECT p_partkey, p_name, CAST('0x' || substr(md5('a' || coalesce(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '')), 1, 8) AS BIGINT) % 100 < 20 AS held_out FROM part""",
)
_VECTOR = [(7 * i) % 13 - 6 for i in range(64)]
_COS = f"""round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])) /
(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt({sum(x * x for x in _VECTOR)})), 9)"""
_add(
    "anchors_nearest",
    lambda t: _rounded(grading.nearest(t("embeddings"), "vec_id", "embedding", _VECTOR, 10)),
    f"SELECT vec_id, {_COS} AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10",
)
_add(
    "anchors_route",
    lambda t: _rounded(grading.route(t("embeddings"), "label", "embedding", _VECTOR)),
    f"""WITH b AS (SELECT label, max({_COS}) AS best FROM embeddings GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY best DESC) AS n FROM b)
    SELECT label, best, n = 1 AND (best >= 0.95 OR (best >= 0.78 AND best - coalesce((SELECT best FROM r WHERE n = 2), -1) >= 0.07)) AS routed FROM r""",
)
_add(
    "literals_unknown",
    lambda t: grading.unknown_literals(t("customer"), "c_mktsegment", ["BUILDING", "machinry", "AUTO"]),
    " UNION ALL ".join(
        f"""(SELECT '{x}' AS literal, v AS nearest, CAST(levenshtein(lower(v), '{x.lower()}') AS INTEGER) AS edits FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)
        WHERE '{x}' NOT IN (SELECT c_mktsegment FROM customer) ORDER BY edits, nearest LIMIT 1)"""
        for x in ("BUILDING", "machinry", "AUTO")
    ),
)
_add(
    "definitions_conflicting",
    lambda t: grading.conflicts(t("part"), "p_brand", "p_type"),
    "SELECT p_brand, count(DISTINCT trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g'))) AS ways, count(*) AS definitions FROM part GROUP BY 1 HAVING ways > 1",
)
_add(
    "definitions_agreed",
    lambda t: grading.agreed(t("lineitem"), "l_suppkey", "l_linenumber", "l_quantity"),
    """SELECT l_suppkey, l_quantity, n AS variants FROM (SELECT l_suppkey, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS r
    FROM lineitem JOIN (SELECT l_suppkey AS k, min(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_suppkey = k AND l_linenumber = m GROUP BY 1, 2) WHERE r = 1""",
)

__all__ = ["QUERIES", "SQL"]
