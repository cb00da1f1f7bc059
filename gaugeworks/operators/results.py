"""Operations on results: totals, shares, alignment, verdicts on empty windows, tolerant equality and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The tolerances of graded answers, by kind.
TOLERANCES = {"scalar": 0.02, "ratio": 1e-3, "count": 0.0}


def column_totals(result: DataFrame, values: list[str]) -> DataFrame:
    """One row per value column: its total and its distinct values, nulls aside, from one pass."""
    facts = [x for v in values for x in (F.sum(v).cast("double").alias(f"{v}|total"), F.count_distinct(v).alias(f"{v}|distinct"))]
    row = result.agg(*facts)
    each = [F.struct(F.lit(v).alias("column"), F.col(f"`{v}|total`").alias("total"), F.col(f"`{v}|distinct`").alias("distinct_values")) for v in values]
    return row.select(F.inline(F.array(*each)))


def running_total(result: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """The result with `running`: the total of the value up to a row, in order, for each group.

    Results are small, but one without groups is not gathered either: it is summed per value of `order`
    first, so the window holds one row for each of those.
    """
    per = result.groupBy(*by, order).agg(F.sum(value).alias(value))
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.withColumn("running", F.sum(value).over(w))


def share(part: DataFrame, whole: DataFrame, keys: list[str], value: str) -> DataFrame:
    """part's values with `share` of whole's on the same keys (nulls meet); null where whole has none or 0."""
    names = [f"whole {k}" for k in keys]
    other = whole.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("whole value"))
    if keys:
        on = F.lit(True)
        for k, n in zip(keys, names):
            on = on & F.col(k).eqNullSafe(F.col(n))
        out = part.join(other, on, "left")
    else:
        out = part.join(F.broadcast(other), how="left")  # one row each
    ratio = F.col(value).cast("double") / F.nullif(F.col("whole value").cast("double"), F.lit(0.0))
    return out.withColumn("share", ratio).drop("whole value", *names)


def per_period(result: DataFrame, value: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """`average`: the value divided by the days or (fractional) weeks of the window [start, end)."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    return result.withColumn("average", F.col(value).cast("double") / (days if unit == "day" else days / F.lit(7.0)))


def collapsed(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; of the other columns the smallest values, so that the result is the same at each run."""
    return df.groupBy(*key).agg(*[F.min(c).alias(c) for c in df.columns if c not in key])


def without_null_buckets(result: DataFrame, dimensions: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows to rank, and apart from them those without a value (null or empty text) in a dimension."""
    empty = F.lit(False)
    for d in dimensions:
        empty = empty | F.col(d).isNull() | (F.col(d).cast("string") == "")
    return result.where(~empty), result.where(empty)


def canonical_cell(c: str | Column) -> Column:
    """Text by which cells are compared: numbers without trailing zeros, ISO days, other text trimmed in lower case."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    plain = F.regexp_replace(text, ",", "")
    number = F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(number, r"^\+", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    lead = F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1")
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})([ T]00:00:00(\.0+)?Z?)?$", 1)
    return F.coalesce(F.when(lead == "-0", "0").otherwise(lead), F.when(day != "", day), F.lower(text))


def signature(result: DataFrame, values: list[str]) -> DataFrame:
    """One row: a digest of the result's numbers to six significant digits, whatever the order and labels of rows.

    Every row gives one hash; hashes are summed, so no task gathers the rows.
    """
    parts = [F.coalesce(F.format_string("%.5e", F.col(v).cast("double")), F.lit("null")) for v in values]
    text = F.concat_ws("|", F.sort_array(F.array(*parts)))
    return result.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.crc32(text.cast("binary"))).alias("signature"))


def graded(answers: DataFrame, kind: str, got: str, want: str) -> DataFrame:
    """`correct`: whether got is want within the tolerance of scalars (relative), ratios (absolute, per cent allowed), counts (none)."""
    g, w = F.col(got).cast("double"), F.col(want).cast("double")
    off = F.abs(g - w)
    if kind == "scalar":
        ok = off <= TOLERANCES[kind] * F.abs(w)
    elif kind == "ratio":
        ok = (off <= TOLERANCES[kind]) | (F.abs(g / 100 - w) <= TOLERANCES[kind])
    elif kind == "count":
        ok = off == 0
    else:
        raise ValueError(f"unknown kind {kind}")
    return answers.withColumn("correct", F.coalesce(ok, g.isNull() & w.isNull()))


def unmatched(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of two results that differ: keys that one lacks or repeats, and values apart by more than the tolerance.

    Keys are compared as canonical cells; the tolerance is relative to the larger value, so near values never
    fall on two sides of a rounding edge.
    """
    key = [canonical_cell(k).alias(k) for k in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{name}_rows"), *[F.max(v).cast("double").alias(f"{name}_{v}") for v in values])

    left, right = side(a, "a"), side(b, "b")
    right = right.withColumnsRenamed({k: f"b {k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b {k}"))
    both = left.join(right, on, "full")
    bad = ~F.col("a_rows").eqNullSafe(F.col("b_rows")) | (F.col("a_rows") > 1)
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        far = F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y))
        bad = bad | F.coalesce(far, ~x.eqNullSafe(y))
    return both.where(bad).withColumns({k: F.coalesce(k, f"b {k}") for k in keys}).drop(*[f"b {k}" for k in keys])


def reconciled(free: DataFrame, certified: DataFrame, value: str, tolerance: float = 0.005) -> DataFrame:
    """One row: a figure of free SQL beside the certified one of the same tables and window, and whether they agree."""
    both = free.select(F.col(value).cast("double").alias("free")).crossJoin(certified.select(F.col(value).cast("double").alias("certified")))  # one row each
    off = F.abs(F.col("free") - F.col("certified"))
    return both.withColumn("agrees", F.coalesce(off <= tolerance * F.abs("certified"), F.col("free").eqNullSafe(F.col("certified"))))


def empty_sides(df: DataFrame, clock: str, now: tuple[str, str], then: tuple[str, str]) -> DataFrame:
    """One row: rows in either window of a comparison, and which side is empty (now, then, both, none)."""
    inside = lambda w: (F.col(clock) >= F.lit(w[0]).cast("date")) & (F.col(clock) < F.lit(w[1]).cast("date"))
    row = df.agg(F.count_if(inside(now)).alias("now_rows"), F.count_if(inside(then)).alias("then_rows"))
    side = F.when(F.expr("now_rows = 0 and then_rows = 0"), "both").when(F.expr("now_rows = 0"), "now").when(F.expr("then_rows = 0"), "then")
    return row.withColumn("empty_side", F.coalesce(side, F.lit("none")))


def window_verdicts(df: DataFrame, clock: str, feeds: list[str], start: str, end: str) -> DataFrame:
    """Per feed what a window [start, end) of it means: loaded, partly (data end inside), not_loaded (data end before) or empty.

    A feed whose data go past the window but that has no row in it measures 0; one that ends before it tells nothing.
    """
    day, a, b = F.to_date(clock), F.lit(start).cast("date"), F.lit(end).cast("date")
    per = df.groupBy(*feeds).agg(F.count_if((day >= a) & (day < b)).alias("window_rows"), F.max(day).alias("data_end"))
    verdict = (
        F.when(F.col("data_end").isNull() | (F.col("data_end") < a), "not_loaded")
        .when(F.col("data_end") < F.date_sub(b, 1), "partly")
        .when(F.col("window_rows") == 0, "empty")
        .otherwise("loaded")
    )
    gap = F.when(F.col("data_end") < F.date_sub(b, 1), F.datediff(F.date_sub(b, 1), F.greatest("data_end", F.date_sub(a, 1))))
    return per.withColumn("verdict", verdict).withColumn("gap_days", F.coalesce(gap, F.lit(0)))


def grain_applied(result: DataFrame, column: str, grain: str) -> DataFrame:
    """One row: dates of a result against the buckets they fall in; over twice as many dates means the grain was not applied."""
    row = result.agg(F.count_distinct(column).alias("dates"), F.count_distinct(F.date_trunc(grain, F.col(column))).alias("buckets"))
    return row.withColumn("applied", F.col("dates") <= 2 * F.col("buckets"))


def all_alike(result: DataFrame, value: str) -> DataFrame:
    """One row: rows, and whether all values are 1, or all 0, or none is there: signs of a wrong grain or filter."""
    v = F.col(value)
    row = result.agg(F.count(F.lit(1)).alias("rows"), F.count_if(v == 1).alias("ones"), F.count_if(v == 0).alias("zeros"), F.count(v).alias("values"))
    sign = F.when(F.expr("values = 0"), "no_values").when(F.expr("ones = rows and rows > 1"), "all_ones").when(F.expr("zeros = rows"), "all_zero")
    return row.withColumn("sign", F.coalesce(sign, F.lit("varied")))


def union_conservation(branches: list[DataFrame], key: list[str]) -> DataFrame:
    """One row: rows that a UNION ALL of branches gives and the distinct keys in it; more rows than keys were counted twice."""
    rows = branches[0].select(*key)
    for b in branches[1:]:
        rows = rows.unionByName(b.select(*key))
    per = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
    return out.withColumn("conserved", F.col("rows") == F.col("keys"))


def text_month(c: str) -> Column:
    """The first day of a month written as YYYY-MM; null for other text."""
    return F.when(F.col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(F.col(c), F.lit("-01"))))
