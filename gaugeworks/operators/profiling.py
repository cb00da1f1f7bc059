"""Profiles of tables and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When a profile is sampled, and what counts as few values.
EXACT_ROWS, SAMPLE_ROWS, FEW_VALUES = 1_000_000, 10_000, 25

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _shape_tests(text: Column) -> dict[str, Column]:
    """Whether a text has a shape, the narrowest shapes first."""
    clean = F.trim(text)
    json = F.try_parse_json(clean)
    halves = F.split(F.regexp_replace(clean, r"^\(|\)$", ""), ",")
    number = lambda x: F.trim(x).try_cast("double").isNotNull() & ~F.lower(F.trim(x)).rlike("[a-z]")
    day = F.when(F.length(clean) == 7, F.concat(clean, F.lit("-01"))).otherwise(clean)
    return {
        "json-object": json.isNotNull() & clean.startswith("{"),
        "json-array": json.isNotNull() & clean.startswith("["),
        "point": (F.size(halves) == 2) & number(halves[0]) & number(F.get(halves, F.lit(1))),
        "numeric-text": number(clean),
        "date-text": clean.rlike(r"^\d{4}-\d{2}") & day.try_cast("timestamp").isNotNull(),
    }


def _named(row: DataFrame, columns: list[str], kept: tuple[str, ...], facts: tuple[str, ...]) -> DataFrame:
    """A row with columns `column|fact` as one row per column."""
    each = [F.struct(F.lit(c).alias("column"), *kept, *[F.col(f"`{c}|{k}`").alias(k) for k in facts]) for c in columns]
    return row.select(F.inline(F.array(*each)))


def column_stats(
    df: DataFrame,
    columns: list[str],
    rows: int | None = None,
    shape_only: tuple[str, ...] = (),
    clock: str | None = None,
    seed: int = 0,
    sampled: bool = True,
) -> DataFrame:
    """One row per column from one aggregate: rows, null_rate, values, few_values, extremes, mean, offset, exact.

    Up to EXACT_ROWS rows (`rows`, counted when not given) all of them are read and values are counted
    exactly; beyond, about SAMPLE_ROWS sampled rows give an estimate and `exact` is false. Without `sampled`
    all rows are read at every size. Extremes are of
    numbers (least, most) and days (first_day, last_day), but for columns in shape_only. offset_days is the
    median distance of a temporal column behind the clock.
    """
    total = (df.count() if rows is None else rows) if sampled else 0
    exact = total <= EXACT_ROWS
    part = df if exact else df.sample(min(1.0, 1.2 * SAMPLE_ROWS / total), seed).limit(SAMPLE_ROWS)
    types = dict(df.dtypes)
    facts = []
    for c in columns:
        col, kind = F.col(f"`{c}`"), types[c]
        number = kind.split("(")[0] in _NUMERIC
        moment = kind == "date" or kind.startswith("timestamp")
        shown = c not in shape_only
        none = F.max(F.lit(None).cast("double"))
        no_day = F.max(F.lit(None).cast("date"))
        distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col)
        few = distinct <= FEW_VALUES
        facts += [
            F.round(F.count_if(col.isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias(f"{c}|null_rate"),
            F.least(distinct, F.count(col)).alias(f"{c}|values"),
            few.alias(f"{c}|few_values"),
            (F.min(col.cast("double")) if number and shown else none).alias(f"{c}|least"),
            (F.max(col.cast("double")) if number and shown else none).alias(f"{c}|most"),
            (F.avg(col.cast("decimal(28,6)")).cast("double") if number and shown else none).alias(f"{c}|mean"),
            (F.min(col.cast("date")) if moment and shown else no_day).alias(f"{c}|first_day"),
            (F.max(col.cast("date")) if moment and shown else no_day).alias(f"{c}|last_day"),
            (F.median(F.datediff(F.col(clock), col)) if moment and clock and c != clock else none).alias(f"{c}|offset_days"),
        ]
    names = ("null_rate", "values", "few_values", "least", "most", "mean", "first_day", "last_day", "offset_days")
    out = _named(part.agg(F.count(F.lit(1)).alias("rows"), *facts), columns, ("rows",), names)
    return out.withColumn("exact", F.lit(exact))


def value_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The shape that all texts of a column share (text: none), told from two or more texts; blank texts tell nothing."""
    facts = []
    for c in columns:
        text = F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string"))
        shape = F.lit("text")
        for name, test in reversed(_shape_tests(text).items()):
            shape = F.when(F.min(F.when(text.isNotNull(), F.coalesce(test, F.lit(False)))), name).otherwise(shape)
        facts += [F.count(text).alias(f"{c}|texts"), F.when(F.count(text) >= 2, shape).alias(f"{c}|shape")]
    return _named(df.agg(*facts), columns, (), ("texts", "shape"))


def coverage(df: DataFrame, clock: str, today: str, stale_after_days: int = 7) -> DataFrame:
    """One row: first and last day of the whole table (the last not after today), days behind, stale or not."""
    now = F.lit(today).cast("date")
    row = df.agg(F.min(clock).cast("date").alias("first_day"), F.max(clock).cast("date").alias("newest"))
    row = row.select("first_day", F.least("newest", now).alias("last_day"), (F.col("newest") > now).alias("future_rows"))
    behind = F.datediff(now, F.col("last_day"))
    return row.withColumn("days_behind", behind).withColumn("stale", behind > stale_after_days)


def recent_slice(df: DataFrame, clock: str, days: int) -> DataFrame:
    """The rows of the last `days` days before the newest value, which need not be near today."""
    newest = df.agg(F.max(clock).alias("newest"))
    return df.join(F.broadcast(newest), F.expr(f"`{clock}` > newest - interval {int(days)} days")).drop("newest")  # one row


def columns_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, dropped or retyped between two frames of (table, column, type)."""
    both = old.withColumnRenamed("type", "was").join(new.withColumnRenamed("type", "now"), ["table", "column"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "dropped").when(F.expr("was <> now"), "retyped")
    return both.withColumn("kind", kind).where("kind is not null")


def values_changed(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Values of a column that are new or have vanished; null is no value."""
    side = lambda df, name: df.select(F.col(column).alias("value"), F.lit(name).alias("side")).where("value is not null")
    met = side(old, "old").union(side(new, "new")).groupBy("value").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return met.where("a = b").select("value", F.when(F.col("a") == "new", "new").otherwise("vanished").alias("kind"))


def shifted(old: DataFrame, new: DataFrame, tolerance: float = 0.25, days: float = 7.0) -> DataFrame:
    """Columns of two column_stats whose mean moved by more than a share of it or whose offset moved by more days."""
    a = old.select("column", F.col("mean").alias("mean_was"), F.col("offset_days").alias("offset_was"))
    b = new.select("column", F.col("mean").alias("mean_now"), F.col("offset_days").alias("offset_now"))
    far = (F.abs(F.expr("mean_now - mean_was")) > tolerance * F.abs("mean_was")) | (F.abs(F.expr("offset_now - offset_was")) > days)
    return a.join(b, "column").where(F.coalesce(far, F.lit(False)))


def impact(findings: DataFrame, references: DataFrame) -> DataFrame:
    """Findings (table, column, kind) with the assets that read the column; breaking: dropped or retyped, and read."""
    read = references.groupBy("table", "column").agg(F.sort_array(F.collect_set("asset")).alias("assets"))
    out = findings.join(read, ["table", "column"], "left")
    return out.withColumn("breaking", F.col("assets").isNotNull() & F.col("kind").isin("dropped", "retyped"))


def downstream(edges: DataFrame, start: str, most: int = 64) -> DataFrame:
    """All tables that (source, target) edges of a lineage lead to from one table, in up to `most` steps.

    Every step adds the targets that are new, so a cycle ends where it closes. Lineage is small: one row per edge.
    """
    known = edges.where(F.col("source") == start).select(F.col("target").alias("name")).distinct()
    size = -1
    for _ in range(most):
        known = edges.sparkSession.createDataFrame(known.collect(), "name string")
        if (now := known.count()) == size:
            break
        size = now
        known = known.union(edges.join(known, edges["source"] == known["name"], "left_semi").select("target")).distinct()
    return known


def tables_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables added, dropped or with another comment, between two frames of (table, comment)."""
    both = old.select("table", F.col("comment").alias("was"), F.lit(True).alias("o")).join(
        new.select("table", F.col("comment").alias("now"), F.lit(True).alias("n")), "table", "full"
    )
    kind = F.when(F.expr("o is null"), "added").when(F.expr("n is null"), "dropped").when(~F.col("was").eqNullSafe(F.col("now")), "comment_changed")
    return both.withColumn("kind", kind).where("kind is not null").select("table", "kind")


def dictionary(df: DataFrame, column: str, most: int = 25) -> DataFrame:
    """One row: up to `most` values by frequency, their digest, and whether that is all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(most + 1).agg(F.array_sort(F.collect_list("value")).alias("v"), F.count(F.lit(1)).alias("found"))
    out = top.withColumn("complete", F.col("found") <= most).withColumn("values", F.when(F.col("complete"), F.col("v")))
    return out.select("values", "complete", F.sha2(F.concat_ws("\n", "values"), 256).alias("digest"))


def as_of(stamps: DataFrame, today: str) -> DataFrame:
    """One row: the oldest last day among the tables of (table, last_day) that have one, not after today."""
    return stamps.agg(F.least(F.min("last_day"), F.lit(today).cast("date")).alias("as_of"))


def date_coverage(df: DataFrame, clock: str, start: str, end: str) -> DataFrame:
    """One row: the measured span, and whether [start, end) lies wholly outside it."""
    row = df.agg(F.min(clock).cast("date").alias("first_day"), F.max(clock).cast("date").alias("last_day"))
    outside = (F.lit(end).cast("date") <= F.col("first_day")) | (F.lit(start).cast("date") > F.col("last_day"))
    return row.withColumn("outside", F.coalesce(outside, F.lit(True)))


def name_matches(known: list[str], pattern: str) -> list[str]:
    """Names whose trailing parts, or as many as the pattern has, match it (* and ? allowed), case aside."""
    from fnmatch import fnmatchcase

    parts = pattern.lower().split(".")
    tail = lambda name: name.lower().split(".")[-len(parts) :]
    return [k for k in known if len(tail(k)) == len(parts) and all(fnmatchcase(a, b) for a, b in zip(tail(k), parts))]
