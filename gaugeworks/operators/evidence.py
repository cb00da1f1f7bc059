"""Evidence about a result: whether its zero is one, which literals its filters miss, what feeds held for its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.monitor import data_ends

#: Fixed value: a column with more values than this is not listed.
LISTED = 25


def zero_evidence(result: DataFrame, counts: list[str], others: list[str]) -> DataFrame:
    """One row: rows of an ungrouped result, and whether it is one whose counts are 0 and whose other figures are null.

    Such a row says that nothing met the filters, as an empty result would.
    """
    nothing = F.lit(bool(counts or others))
    for c in counts:
        nothing = nothing & F.coalesce(F.col(c) == 0, F.lit(False))
    for c in others:
        nothing = nothing & F.col(c).isNull()
    row = result.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nothing).alias("blank"))
    return row.select("rows", F.expr("rows = 0 or (rows = 1 and blank = 1)").alias("zero"))


def literal_probe(df: DataFrame, filters: dict[str, list[str]], most: int = LISTED) -> DataFrame:
    """Per filtered column: its values where there are at most `most`, the literals it does not hold, and a status.

    missing: a literal is not among the values; present: all are; unresolved: no value, or too many to list. All
    columns are read in one pass, and a task keeps `most` + 1 values of a column.
    """
    pair = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in filters]
    pairs = df.select(F.inline(F.array(*pair))).where("value is not null").distinct()
    nth = F.row_number().over(W.partitionBy("column").orderBy("value"))
    few = pairs.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    held = few.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))
    asked = [(c, [str(x) for x in given]) for c, given in filters.items()]
    asked = df.sparkSession.createDataFrame(asked, "column string, literals array<string>")
    out = asked.join(held, "column", "left")
    out = out.withColumn("values", F.when(F.size("values").between(1, most), F.col("values")))
    out = out.withColumn("missing", F.array_sort(F.array_except("literals", "values")))
    status = F.when(F.col("values").isNull(), "unresolved").when(F.size("missing") > 0, "missing").otherwise("present")
    return out.select("column", "values", "missing", status.alias("status"))


def creation_dated(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, and whether a column of the key is unique on its own: one row per record, not one per record and snapshot."""
    most = F.lit(0).cast("long")
    for k in key:
        most = F.greatest(most, F.count_distinct(k))
    row = df.agg(F.count(F.lit(1)).alias("rows"), most.alias("keys"))
    return row.withColumn("creation_dated", F.expr("rows > 0 and keys >= rows"))


def latest_readings(readings: DataFrame, dimensions: list[str], clock: str, grain: str | None = None) -> DataFrame:
    """Of readings at several days the latest for each group of the dimensions, or for each group and bucket of a grain.

    Readings without a day are none; of equal days one stays, the largest. `bucket` is there with a grain only.
    """
    own = [] if grain is None else [F.date_trunc(grain, F.col(clock)).cast("date").alias("bucket")]
    rest = [c for c in readings.columns if c not in dimensions and c != clock]
    got = readings.where(F.col(clock).isNotNull()).groupBy(*dimensions, *own).agg(F.max(F.struct(clock, *rest)).alias("row"))
    return got.select(*dimensions, *(["bucket"] if own else []), "row.*")


def measure_gaps(
    df: DataFrame, clock: str, feeds: list[str], measures: dict[str, dict[str, list]], windows: list[tuple[str, str]]
) -> DataFrame:
    """Per measure and window [start, end): the feeds it reads, those that end inside it or before it, and whether any is loaded.

    measures: per measure the feed values it is bound to; a feed column that is not named is read whole. The feeds'
    ends come from one pass, and measures and windows multiply only their few rows.
    """
    ends = data_ends(df, clock, feeds).select(*feeds, "last_day")
    of = []
    for name, pins in measures.items():
        reads = F.lit(True)
        for column, values in pins.items():
            reads = reads & F.col(column).isin(list(values))
        of.append(F.when(reads, F.lit(name)))
    spans = [F.struct(F.lit(a).cast("date").alias("start"), F.lit(z).cast("date").alias("end")) for a, z in windows]
    per = ends.withColumn("measure", F.explode(F.array_compact(F.array(*of)))).select("measure", "last_day", F.inline(F.array(*spans)))
    last = F.col("last_day")
    out = per.groupBy("measure", "start", "end").agg(
        F.count(F.lit(1)).alias("feeds"),
        F.count_if((last >= F.col("start")) & (last < F.date_sub("end", 1))).alias("ending_inside"),
        F.count_if(last.isNull() | (last < F.col("start"))).alias("ending_before"),
        F.min("last_day").alias("earliest_end"),
    )
    return out.withColumn("loaded", F.col("feeds") > F.col("ending_before"))
