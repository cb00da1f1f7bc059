"""Monitoring of feeds: where data end, feeds that stopped, periods that are only partly loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The partial-period rule.
PARTIAL_RATIO, TRAILING, MIN_HISTORY, MIN_MEDIAN = 0.70, 6, 6, 20.0


def data_ends(df: DataFrame, clock: str, feeds: list[str]) -> DataFrame:
    """Per feed: rows, first and last day, and the last day of all feeds."""
    day = F.to_date(clock)
    per = df.groupBy(*feeds).agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return per.crossJoin(F.broadcast(df.agg(F.max(day).alias("data_end"))))  # one row


def stopped_feeds(df: DataFrame, clock: str, feeds: list[str], days: int) -> DataFrame:
    """Feeds that end more than `days` before the data do."""
    return data_ends(df, clock, feeds).where(F.datediff("data_end", "last_day") > days)


def monthly(df: DataFrame, clock: str, feeds: list[str], value: str = "1") -> DataFrame:
    """(feeds, month, value): sums per month on a gap-free spine from each feed's first month to the last of all data."""
    month = F.trunc(F.to_date(clock), "month")
    sums = df.select(*feeds, month.alias("month"), F.expr(value).alias("v")).where("month is not null").groupBy(*feeds, "month").agg(F.sum("v").cast("double").alias("value"))
    names = [f"s {f}" for f in feeds]
    span = sums.groupBy(*[F.col(f).alias(n) for f, n in zip(feeds, names)]).agg(F.min("month").alias("from"))
    last = F.broadcast(sums.agg(F.max("month").alias("to")))  # one row
    spine = span.crossJoin(last).select(*names, F.explode(F.expr("sequence(`from`, `to`, interval 1 month)")).alias("s month"))
    on = F.col("month") == F.col("s month")
    for f, n in zip(feeds, names):
        on = on & F.col(f).eqNullSafe(F.col(n))
    out = spine.join(sums, on, "left")
    return out.select(*[F.col(n).alias(f) for f, n in zip(feeds, names)], F.col("s month").alias("month"), F.coalesce("value", F.lit(0.0)).alias("value"))


def partial_periods(months: DataFrame, month: str, value: str, feeds: list[str] = (), data_end: str | None = None) -> DataFrame:
    """Monthly values of a gap-free spine with `partial`: low against the months before, as far as these are enough.

    A month is partial if it is below PARTIAL_RATIO of the median of the TRAILING months before and below all
    of the feed's months before; with data_end, the median is pro-rated to the days that the last month has so
    far. A month that was as low a year before is a season, not a partial load; feeds with a negative value
    have no low months. The rows are one per feed and month, so a window holds a feed's months only.
    """
    w = W.partitionBy(*feeds).orderBy(month)
    before, ever = w.rowsBetween(-TRAILING, -1), w.rowsBetween(W.unboundedPreceding, -1)
    out = months.withColumn("trailing_median", F.expr(f"percentile({value}, 0.5)").over(before))
    out = out.withColumn("history", F.count(value).over(before)).withColumn("year_ago", F.lag(value, 12).over(w))
    out = out.withColumn("year_ago_median", F.lag("trailing_median", 12).over(w)).withColumn("least_before", F.min(value).over(ever))
    out = out.withColumn("least_ever", F.min(value).over(W.partitionBy(*feeds)))
    part = F.lit(1.0)
    if data_end is not None:
        end = F.lit(data_end).cast("date")
        covered = F.datediff(end, F.col(month)) + 1
        part = F.when(covered < F.dayofmonth(F.last_day(month)), F.greatest(covered, F.lit(0)) / F.dayofmonth(F.last_day(month))).otherwise(1.0)
    low = (F.col(value) < PARTIAL_RATIO * F.col("trailing_median") * part) & (F.col(value) < F.col("least_before"))
    enough = (F.col("history") >= MIN_HISTORY) & (F.col("trailing_median") >= MIN_MEDIAN) & (F.col("least_ever") >= 0)
    seasonal = F.coalesce(F.col("year_ago") < PARTIAL_RATIO * F.col("year_ago_median"), F.lit(False))
    return out.withColumn("partial", F.coalesce(low & enough & ~seasonal, F.lit(False))).drop("least_before", "least_ever")


def load_evidence(df: DataFrame, clock: str, feeds: list[str], data_end: str) -> DataFrame:
    """Per feed in data_end's month: rows of the last 7 days, rows per day of either half of the days so far, and the signs of a load that stopped.

    open_period: the month has not ended; no_recent_rows: none in the last 7 days; slowed: the second half's
    daily rate is below PARTIAL_RATIO of the first's.
    """
    end, day = F.lit(data_end).cast("date"), F.to_date(clock)
    start = F.trunc(end, "month")
    half = F.floor((F.datediff(end, start) + 1) / 2).cast("int")
    split = F.date_add(start, half)
    per = df.groupBy(*feeds).agg(
        F.max(day).alias("last_day"),
        F.count_if((day > F.date_sub(end, 7)) & (day <= end)).alias("recent_rows"),
        (F.count_if((day >= start) & (day < split)) / F.nullif(half, F.lit(0))).alias("first_rate"),
        (F.count_if((day >= split) & (day <= end)) / (F.datediff(end, split) + 1)).alias("second_rate"),
    )
    return per.withColumns({
        "open_period": end < F.last_day(end),
        "no_recent_rows": F.col("recent_rows") == 0,
        "slowed": F.coalesce(F.col("second_rate") < PARTIAL_RATIO * F.col("first_rate"), F.lit(False)),
    })


def stale(df: DataFrame, clock: str, due: str, grain: str = "day") -> DataFrame:
    """One row: the clock's end and whether it is before the due day; at month grain, before the last complete month."""
    end, day = F.max(F.to_date(clock)), F.lit(due).cast("date")
    bound = F.add_months(F.trunc(day, "month"), -1) if grain == "month" else day
    row = df.agg(end.alias("clock_end"))
    return row.withColumn("due", bound).withColumn("stale", F.coalesce(F.col("clock_end") < F.col("due"), F.lit(True)))


def judged_feeds(verdicts: DataFrame, measures: DataFrame, feeds: list[str]) -> DataFrame:
    """Partial verdicts (clock, feeds, month, partial) carried to every measure (measure, clock) of the same clock."""
    bad = verdicts.where("partial").select("clock", *feeds, "month").distinct()
    return measures.join(bad, "clock").select("measure", "clock", *feeds, "month")
