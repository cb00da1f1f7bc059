"""Reports over a ledger of requests: counts, shares, statements against the window before, rolling quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(clock: str) -> Column:
    """Whole seconds since 1970 of a moment as written, whatever the session's zone."""
    return F.expr(f"datediff(`{clock}`, date'1970-01-01') * 86400L + hour(`{clock}`) * 3600 + minute(`{clock}`) * 60 + int(second(`{clock}`))")


def shares(df: DataFrame, by: list[str], caller: str) -> DataFrame:
    """Per group: requests, distinct callers and the group's share of all requests."""
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_distinct(caller).alias("callers"))
    total = per.agg(F.sum("requests").alias("total"))
    return per.join(F.broadcast(total)).withColumn("share", F.col("requests") / F.col("total")).drop("total")  # one row


def statement(df: DataFrame, by: list[str], clock: str, start: str, end: str) -> DataFrame:
    """Per group: requests of [start, end) and of the window of the same length before it, from one pass."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    day, before = F.to_date(clock), F.date_sub(a, F.datediff(b, a))
    now, then = (day >= a) & (day < b), (day >= before) & (day < a)
    out = df.where(now | then).groupBy(*by).agg(F.count_if(now).alias("requests"), F.count_if(then).alias("requests_before"))
    return out.withColumn("delta", F.col("requests") - F.col("requests_before"))


def rolling_use(df: DataFrame, caller: str, clock: str, span: int, quota: int) -> DataFrame:
    """Per caller and second: requests of the last `span` seconds, this one included, and whether they exceed the quota.

    Requests are counted per second first. Time is cut into blocks of one span, each of which sees the
    block before it, so a window never holds more than two spans of seconds, however busy a caller is.
    Rows without a moment count nowhere; a null caller is a caller.
    """
    per = df.select(F.col(caller), seconds(clock).alias("second")).where("second is not null").groupBy(caller, "second").agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("second") / F.lit(span))
    seen = per.select("*", block.alias("home"), F.explode(F.array(block, block + 1)).alias("block"))
    w = W.partitionBy(caller, "block").orderBy("second").rangeBetween(-(span - 1), 0)
    out = seen.withColumn("used", F.sum("n").over(w)).where("home = block")
    return out.select(caller, "second", "n", "used", (F.col("used") > quota).alias("over"))
