"""Checks of an answer after it was computed, in a fixed order: nothing found, window not loaded, nameless groups, ties at the cut."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.model import Model, Request
from gaugeworks.operators.results import without_null_buckets
from gaugeworks.plans.compiler import Plan, Tables


def post_checks(model: Model, tables: Tables, request: Request) -> DataFrame:
    """(nth, check, verdict, detail) of a request's answer; a check that does not apply is ok.

    empty_result: rows of the answer before its limit; empty without rows. window: days of the window that no data
    reach; unloaded if none is reached, else partly. null_bucket: groups among the ranked ones with a dimension that is
    null or empty text. tie_at_limit: rows beyond the limit that tie with the last one inside.
    """
    plan = Plan(model, tables, request)
    whole = Plan(model, tables, replace(request, order=(), limit=None, offset=0)).frame()
    facts = whole.agg(F.count(F.lit(1)).alias("rows"))
    none = F.lit(0).cast("long")
    if request.order and request.limit is not None:
        by = [F.col(f"`{o}`").desc_nulls_last() if d == "desc" else F.col(f"`{o}`").asc_nulls_last() for o, d in request.order]
        most = request.limit + request.offset
        # A task passes on only what ranks within the limit, and ties.
        ranked = whole.withColumn("place", F.rank().over(W.orderBy(*by))).where(F.col("place") <= most)
        labels = [d.rpartition(".")[2] for d in request.dimensions]
        nameless = without_null_buckets(ranked, labels)[1].agg(F.count(F.lit(1)).alias("nameless"))
        tied = ranked.agg(F.greatest(F.count(F.lit(1)) - most, none).alias("tied"))
        facts = facts.crossJoin(nameless).crossJoin(tied)  # one row each
    else:
        facts = facts.select("rows", none.alias("nameless"), none.alias("tied"))
    if request.window and plan.clock:
        entity = model.entities[plan.base]
        start, end = (F.lit(x).cast("date") for x in request.window)
        reach = tables(entity.table).agg(F.to_date(F.max(F.expr(entity.members[plan.clock]))).alias("data_end"))
        last, before = F.date_sub(end, 1), F.date_sub(start, 1)
        short = F.datediff(last, F.least(last, F.greatest(before, F.coalesce("data_end", before))))
        facts = facts.crossJoin(reach.select(short.cast("long").alias("short"), F.datediff(end, start).cast("long").alias("days")))
    else:
        facts = facts.select("*", none.alias("short"), F.lit(1).cast("long").alias("days"))
    rows = [
        ("empty_result", F.when(F.col("rows") == 0, "empty"), "rows"),
        ("window", F.when(F.col("short") >= F.col("days"), "unloaded").when(F.col("short") > 0, "partly"), "short"),
        ("null_bucket", F.when(F.col("nameless") > 0, "nameless"), "nameless"),
        ("tie_at_limit", F.when(F.col("tied") > 0, "tied"), "tied"),
    ]
    each = [
        F.struct(F.lit(k).alias("nth"), F.lit(name).alias("check"), F.coalesce(verdict, F.lit("ok")).alias("verdict"), F.col(detail).alias("detail"))
        for k, (name, verdict, detail) in enumerate(rows, 1)
    ]
    return facts.select(F.inline(F.array(*each)))
