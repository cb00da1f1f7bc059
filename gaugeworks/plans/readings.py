"""What a request may mean: kinds of clocks, windows clipped to what can have happened, and readings compared."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.model import Model, ModelError, Request
from gaugeworks.plans.compiler import Plan, Tables, answer

# Words that tell dates of what has happened from dates of what is planned.
EVENT_WORDS = frozenset(
    "decided closed created paid sent ordered invoiced issued booked completed signed shipped delivered resolved submitted posted registered cancelled "
    "canceled refunded won lost approved received placed logged occurred recorded collected settled".split()
)
SCHEDULE_WORDS = frozenset(
    "due end ends planned plan scheduled expires expiry expiration expiring deadline renewal renews until forecast target budget".split()
)


def _kind_of_words(text: str) -> str:
    """The kind that the words tell; empty where they tell none or both."""
    found = set(re.split(r"[^a-z]+", text.lower()))
    kinds = [k for k, words in (("event", EVENT_WORDS), ("schedule", SCHEDULE_WORDS)) if found & words]
    return kinds[0] if len(kinds) == 1 else ""


def time_kind(df: DataFrame, clock: str, today: str, declared: str = "", about: str = "") -> str:
    """event or schedule: as declared, as the clock's name or else its description says, or schedule where a row lies after today.

    The data are asked only if words do not tell.
    """
    if declared not in ("", "event", "schedule"):
        raise ModelError(f"a clock is event or schedule, not {declared}")
    told = declared or _kind_of_words(clock) or _kind_of_words(about)
    return told or ("schedule" if _future(df, clock, today) else "event")


def _future(df: DataFrame, clock: str, today: str) -> bool:
    return not df.where(F.col(clock) >= F.lit(_day_after(today)).cast(df.schema[clock].dataType)).isEmpty()


def _day_after(day: str) -> str:
    return str(date.fromisoformat(day) + timedelta(days=1))


def clipped(model: Model, tables: Tables, request: Request, today: str, declared: str = "", about: str = "") -> Request:
    """The request with its window ended behind today, if its clock tells events and rows lie after today all the same.

    Windows on a schedule stay as they are: what is due can lie ahead.
    """
    if request.window is None or request.window[1] <= _day_after(today):
        return request
    plan = Plan(model, tables, request)
    entity = model.entities[plan.base]
    rows = tables(entity.table).select(F.expr(entity.members[plan.clock]).alias(plan.clock))
    if time_kind(rows, plan.clock, today, declared, about) == "schedule" or not _future(rows, plan.clock, today):
        return request
    return replace(request, window=(request.window[0], _day_after(today)))


def readings(model: Model, tables: Tables, given: dict[str, Request], default: str, tolerance: float = 0.005) -> DataFrame:
    """(reading, groups, differing, alike) of each other reading beside the default one.

    Every reading has one metric and the same dimensions. Groups of either side count; two values are alike when both
    are null or lie within the tolerance of the larger one, and a group that one side lacks differs. A reading all
    of whose groups are alike needs no question back.
    """
    shapes = {(r.dimensions, r.grain, len(r.metrics)) for r in given.values()}
    if len(shapes) != 1 or next(iter(shapes))[2] != 1:
        raise ModelError("readings have one metric each and the same groups")
    if default not in given or len(given) < 2:
        raise ModelError("readings are a default and others")

    def side(name: str, tag: str) -> DataFrame:
        frame = answer(model, tables, replace(given[name], order=(), limit=None, offset=0))
        *keys, value = frame.columns
        return frame.select(*[F.col(f"`{k}`").alias(f"{tag}{n}") for n, k in enumerate(keys)], F.col(f"`{value}`").cast("double").alias(f"{tag} value"), F.lit(True).alias(f"{tag} has"))

    own = side(default, "a")
    width = len(own.columns) - 2
    out = []
    for name in given:
        if name != default:
            on = [F.col(f"a{n}").eqNullSafe(F.col(f"b{n}")) for n in range(width)]
            both = own.join(side(name, "b"), on, "full") if on else own.crossJoin(side(name, "b"))  # one row each
            a, b = F.col("a value"), F.col("b value")
            near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
            same = F.col("a has") & F.col("b has") & (near | (a.isNull() & b.isNull()))
            counted = both.agg(F.count(F.lit(1)).alias("groups"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))
            out.append(counted.select(F.lit(name).alias("reading"), "groups", "differing", (F.col("differing") == 0).alias("alike")))
    return reduce(DataFrame.union, out)
