"""Period comparison: one request over two windows, joined on its dimensions and the shifted bucket."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.model import Model, ModelError, Request
from gaugeworks.plans.compiler import Plan, Tables


def _months(start: date, end: date) -> int | None:
    """Whole months between two month starts, else None."""
    if start.day == end.day == 1:
        return (end.year - start.year) * 12 + end.month - start.month
    return None


def _shift(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 + months
    last = (date((at + 1) // 12, (at + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(at // 12, at % 12 + 1, min(day.day, last))


def _named_period(text: str) -> tuple[date, date] | None:
    """The window of YYYY or YYYY-MM."""
    if len(text) == 4 and text.isdigit():
        return date(int(text), 1, 1), date(int(text) + 1, 1, 1)
    if len(text) == 7 and text[4] == "-" and text.replace("-", "").isdigit():
        start = date(int(text[:4]), int(text[5:]), 1)
        return start, _shift(start, 1)
    return None


def _whole(start: date, end: date, grain: str) -> bool:
    """Whether a window is whole buckets of the grain."""
    size = {"month": 1, "quarter": 3, "year": 12}.get(grain)
    if size is None:
        return True
    months = _months(start, end)
    return bool(months) and months % size == 0 and (start.month - 1) % size == 0


def earlier(window: tuple[str, str], to: str, grain: str = "") -> tuple[tuple[str, str], str]:
    """The window that `to` names, and the interval by which its buckets move forward.

    to: previous_period (by months if the window is whole months, else by days), previous_year (364
    days at week grain, so that weekdays meet), an explicit "start/end", a year YYYY or a month YYYY-MM.
    """
    start, end = (date.fromisoformat(x[:10]) for x in window)
    if not _whole(start, end, grain):
        raise ModelError(f"the window {start} to {end} is not whole {grain}s")
    if to == "previous_year":
        if grain == "week":
            step = timedelta(days=364)
            return (str(start - step), str(end - step)), "interval 364 days"
        return (str(_shift(start, -12)), str(_shift(end, -12))), "interval 12 months"
    if to == "previous_period":
        months = _months(start, end)
        if months:
            return (str(_shift(start, -months)), str(start)), f"interval {months} months"
        days = (end - start).days
        if grain in ("month", "quarter", "year") or grain == "week" and days % 7:
            raise ModelError(f"a window of {days} days is not whole {grain}s")
        return (str(start - timedelta(days=days)), str(start)), f"interval {days} days"
    if (named := _named_period(to)) is not None:
        to = f"{named[0]}/{named[1]}"
    a, sep, b = to.partition("/")
    if not sep:
        raise ModelError(f"unknown comparison {to}")
    months = _months(date.fromisoformat(a), start)
    if grain in ("month", "quarter", "year") and months is None:
        raise ModelError(f"the windows are not whole {grain}s apart")
    return (a, b), f"interval {months} months" if months is not None else f"interval {(start - date.fromisoformat(a)).days} days"


def compare(model: Model, tables: Tables, request: Request, to: str) -> DataFrame:
    """Columns m, m_compare, m_delta and m_delta_pct for each metric; groups of either window are kept."""
    if request.window is None:
        raise ModelError("a comparison needs a window with both ends")
    before, step = earlier(request.window, to, request.grain)
    bare = replace(request, order=(), limit=None, offset=0)
    plan = Plan(model, tables, bare)
    now, then = plan.frame(), Plan(model, tables, replace(bare, window=before)).frame()
    names = [m.rpartition(".")[2] for m in request.metrics]
    keys = [c for c in now.columns if c not in names]
    if plan.bucket_name:
        moved = (F.col(plan.bucket_name) + F.expr(step)).cast(now.schema[plan.bucket_name].dataType)
        then = then.withColumn(plan.bucket_name, moved)
    then = then.withColumnsRenamed({c: f"then__{c}" for c in then.columns})
    if keys:
        out = now.join(then, [F.col(k).eqNullSafe(F.col(f"then__{k}")) for k in keys], "full")
        out = out.withColumns({k: F.coalesce(k, f"then__{k}") for k in keys})
    else:
        out = now.join(F.broadcast(then), how="cross")  # one row each
    for m in names:
        out = out.withColumnRenamed(f"then__{m}", f"{m}_compare")
        out = out.withColumn(f"{m}_delta", F.col(m) - F.col(f"{m}_compare"))
        base = F.abs(F.col(f"{m}_compare")).cast("double")
        out = out.withColumn(f"{m}_delta_pct", F.col(f"{m}_delta").cast("double") / F.nullif(base, F.lit(0.0)))
    out = out.select(*keys, *[x for m in names for x in (m, f"{m}_compare", f"{m}_delta", f"{m}_delta_pct")])
    return Plan(model, tables, request).cut(out)
