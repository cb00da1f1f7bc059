"""Doors for callers: dry runs, bounded pages, batches with isolated failures, certified templates and ad-hoc probes."""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.model import Filter, Model, ModelError, Request
from gaugeworks.plans.compiler import Tables, answer

# Limits of the doors.
PAGE_ROWS, BATCH_MOST, PROBE_ROWS, PROBE_MOST = 1000, 50, 20, 500


@dataclass(frozen=True)
class DryRun:
    """What a request would give, without running it: columns, and the bytes that the optimizer expects to read."""

    columns: list[tuple[str, str]]
    scan_bytes: int


def dry_run(df: DataFrame, most_bytes: int | None = None) -> DryRun:
    """Analyses and plans df; refused if its scans are expected to read more than most_bytes."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    scan = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if most_bytes is not None and scan > most_bytes:
        raise ModelError(f"the request would read {scan} bytes; {most_bytes} are allowed")
    return DryRun(df.dtypes, scan)


def page(df: DataFrame, most: int = PAGE_ROWS) -> tuple[list, bool]:
    """The first rows for a caller, and whether there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def batch(model: Model, tables: Tables, requests: list[Request], most: int = PAGE_ROWS) -> list[tuple[list | None, str]]:
    """(rows, error) of each request, at most BATCH_MOST; one that fails leaves the others alone.

    A table is resolved once for the whole batch, so all requests see the same files.
    """
    if len(requests) > BATCH_MOST:
        raise ModelError(f"{len(requests)} requests; a batch has {BATCH_MOST} at most")
    seen: dict[str, DataFrame] = {}

    def snapshot(name: str) -> DataFrame:
        if name not in seen:
            seen[name] = tables(name)
        return seen[name]

    out = []
    for request in requests:
        try:
            out.append((page(answer(model, snapshot, request), most)[0], ""))
        except Exception as e:  # any failure is this request's own
            out.append((None, str(e).splitlines()[0]))
    return out


_SLOTS = {
    "date": lambda v: date.fromisoformat(v),
    "number": lambda v: v if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v),
}


@dataclass(frozen=True)
class Template:
    """A certified query with named slots: kind is date, number, text or a list of the allowed values."""

    sql: str
    slots: dict[str, object]

    def bind(self, spark: SparkSession, tables: dict[str, DataFrame], given: dict) -> DataFrame:
        """The query with values as parameters, never as text of the query."""
        if set(given) != set(self.slots):
            raise ModelError(f"the template has the slots {', '.join(sorted(self.slots))}")
        args = {}
        for name, kind in self.slots.items():
            value = given[name]
            if isinstance(kind, (list, tuple)):
                if value not in kind:
                    raise ModelError(f"{name} is one of {', '.join(map(str, kind))}")
            elif kind in _SLOTS:
                try:
                    value = _SLOTS[kind](value)
                except (TypeError, ValueError) as e:
                    raise ModelError(f"{name} is a {kind}: {value!r}") from e
            elif kind != "text" or not isinstance(value, str):
                raise ModelError(f"{name} is {kind}: {value!r}")
            args[name] = value
        return spark.sql(self.sql, args=args, **tables)


def probe(spark: SparkSession, sql: str, rows: int = PROBE_ROWS, **tables: DataFrame) -> DataFrame:
    """An ad-hoc query's first rows, at most PROBE_MOST; reading only."""
    if not re.match(r"\s*(select|with|from|values)\b", sql, re.IGNORECASE):
        raise ModelError("a probe reads: it begins with SELECT, WITH, FROM or VALUES")
    return spark.sql(sql, **tables).limit(max(1, min(rows, PROBE_MOST)))


def tagged(spark: SparkSession, caller: str, request: Request) -> str:
    """Names the jobs that follow after caller and request, for query history; returns the request's digest."""
    digest = hashlib.sha256(repr(request).encode()).hexdigest()
    spark.sparkContext.setJobDescription(f"{caller} {digest[:16]}")
    return digest


def governed(model: Model, request: Request) -> Request:
    """The request without filters that its metrics set themselves to the same value; refused if they contradict.

    A condition that every metric has already would only be repeated; one that some metric sets to another
    value leaves that metric nothing to count.
    """
    leaves = [model.metric(o) for m in request.metrics for o in model.operands(m)]
    kept = []
    for f in request.filters:
        values = set(map(str, f.value if isinstance(f.value, (list, tuple)) else [f.value]))
        same = 0
        for base, m in leaves:
            own = [x for x in m.filters if x.op in ("=", "equals") and model.member(x.member, base) == model.member(f.member, base)]
            if f.op in ("=", "equals", "in") and own:
                if str(own[0].value) not in values:
                    raise ModelError(f"{f.member} is {own[0].value} for a metric that is asked for; {f.value} contradicts it")
                same += values == {str(own[0].value)}
        if not leaves or same < len(leaves):
            kept.append(f)
    return replace(request, filters=tuple(kept))


def with_period(model: Model, request: Request, today: date) -> Request:
    """A request for ratios only, without a window, over the last complete month: a ratio of all times tells little."""
    ratios = request.metrics and all(model.metric(m)[1].agg == "ratio" for m in request.metrics)
    clocked = ratios and all(model.metric(o)[1].clock or model.entities[model.metric(o)[0]].clock for m in request.metrics for o in model.operands(m))
    if not clocked or request.window or request.grain or any(isinstance(f, Filter) and f.op == "inDateRange" for f in request.filters):
        return request
    end = date(today.year, today.month, 1)
    start = date(end.year - (end.month == 1), (end.month - 2) % 12 + 1, 1)
    return replace(request, window=(str(start), str(end)))


def variants(request: Request, options: dict[str, list]) -> list[tuple[dict, Request]]:
    """(options chosen, request) for each combination of the values given for a request's fields, to be run or compared."""
    unknown = sorted(set(options) - set(Request.__dataclass_fields__))
    if unknown:
        raise ModelError(f"a request has no {', '.join(unknown)}")
    chosen = [dict(zip(options, values)) for values in itertools.product(*options.values())]
    return [(c, replace(request, **c)) for c in chosen]
