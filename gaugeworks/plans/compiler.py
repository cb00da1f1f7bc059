"""Requests to DataFrame plans.

An entity becomes a frame with a column `entity__member` for each member, so names never clash behind
joins and Catalyst prunes what a request does not use. Metrics of a request come from one entity; other
entities are reached over declared joins that cannot multiply its rows.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gaugeworks.functions.predicates import bucket, predicate, window
from gaugeworks.model import Filter, Metric, Model, ModelError, Request, placeholders

Tables = Callable[[str], DataFrame]


def _col(entity: str, member: str) -> Column:
    return F.col(f"{entity}__{member}")


_MEETS = {"=": Column.__eq__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def _meets(a: Column, op: str, b: Column) -> Column:
    if op not in _MEETS:
        raise ModelError(f"a join has no operator {op}")
    return _MEETS[op](a, b)


class Plan:
    """One request over one model; `frame()` is its result."""

    def __init__(self, model: Model, tables: Tables, request: Request):
        self.model, self.tables, self.request = model, tables, request
        owners = {model.metric(m)[0] for m in request.metrics}
        owners |= {model.metric(o)[0] for m in request.metrics for o in model.operands(m)}
        if len(owners) > 1:
            raise ModelError(f"metrics of several entities: {', '.join(sorted(owners))}")
        if request.metrics and request.fields:
            raise ModelError("fields list rows; metrics do not go with them")
        first = [*request.fields, *request.dimensions]
        if not owners and not first:
            raise ModelError("nothing is asked for")
        self.base = owners.pop() if owners else model.member(first[0])[0]
        self.leaves = {o: model.metric(o)[1] for m in request.metrics for o in model.operands(m)}
        self.clock = self._clock()
        self._check()

    def _clock(self) -> str:
        clocks = {m.clock or self.model.entities[self.base].clock for m in self.leaves.values()} - {""}
        if len(clocks) > 1 and self.request.grain:
            raise ModelError(f"metrics on different clocks have no common time buckets: {', '.join(sorted(clocks))}")
        if len(clocks) == 1:
            return clocks.pop()
        return self.model.entities[self.base].clock

    def _check(self) -> None:
        r = self.request
        levels = {m.level for m in self.leaves.values()}
        if len(levels) > 1 and not self._weighted():
            raise ModelError("a level and a flow in one request: ask for them apart")
        if len({m.snapshot for m in self.leaves.values() if m.level}) > 1:
            raise ModelError("levels with different snapshots in one request")
        labels = [x.rpartition(".")[2] for x in (*r.dimensions, *r.fields, *r.metrics)]
        if len(labels) > len(set(labels)):
            raise ModelError("two columns of one name: " + ", ".join(sorted({x for x in labels if labels.count(x) > 1})))
        if (r.grain or r.window) and not self.clock:
            raise ModelError(f"{self.base} has no clock")
        pinned = {self.model.member(f.member, self.base) for f in r.filters if f.op in ("=", "equals", "in") and _single(f.value)}
        pinned |= {self.model.member(d, self.base) for d in r.dimensions}
        for name, m in self.leaves.items():
            own = {self.model.member(f.member, self.base) for f in m.filters if f.op in ("=", "equals")}
            loose = [x for x in m.must_pin if self.model.member(x, self.base) not in pinned | own]
            if loose:
                raise ModelError(f"{name} mixes values of {', '.join(loose)}: filter or group by it")

    def _weighted(self) -> bool:
        """Whether only ratios weighted by the period, which mix a flow and a level, are asked for."""
        return bool(self.request.metrics) and all(self.model.metric(m)[1].weight for m in self.request.metrics)

    def _members(self) -> list[tuple[str, str]]:
        r = self.request
        names = [*r.dimensions, *r.fields, *(f.member for f in r.filters)]
        names += [f.member for m in self.leaves.values() for f in m.filters]
        names += [k for m in self.leaves.values() for k in m.keys]
        aliases = {*(m.rpartition(".")[2] for m in r.metrics), *(d.rpartition(".")[2] for d in (*r.dimensions, *r.fields)), self.bucket_name}
        loose = [o for o, _ in r.order if o not in aliases]
        if loose and not r.fields:
            raise ModelError(f"order by what is asked for: {', '.join(loose)} is not")
        return [self.model.member(n, self.base) for n in [*names, *loose]] + [(e, "") for e, _ in self._definitions()]

    def _definitions(self) -> list[tuple[str, str]]:
        return [self.model.definition(d, self.base) for d in self.request.definitions]

    @property
    def bucket_name(self) -> str:
        return f"{self.clock}_{self.request.grain}" if self.request.grain else ""

    def _entity(self, name: str) -> DataFrame:
        entity = self.model.entities[name]
        cols = [F.expr(e).alias(f"{name}__{m}") for m, e in entity.members.items()]
        for of, condition in self._definitions():
            if of == name:
                cols.append(F.expr(condition).alias(f"{name}__is {condition}"))
        if entity.population:
            cols.append(F.expr(entity.population).alias(f"{name}__population"))
        if name == self.base:
            cols += [F.expr(m.expr).alias(f"value__{o}") for o, m in self.leaves.items()]
        return self.tables(entity.table).select(*cols)

    def joined(self) -> DataFrame:
        """Base rows with every member that the request names; populations hold for all joined entities."""
        df, have, self.keeps = self._entity(self.base), [self.base], True
        for entity in dict.fromkeys(e for e, _ in self._members()):
            for owner, join, forwards in self.model.path(self.base, entity):
                to = join.role or join.to
                new = to if forwards else owner
                if new in have:
                    continue
                have.append(new)
                on = [_meets(_col(owner, x[0]), x[1] if len(x) == 3 else "=", _col(to, x[-1])) for x in join.on]
                df = df.join(self._entity(new), on, join.how)
                self.keeps = self.keeps and join.how == "left" and not self.model.entities[new].population
        for entity in have:
            if self.model.entities[entity].population:
                df = df.where(F.col(f"{entity}__population"))
        return df

    def _clocked(self, df: DataFrame, windowed: bool) -> DataFrame:
        """Rows to find a snapshot in: the base table alone, if the joins keep all of its rows, else df."""
        if not self.keeps:
            return df
        rows = self._entity(self.base)
        if self.model.entities[self.base].population:
            rows = rows.where(F.col(f"{self.base}__population"))
        return rows.where(self._in_window(rows, self.clock)) if windowed else rows

    def _holds(self, df: DataFrame, f: Filter) -> Column:
        entity, member = self.model.member(f.member, self.base)
        return predicate(_col(entity, member), df.schema[f"{entity}__{member}"].dataType, f.op, f.value, self.model.timezone)

    def _in_window(self, df: DataFrame, clock: str) -> Column:
        return window(_col(self.base, clock), df.schema[f"{self.base}__{clock}"].dataType, *self.request.window, self.model.timezone)

    def _bucket(self, df: DataFrame) -> Column:
        return bucket(_col(self.base, self.clock), self.request.grain, df.schema[f"{self.base}__{self.clock}"].dataType, self.model.timezone)

    def frame(self) -> DataFrame:
        r, df = self.request, self.joined()
        own_clocks = {m.clock or self.clock for m in self.leaves.values()}
        lifted = r.window is not None and len(own_clocks) > 1
        if r.window and not lifted:
            df = df.where(self._in_window(df, self.clock))
        levels = [m for m in self.leaves.values() if m.level]
        mixed = len(levels) < len(self.leaves)
        if levels and mixed:
            snap = self._clocked(df, r.window is not None and not lifted).agg((F.min if levels[0].snapshot == "first" else F.max)(_col(self.base, self.clock)).alias("snapshot at"))
            df = df.crossJoin(F.broadcast(snap))  # one row
        elif levels and self._pinned(levels):
            df = self._at_snapshot(df, levels[0].snapshot, r.window is not None and not lifted)
        for f in r.filters:
            df = df.where(self._holds(df, f))
        for entity, condition in self._definitions():
            name = f"{entity}__is {condition}"
            if df.schema[name].dataType != BooleanType():
                raise ModelError(f"a definition is a condition, not a value: {condition}")
            df = df.where(F.col(f"`{name}`"))
        df = self._narrowed(df)
        keys = [_col(*self.model.member(d, self.base)).alias(d.rpartition(".")[2]) for d in r.dimensions]
        if r.grain:
            keys.insert(0, self._bucket(df).alias(self.bucket_name))
        if r.fields or not r.metrics:
            fields = [_col(*self.model.member(x, self.base)).alias(x.rpartition(".")[2]) for x in r.fields]
            labels = {d.rpartition(".")[2] for d in (*r.dimensions, *r.fields)} | {self.bucket_name}
            hidden = [(o, f"order by {o}") for o, _ in r.order if o not in labels]
            rows = df.select(*keys, *fields, *[_col(*self.model.member(o, self.base)).alias(h) for o, h in hidden])
            if not r.fields:
                rows = rows.distinct()
            return self.cut(rows, dict(hidden)).drop(*[h for _, h in hidden])
        for entity, member in [self.model.member(d, self.base) for d in r.dimensions]:
            if member in self.model.entities[entity].labels:
                keys.append(_col(entity, self.model.entities[entity].labels[member]))
        named = [f"key__{k}" for k in range(len(keys))]
        df = df.select("*", *[k.alias(n) for k, n in zip(keys, named)])
        aggs = []
        for name, m in self.leaves.items():
            cond = [self._holds(df, f) for f in m.filters]
            if m.level and mixed:
                cond.append(_col(self.base, self.clock) == F.col("snapshot at"))
            if lifted:
                cond.append(self._in_window(df, m.clock or self.clock))
            df, agg = self._leaf(df, name, m, cond, named)
            aggs.append(agg.alias(f"leaf__{name}"))
        out = df.groupBy(*named).agg(*aggs) if named else df.agg(*aggs)
        labels = [*([self.bucket_name] if r.grain else []), *(d.rpartition(".")[2] for d in r.dimensions)]
        return self.cut(
            out.select(*[F.col(n).alias(x) for n, x in zip(named, labels)], *[self._value(m).alias(m.rpartition(".")[2]) for m in r.metrics])
        )

    def _leaf(self, df: DataFrame, name: str, m: Metric, cond: list[Column], keys: list[str]) -> tuple[DataFrame, Column]:
        value = F.col(f"`value__{name}`")
        ok = F.lit(True)
        for c in cond:
            ok = ok & c
        if m.agg == "sum_distinct_on":
            # One value for each key inside each output group; rows that the metric's own filter keeps come first.
            by = [*keys, *[f"{e}__{k}" for e, k in (self.model.member(k, self.base) for k in m.keys)]]
            nth = F.row_number().over(W.partitionBy(*by).orderBy(F.when(ok, 0).otherwise(1), value.asc_nulls_last()))
            df = df.withColumn(f"nth__{name}", nth)
            return df, F.sum(F.when((F.col(f"`nth__{name}`") == 1) & ok, value))
        value = F.when(ok, value) if cond else value
        aggs = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
        if m.agg not in aggs:
            raise ModelError(f"unknown aggregate {m.agg}")
        return df, aggs[m.agg](value)

    def _value(self, name: str) -> Column:
        entity, m = self.model.metric(name)
        if m.agg == "ratio" and m.weight:
            if self.request.window is None or self.request.grain:
                raise ModelError(f"{name} needs a window with both ends and no grain: its level is weighted by the window's {m.weight}")
            days = (date.fromisoformat(self.request.window[1][:10]) - date.fromisoformat(self.request.window[0][:10])).days
            weight = days / 7.0 if m.weight == "weeks" else float(days)
            return self._value(m.num).cast("double") / F.nullif(self._value(m.den).cast("double") * F.lit(weight), F.lit(0.0))
        if m.agg == "ratio":
            return self._value(m.num).cast("double") / F.nullif(self._value(m.den).cast("double"), F.lit(0.0))
        if m.agg == "derived":
            parts = placeholders(m.formula)
            text = m.formula
            for k, part in enumerate(parts):
                text = text.replace("{" + part + "}", f"p{k}")
            return _arithmetic(text, {f"p{k}": self._value(part) for k, part in enumerate(parts)})
        return F.col(f"`leaf__{entity}.{name.rpartition('.')[2]}`")

    def _at_snapshot(self, df: DataFrame, which: str, windowed: bool) -> DataFrame:
        """Rows at the last (or first) moment of the clock under window and populations, in each bucket if there is one.

        The request's other filters do not move the snapshot.
        """
        at = _col(self.base, self.clock)
        if self.model.entities[self.base].clock_is_day:
            at = at.cast("date")
        pick = (F.min if which == "first" else F.max)(at).alias("at")
        rows = self._clocked(df, windowed)
        own = [self._bucket(df)] if self.request.grain else []
        for d in self.request.dimensions:
            entity, member = self.model.member(d, self.base)
            if entity == self.base and member in self.model.entities[entity].dates and member != self.clock:
                own.append(_col(entity, member))
        if not own:
            return df.join(F.broadcast(rows.agg(pick)), at == F.col("at")).drop("at")  # one row
        names = [f"of {k}" for k in range(len(own))]
        snaps = rows.groupBy(*[c.alias(n) for c, n in zip(own, names)]).agg(pick)
        on = at == F.col("at")
        for c, n in zip(own, names):
            on = on & (c == F.col(f"`{n}`"))
        return df.join(snaps, on).drop(*names, "at")

    def _pinned(self, levels: list[Metric]) -> bool:
        """Whether levels are read at a snapshot: not those counted over any in a stated window, nor without a window where rows are written once."""
        loose = {m.any_in_window and self.request.window is not None for m in levels}
        if len(loose) > 1:
            raise ModelError("levels with different window readings in one request")
        if loose == {True}:
            return False
        return self.request.window is not None or bool(self.request.grain) or not self.model.entities[self.base].created_once

    def _narrowed(self, df: DataFrame) -> DataFrame:
        """df without the rows that no metric counts, if every group has a row of each metric's anyway: only for one total.

        A filter that all metrics share then reaches the scan.
        """
        if self.request.grain or self.request.dimensions or not self.leaves:
            return df
        shared = set.intersection(*[set(map(repr, m.filters)) for m in self.leaves.values()])
        for f in next(iter(self.leaves.values())).filters:
            if repr(f) in shared:
                df = df.where(self._holds(df, f))
        return df

    def cut(self, df: DataFrame, hidden: dict[str, str] = {}) -> DataFrame:
        r = self.request
        if r.order:
            by = [(F.col(f"`{hidden.get(o, o)}`"), d) for o, d in r.order]
            df = df.orderBy(*[c.desc_nulls_last() if d == "desc" else c.asc_nulls_last() for c, d in by])
        if r.offset:
            df = df.offset(r.offset)
        return df if r.limit is None else df.limit(r.limit)


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def _arithmetic(text: str, cols: dict[str, Column]) -> Column:
    """A formula of + - * / over named columns; division gives a double, and null where it divides by 0."""

    def walk(node):
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Div):
            return walk(node.left).cast("double") / F.nullif(walk(node.right).cast("double"), F.lit(0.0))
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Name) and node.id in cols:
            return cols[node.id]
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(node.value)
        raise ModelError(f"a formula has numbers, metrics and + - * / only: {text}")

    return walk(ast.parse(text, mode="eval").body)


def _single(value) -> bool:
    return not isinstance(value, (list, tuple)) or len(value) == 1


def answer(model: Model, tables: Tables, request: Request) -> DataFrame:
    return Plan(model, tables, request).frame()
