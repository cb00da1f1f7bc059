"""Filters as Spark predicates; bounds on a day stay ranges that reach the scan."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from gaugeworks.model import ModelError

_COMPARE = {
    "=": Column.__eq__, "equals": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, "gt": Column.__gt__,
    ">=": Column.__ge__, "gte": Column.__ge__, "<": Column.__lt__, "lt": Column.__lt__, "<=": Column.__le__, "lte": Column.__le__,
}


_WALL_CLOCK = re.compile(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?")


def _is_day(value) -> bool:
    return isinstance(value, str) and len(value) == 10 and value[4] == value[7] == "-"


def bound(value, kind: DataType, zone: str = "") -> Column:
    """The value as a literal of the type; a wall-clock text beside zoned moments is one of the zone, if one is named."""
    if zone and isinstance(kind, TimestampType) and isinstance(value, str) and _WALL_CLOCK.fullmatch(value):
        return F.lit(f"{datetime.fromisoformat(value).isoformat(' ', 'microseconds')} {zone}").cast(kind)
    return F.lit(value).cast(kind)


def predicate(column: Column, kind: DataType, op: str, value, zone: str = "") -> Column:
    """The condition `column op value`, the value cast to the column's type.

    A day compared with a moment stands for the whole day, in the zone if one is named.
    """
    lit = lambda v: bound(v, kind, zone)
    many = list(value) if isinstance(value, (list, tuple)) else [value]
    after = lambda v: lit(str(date.fromisoformat(v) + timedelta(days=1)))
    moment = isinstance(kind, (TimestampType, TimestampNTZType))
    if op == "set":
        return column.isNotNull()
    if op == "notSet":
        return column.isNull()
    if op in ("in", "equals") and len(many) != 1:
        return column.isin([lit(v) for v in many])
    if op == "notEquals":
        given = [v for v in many if v is not None]
        others = ~column.isin([lit(v) for v in given]) if given else F.lit(True)
        return column.isNotNull() & others if len(given) < len(many) else column.isNull() | others
    if op == "like":
        return column.like(many[0])
    if op == "contains":
        return reduce(Column.__or__, [F.contains(F.lower(column), F.lower(F.lit(v))) for v in many])
    if op == "inDateRange":
        start, end = many[0], many[-1]
        return (column >= lit(start)) & ((column < after(end)) if moment and _is_day(end) else column <= lit(end))
    if op in ("beforeDate", "beforeOrOnDate", "afterDate", "afterOrOnDate"):
        op = {"beforeDate": "<", "beforeOrOnDate": "<=", "afterDate": ">", "afterOrOnDate": ">="}[op]
    if len(many) != 1:
        raise ModelError(f"{op} takes one value, not {len(many)}")
    one = many[0]
    if moment and _is_day(one):
        if op in ("=", "equals", "in"):
            return (column >= lit(one)) & (column < after(one))
        if op == "!=":
            return (column < lit(one)) | (column >= after(one))
        if op in ("<=", "lte"):
            return column < after(one)
        if op in (">", "gt"):
            return column >= after(one)
    if op == "in":
        op = "="
    if op not in _COMPARE:
        raise ModelError(f"unknown operator {op}")
    return _COMPARE[op](column, lit(one))


def window(column: Column, kind: DataType, start: str, end: str, zone: str = "") -> Column:
    """start <= column < end."""
    return (column >= bound(start, kind, zone)) & (column < bound(end, kind, zone))


def bucket(column: Column, grain: str, kind: DataType | None = None, zone: str = "") -> Column:
    """Start of the grain's period, of the zone's wall clock for zoned moments; a date from day upwards."""
    if zone and isinstance(kind, TimestampType):
        column = F.convert_timezone(F.current_timezone(), F.lit(zone), column.cast("timestamp_ntz"))
    out = F.date_trunc(grain, column)
    return out if grain in ("hour", "minute", "second") else out.cast(DateType())
