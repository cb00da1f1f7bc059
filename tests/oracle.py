"""Compares a registered query with its SQL in DuckDB over the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    return tuple(value(x) for x in v) if isinstance(v, (list, tuple)) else v


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cols = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(value(r[i]) for i in at) for r in got.fetchall()), key=repr)
    have = sorted((tuple(value(v) for v in r) for r in df.select(*[df[c] for c in cols]).collect()), key=repr)
    assert have == want
