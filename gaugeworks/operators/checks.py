"""Checks of tables and results: grain, cardinality, containment, drift, equality, ranking, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grain(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys (a null is a value), rows without a full key."""
    full = [F.col(k).isNotNull() for k in key]
    ok = full[0]
    for c in full[1:]:
        ok = ok & c
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.struct(*key)).alias("keys"),
        F.count_if(~ok).alias("rows_without_key"),
    )


def grain_verdict(df: DataFrame, key: list[str], declared: str = "") -> DataFrame:
    """grain's counts with a verdict: one_per_key, repeats, contradicts (declared one per key, but repeats) or unverified (no rows)."""
    repeats = F.lit("contradicts" if declared == "one_per_key" else "repeats")
    verdict = F.when(F.col("rows") == 0, "unverified").when(F.col("keys") == F.col("rows"), "one_per_key").otherwise(repeats)
    return grain(df, key).withColumn("verdict", verdict)


def cardinality_verdict(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], declared: str) -> DataFrame:
    """cardinality's row with a verdict on the declared relationship: ok, wrong (another, and no more rows), unsafe (rows may multiply) or unreadable."""
    out = cardinality(left, right, pairs)
    claims_one = declared.endswith("_to_one")
    verdict = (
        F.when(F.expr("left_most = 0 or right_most = 0"), "unreadable")
        .when(F.lit(claims_one) & (F.col("right_most") > 1), "unsafe")
        .when(F.col("relationship") == declared, "ok")
        .when(F.lit(declared == "many_to_one") & (F.col("relationship") == "one_to_one"), "ok")
        .otherwise("wrong")
    )
    return out.withColumn("declared", F.lit(declared)).withColumn("verdict", verdict)


def join_hypotheses(tables: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, other column) pairs that may join: equal stems of key names and types of one family.

    tables: per table its (column, type) pairs. A stem is the name without a prefix of one or two letters and
    without key, id or code at its end.
    """
    family = {"int": "whole", "bigint": "whole", "smallint": "whole", "string": "text"}

    def stem(name: str) -> str:
        head, sep, rest = name.lower().partition("_")
        name = rest if sep and len(head) <= 2 else name.lower()
        for end in ("key", "_id", "id", "_code", "code"):
            if name.endswith(end) and len(name) > len(end):
                return name.removesuffix(end).rstrip("_")
        return ""

    keys = [(t, c, stem(c), family.get(kind, "")) for t, cols in sorted(tables.items()) for c, kind in cols]
    keys = [k for k in keys if k[2] and k[3]]
    return [(a[0], a[1], b[0], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] != b[0] and a[2:] == b[2:]]


def join_warning(many: DataFrame, many_key: str, one: DataFrame, one_key: str) -> DataFrame:
    """One row: estimated distinct keys of either side; suspect if the many side has clearly fewer than the one side."""
    a = many.agg(F.approx_count_distinct(many_key, 0.01).alias("many_keys"))
    out = a.crossJoin(one.agg(F.approx_count_distinct(one_key, 0.01).alias("one_keys")))  # one row each
    return out.withColumn("suspect", F.col("many_keys") * 1.05 < F.col("one_keys"))


def cardinality(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: most rows of one key on either side, and the relationship that follows; null keys count nowhere."""

    def most(df: DataFrame, key: list[str], name: str) -> DataFrame:
        return df.dropna(subset=key).groupBy(*key).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias(name))

    both = most(left, [a for a, _ in pairs], "left_most").crossJoin(most(right, [b for _, b in pairs], "right_most"))  # one row each
    side = lambda c: F.when(F.col(c) > 1, "many").otherwise("one")
    return both.withColumn("relationship", F.concat(side("left_most"), F.lit("_to_"), side("right_most")))


def containment(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: distinct child keys, how many the parent has, their share, and the parent's uniqueness."""
    keys = child.select(F.col(child_key).alias("k")).where("k is not null").distinct()
    there = parent.select(F.col(parent_key).alias("k")).where("k is not null").groupBy("k").count()
    met = keys.join(there, "k", "left").agg(F.count(F.lit(1)).alias("child_keys"), F.count("count").alias("contained"))
    of = there.agg((F.count(F.lit(1)) / F.sum("count")).alias("parent_uniqueness"))
    return met.withColumn("overlap", F.col("contained") / F.nullif("child_keys", F.lit(0))).crossJoin(of)  # one row each


def conservation(base: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: rows before and after joins."""
    return base.agg(F.count(F.lit(1)).alias("base_rows")).crossJoin(joined.agg(F.count(F.lit(1)).alias("joined_rows")))


def drift(old: DataFrame, new: DataFrame, key: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose value differs by more than the tolerance (as a share of the old one), appeared or vanished.

    A null on one side only differs.
    """
    a = old.select(*key, F.col(value).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(*key, F.col(value).alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full")
    far = F.coalesce(F.abs(F.col("now") - F.col("was")) > F.abs(F.col("was")) * tolerance, ~F.col("now").eqNullSafe(F.col("was")))
    kind = F.when(F.col("in_old").isNull(), "appeared").when(F.col("in_new").isNull(), "vanished").when(far, "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(*key, "was", "now", "kind")


def same_rows(a: DataFrame, b: DataFrame, places: int = 6) -> bool:
    """Whether two results have the same rows, as often, with numbers rounded; results.unmatched compares with a tolerance."""

    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    a, b = rounded(a), rounded(b.select(*a.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def top_with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the largest `by` and all that tie with the last of them."""
    cut = df.where(F.col(by).isNotNull()).select(by).orderBy(F.col(by).desc()).limit(n).agg(F.min(by).alias("cut"))
    return df.join(F.broadcast(cut), F.col(by) >= F.col("cut")).drop("cut")  # one row


def latest_per_key(df: DataFrame, key: list[str], version: Column) -> DataFrame:
    """The row of each key with the largest version, pre-aggregated; of equal versions one; a null version is the smallest."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version.isNotNull(), version)).alias("row"))
    return got.select(*key, "row.*")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column from one pass: rows, nulls, distinct values (exact), smallest and largest as text."""
    facts = []
    for c in columns:
        facts += [F.count_if(F.col(c).isNull()), F.count_distinct(c), F.min(c).cast("string"), F.max(c).cast("string")]
    names = [f"{c}|{k}" for c in columns for k in ("nulls", "values", "least", "most")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[f.alias(n) for f, n in zip(facts, names)])
    each = [F.struct(F.lit(c).alias("column"), "rows", *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "values", "least", "most")]) for c in columns]
    return row.select(F.inline(F.array(*each)))


def value_dictionary(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column from one scan, equal counts by value."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = pairs.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= k)
