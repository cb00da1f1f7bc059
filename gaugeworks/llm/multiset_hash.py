"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs (its lines). Its fingerprint is a vector of 31-bit lanes:

* lane 0 counts pieces; a piece of a paragraph ends at a blank behind a full stop or the letter e, so pieces
  have about five words and the same words give the same pieces wherever they stand;
* 16 equality lanes sum, over the paragraphs, numbers hashed from the paragraph and the lane;
* 128 likeness lanes count, over the pieces, one bit each of a 128-bit hash of the piece.

All sums are modulo 2**31, so the order of paragraphs does not matter, and the vector of a text
with paragraphs added or taken away is the sum or difference of vectors (`combine`). The cosine
of two likeness parts, each count c read as 2c - pieces, estimates how far the pieces overlap.

Defined results: null text is empty text, and empty text is one empty paragraph; equal texts have
equal fingerprints and likeness 1; likeness is cut off below 0; repeated rows (same id and text)
are one document in the order of documents, rows that share an id are ordered by a hash of the
text, a null id comes first; a lone document is its own next one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.workspace import Workspace

EQUALITY, LIKENESS = 16, 128
_MOD = 2**31
_NO_ID = -(2**63)


def vector(text: str) -> Column:
    """The lanes of the text column named `text`, as array<int>."""
    paras = f"transform(split({text}, '\\n', -1), p -> named_struct('a', xxhash64(p, 1), 'b', xxhash64(p, 2)))"
    pieces = f"transform(split({text}, '\\n|(?<=[e.!?]) ', -1), p -> named_struct('a', xxhash64(p, 3), 'b', xxhash64(p, 4)))"
    sums = [
        f"aggregate(h.paras, 0L, (s, x) -> (s + (xxhash64(x.a, x.b, {j}) & {_MOD - 1})) & {_MOD - 1})" for j in range(EQUALITY)
    ]
    # Two counts share one sum: bit i of the hash in the low half, bit i + 32 in the high half.
    pairs = [
        f"aggregate(h.pieces, 0L, (s, x) -> s + (shiftrightunsigned(x.{part}, {i}) & 4294967297L))"
        for part in "ab" for i in range(LIKENESS // 4)
    ]
    lanes = (
        f"concat(array(cast(size(h.pieces) as bigint), {', '.join(sums)}), "
        f"flatten(transform(array({', '.join(pairs)}), c -> array(c & {_MOD - 1}, shiftrightunsigned(c, 32) & {_MOD - 1}))))"
    )
    held = f"transform(array(named_struct('paras', {paras}, 'pieces', {pieces})), h -> transform({lanes}, v -> cast(v as int)))"
    return F.expr(f"element_at({held}, 1)")


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Vector of the multiset sum (sign 1) or difference (sign -1) of two fingerprint vectors."""
    return F.zip_with(
        left, right, lambda a, b: F.pmod(a.cast("long") + F.lit(sign).cast("long") * b.cast("long"), F.lit(_MOD).cast("long")).cast("int")
    )


def digest(lanes: str) -> Column:
    """The vector as lowercase hex, eight digits a lane."""
    return F.expr(f"array_join(transform({lanes}, v -> lpad(lower(hex(v)), 8, '0')), '')")


def likeness(left: str, right: str) -> Column:
    """Cosine of the likeness lanes, from 0 to 1; 1 for equal vectors."""
    centred = "transform(slice({0}, {1}, {2}), c -> 2D * c - {0}[0])"
    a, b = (centred.format(x, EQUALITY + 2, LIKENESS) for x in (left, right))
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, v) -> s + v)"
    norm = "sqrt(aggregate({0}, 0D, (s, v) -> s + v * v))"
    cos = f"coalesce(try_divide({dot}, {norm.format(a)} * {norm.format(b)}), 0D)"
    return F.expr(f"case when {left} = {right} then 1D else greatest(0D, least(1D, {cos})) end")


def _successors(work: Workspace, keys: DataFrame, parts: int) -> DataFrame:
    """(k1, k2, n) to (k1, k2, n, x1, x2): each key's next one in order, the first after the last.

    Keys are range-partitioned; inside a range the next key is a window away, and the last key of
    a range takes the first of the next range, of which there is one row per partition.
    """
    ranged = keys.repartitionByRange(parts, "k1", "k2").withColumn("pid", F.spark_partition_id())
    ranged = work.cut(ranged, "ranged")
    heads = work.cut(ranged.groupBy("pid").agg(F.min(F.struct("k1", "k2")).alias("head")), "heads")
    nexts = heads.selectExpr("pid", "lead(head) over (order by pid) as after", "first(head) over (order by pid) as start")
    nexts = nexts.select("pid", F.coalesce("after", "start").alias("after"))  # one row per partition
    inner = ranged.selectExpr("k1", "k2", "n", "pid", "lead(struct(k1, k2)) over (partition by pid order by k1, k2) as nx")
    joined = inner.join(F.broadcast(nexts), "pid").withColumn("nx", F.coalesce("nx", "after"))
    return joined.select("k1", "k2", "n", F.col("nx.k1").alias("x1"), F.col("nx.k2").alias("x2"))


def document_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose tail is the next document's head.

    The edited text keeps the first n - floor(n / 2) code points and takes the first floor(n / 2)
    (or all) of the next document. Text is dealt by key once; only the heads travel again.
    """
    work = Workspace(spark, "multiset-hash")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k1"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("k2", F.xxhash64("text"))
    keys = base.select("k1", "k2", F.length("text").alias("n")).distinct()
    after = _successors(work, keys, parts)
    lanes = base.withColumn("vec", vector("text"))
    # The first of repeated rows; told by lag so that the exchange stays the one below, used twice.
    one = lanes.selectExpr("*", "lag(1) over (partition by k1, k2 order by k1) as seen").where("seen is null").drop("seen")
    heads = one.join(after.withColumnsRenamed({"k1": "p1", "k2": "p2"}), F.expr("k1 = x1 and k2 = x2"))
    heads = heads.selectExpr("p1", "p2", "left(text, n div 2) as head", "vec as next_vec")
    both = lanes.join(heads, F.expr("k1 = p1 and k2 = p2"))
    both = both.selectExpr("*", "length(text) as n").selectExpr("*", "left(text, n - n div 2) || head as edited")
    both = both.withColumn("edited_vec", vector("edited"))
    return both.select(
        F.expr(f"nullif(k1, {_NO_ID + 1} - 1)").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest("vec").alias("fingerprint"),
        digest("edited_vec").alias("edited_fingerprint"),
        likeness("vec", "edited_vec").alias("near_edited"),
        likeness("vec", "next_vec").alias("near_next"),
    )
