"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Groups are gathered into a fixed number of cells by a hash of the text,
so the packer sees a bounded number of items whatever the number of documents. An item is a vector
(bytes, tokens, rows); items are placed largest first into the shard where the dot product of the
item with the shard's residual capacity is highest. A group that is larger than a set part of a
shard's capacity (a hot text) leaves its cell and is split into parts by a hash of the id and of a
running number, written with the row, so that null and repeated ids split too; the parts are items; every other group stays in one shard, with all of its cell. Hot texts are looked for
in cells above that part only, by sums over a 64-bit hash of the text.

Slots are gapless in each shard: an item's first slot is the sum of the rows of the shard's items
before it, and a row's place inside its part comes from a window over that part alone; parts have
bounded numbers of rows.

Defined results: null text is empty text of size 1; repeated rows are dealt with like other rows
and keep one slot each; a null doc_id is a row like any other; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.workspace import Workspace

CELLS = 4096
#: Rows that a part of a cell holds on average at most, times the mean rows of a cell.
PART_ROWS = 2
#: Part of a shard's capacity from which on a group of equal texts is split for placing.
SPLIT_AT = 0.6
#: Parts of a hot group at least, for each shard's capacity that it fills.
HOT_PARTS = 8


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), largest first by residual dot product."""
    total = items.sum(axis=0).astype(float)
    size = items / np.maximum(total, 1)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    shard = np.zeros(len(items), int)
    for k in np.argsort(-size.max(axis=1), kind="stable"):
        to = int(np.argmax(residual @ size[k])) if size[k].any() else 0
        shard[k] = to
        residual[to] -= size[k]
    return shard


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of documents."""
    work = Workspace(spark, "shards")
    own, text = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.size(F.expr(r"filter(split(text, '[\x20\x09-\x0D]+', -1), w -> w <> '')")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.monotonically_increasing_id()), F.lit(2**30)).alias("spot"),
    )
    rows = work.cut(rows, "rows")
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens")]
    whole = rows.groupBy("cell").agg(*sums).orderBy("cell").collect()  # at most one row per cell
    n_rows, n_bytes = sum(r.rows for r in whole), sum(r.bytes for r in whole)
    mean = max(1, -(-n_rows // cells))
    over = (F.col("bytes") > SPLIT_AT * n_bytes / shards) | (F.col("rows") > SPLIT_AT * n_rows / shards)
    large = [r.cell for r in whole if r.bytes > SPLIT_AT * n_bytes / shards or r.rows > SPLIT_AT * n_rows / shards]
    groups = rows.where(F.col("cell").isin(large)).groupBy("cell", "group").agg(*sums)
    hot = groups.where(over).orderBy("group").collect() if large else []  # at most 2 * shards / SPLIT_AT rows
    count, least = {r.cell: r.rows for r in whole}, {}
    for k, r in enumerate(hot):
        count[r.cell] -= r.rows
        count[cells + k] = r.rows
        least[cells + k] = math.ceil(HOT_PARTS * shards * max(r.rows / n_rows, r.bytes / n_bytes))
    parts = {c: max(least.get(c, 1), -(-n // (PART_ROWS * max(mean, 16)))) for c, n in count.items()}
    if hot:
        own = spark.createDataFrame([(r.group, cells + k) for k, r in enumerate(hot)], "group long, own int")
        rows = rows.join(F.broadcast(own), "group", "left").withColumn("cell", F.coalesce("own", "cell")).drop("own")
    ways = spark.createDataFrame([(c, p) for c, p in parts.items()], "cell int, parts int")  # one row per cell
    dealt = rows.join(F.broadcast(ways), "cell").withColumn("part", F.expr("int(spot % parts)"))
    dealt = dealt.drop("spot", "parts", "group")
    of_part = dealt.groupBy("cell", "part").agg(*sums).orderBy("cell", "part").collect()  # at most 1.5 * cells + 2 * HOT_PARTS * shards rows and some
    item_of = [(r.cell, r.part if r.cell >= cells else -1) for r in of_part]
    names = {x: i for i, x in enumerate(dict.fromkeys(item_of))}
    vectors = np.zeros((max(len(names), 1), 3))
    for r, x in zip(of_part, item_of):
        vectors[names[x]] += (r.bytes, r.tokens, r.rows)
    shard = pack(vectors, shards)
    filled, plan = [0] * shards, []
    for r, x in zip(of_part, item_of):
        to = int(shard[names[x]])
        plan.append((r.cell, r.part, to, filled[to]))
        filled[to] += r.rows
    plan = spark.createDataFrame(plan, "cell int, part int, shard int, start long")
    return (
        dealt.selectExpr("*", "row_number() over (partition by cell, part order by doc_id, text_crc32, size) as nth")
        .join(F.broadcast(plan), ["cell", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"))
    )
