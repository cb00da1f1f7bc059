"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. One pass over the texts finds every n-gram that some
test item has, and sends out the stretches of word hashes around such hits. The hits give each
benchmark n-gram the number of documents it occurs in. An item's seeds are its n-grams whose cost
(documents times items that have it) is at most RARE times the item's median cost; so n-grams of
everyday words drop out, while an item that leaked into very many documents keeps its own. Each
stretch that a seed hits is aligned with the item over words: match 2, mismatch -1, gap -1. The score
is the best local alignment as a share of the perfect one.

An item shorter than the n-gram width is one n-gram of all its words (it matches whole only).
Defined results: null or blank texts and items have no words and match nothing; rows with equal id
and text are one document; rows sharing an id are separate documents under that id; repeated items are
items of the same id, the best score counts; extra columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.textkernel import PUNCTUATION, column_bytes, mix64, slices, span_hashes, words
from gaugeworks.llm.workspace import Workspace, row_key

WIDTH, RARE, THRESHOLD = 4, 8, 0.5
#: The benchmark's n-grams (8 bytes each) go to the tasks in slices of about this many, with one pass over the texts each.
SLICE_GRAMS = 4_000_000


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = column_bytes(col)
    data, start, end, first = words(data, off, space=PUNCTUATION)
    return span_hashes(data, start, end), first


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last width - 1 words start none."""
    n = max(len(h) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(3) + h[k : k + n])
    return out


def _item_rows(width: int):
    def run(batches):
        for batch in batches:
            h, first = word_hashes(batch.column(1))
            for k in range(batch.num_rows):
                own = h[first[k] : first[k + 1]]
                if len(own):
                    grams = np.unique(gram_hashes(own, min(width, len(own))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[k].as_py()], pa.int64()),
                            pa.array([own.view(np.int64)], pa.list_(pa.int64())),
                            pa.array([grams.view(np.int64)], pa.list_(pa.int64())),
                        ],
                        names=["item_id", "item", "grams"],
                    )

    return run


_STRETCH = "k1 long, k2 long, doc_id long, at int, words array<long>, grams array<long>"


def _stretches(wanted: np.ndarray, widths: list[int], reach: int):
    """Stretches of words around n-grams in `wanted` (sorted)."""

    def run(batches):
        for batch in batches:
            for lo, n in slices(batch.column(3), 1024):
                part = batch.slice(lo, n)
                h, first = word_hashes(part.column(3))
                rows, at, size, hits = [], [], [], []
                found = []
                for width in widths:
                    g = gram_hashes(h, width)
                    pos = np.flatnonzero(_member(g, wanted))
                    row = np.searchsorted(first, pos, side="right") - 1
                    ok = pos + width <= first[row + 1]
                    found.append((pos[ok], row[ok], g[pos[ok]]))
                pos, row, gram = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.argsort(pos, kind="stable")
                pos, row, gram = pos[order], row[order], gram[order]
                if not len(pos):
                    continue
                new = np.ones(len(pos), bool)
                new[1:] = (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > 2 * reach)
                begin = np.flatnonzero(new)
                stop = np.concatenate([begin[1:], [len(pos)]])
                for a, b in zip(begin, stop):
                    r = row[a]
                    lo_w, hi_w = max(first[r], pos[a] - reach), min(first[r + 1], pos[b - 1] + reach)
                    rows.append(r)
                    at.append(lo_w - first[r])
                    size.append(h[lo_w:hi_w].view(np.int64))
                    hits.append(np.unique(gram[a:b]).view(np.int64))
                take = pa.array(np.array(rows, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k).take(take) for k in range(3)),
                        pa.array(np.array(at, np.int32)),
                        pa.array(size, pa.list_(pa.int64())),
                        pa.array(hits, pa.list_(pa.int64())),
                    ],
                    names=["k1", "k2", "doc_id", "at", "words", "grams"],
                )

    return run


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array; a table over the top bits answers for most."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    bits = 20
    seen = np.zeros(1 << bits, bool)
    seen[(wanted >> np.uint64(64 - bits)).astype(np.int64)] = True
    near = np.flatnonzero(seen[(values >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, values[near]), len(wanted) - 1)
    out = np.zeros(len(values), bool)
    out[near[wanted[at] == values[near]]] = True
    return out


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word arrays, and the text word it ends before."""
    pairs, wide = len(items), max(map(len, texts), default=0)
    score, end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    if not pairs or not wide:
        return score, end
    b = np.full((pairs, wide), 0, np.int64)
    b_ok = np.zeros((pairs, wide), bool)
    for k, t in enumerate(texts):
        b[k, : len(t)], b_ok[k, : len(t)] = t, True
    a = np.zeros((pairs, max(map(len, items))), np.int64)
    a_len = np.array([len(i) for i in items])
    for k, i in enumerate(items):
        a[k, : len(i)] = i
    ramp = np.arange(wide, dtype=np.int32)
    prev = np.zeros((pairs, wide), np.int32)
    for i in range(a.shape[1]):
        match = np.where((a[:, i, None] == b) & b_ok & (i < a_len)[:, None], np.int32(2), np.int32(-1))
        diag = np.zeros_like(prev)
        diag[:, 1:] = prev[:, :-1]
        cur = np.maximum(np.maximum(diag + match, prev - 1), 0)
        cur = np.maximum.accumulate(cur + ramp, axis=1) - ramp
        top = cur.argmax(axis=1)
        best = cur[np.arange(pairs), top]
        better = best > score
        score[better], end[better] = best[better], top[better] + 1
        prev = cur
    return score, end


def _align_rows(threshold: float):
    def run(batches):
        for batch in batches:
            item = [v.values.to_numpy() for v in batch.column(5)]
            text = [v.values.to_numpy() for v in batch.column(6)]
            rows = sorted(range(batch.num_rows), key=lambda k: len(text[k]))
            while rows:
                size = max(1, min(512, 1_000_000 // max(1, len(text[rows[-1]]))))
                rows, take = rows[:-size], rows[-size:]
                score, end = align([item[k] for k in take], [text[k] for k in take])
                share = score / np.array([2.0 * len(item[k]) for k in take])
                hit = np.flatnonzero(share >= threshold)
                if not len(hit):
                    continue
                own = [take[k] for k in hit]
                # The same alignment from behind, over what lies before its end, gives its start.
                _, back = align([item[k][::-1] for k in own], [text[k][: end[j]][::-1] for k, j in zip(own, hit)])
                at = batch.column(4).to_numpy()[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(own)) for c in range(4)),
                        pa.array(share[hit]),
                        pa.array((at + end[hit] - back).astype(np.int32)),
                        pa.array((at + end[hit]).astype(np.int32)),
                    ],
                    names=["k1", "k2", "doc_id", "item_id", "score", "start_word", "end_word"],
                )

    return run


def leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """(k1, k2, doc_id, item_id, score, start_word, end_word): a document's best alignment with an item.

    k1 and k2 are the document's row key; words are counted from 0 in the text.
    """
    work = Workspace(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = work.cut(items.mapInArrow(_item_rows(width), "item_id long, item array<long>, grams array<long>"), "items")
    grams = work.cut(items.select(F.explode("grams").alias("gram"), "item_id").distinct(), "grams")
    facts = items.agg(F.max(F.size("item")).alias("longest"), F.collect_set(F.least(F.size("item"), F.lit(width))).alias("widths"))
    longest, widths = facts.first()
    keyed = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = grams.select("gram").distinct()
    slices = known.count() // SLICE_GRAMS + 1
    passes = []
    for k in range(slices):
        part = known.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k)
        wanted = np.sort(part.toArrow().column(0).to_numpy().view(np.uint64))
        stretch = _stretches(wanted, sorted(widths) or [width], longest or 1)
        passes.append(keyed.mapInArrow(stretch, _STRETCH).withColumn("slice", F.lit(k)))
    # Each hit lies in a stretch of its own slice, with all the words that an alignment over it can reach.
    found = work.cut(reduce(DataFrame.union, passes), "found")
    place = ["k1", "k2", "slice", "at"]
    hits = found.select(*place, F.explode("grams").alias("gram"))
    cost = hits.select("k1", "k2", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("items"))
    cost = cost.join(shared, "gram").select("gram", (F.col("docs") * F.col("items")).alias("cost"))
    costs = grams.join(cost, "gram")
    middle = costs.groupBy("item_id").agg(F.percentile_approx("cost", 0.5).alias("middle"))
    seeds = work.cut(costs.join(middle, "item_id").where(f"cost <= {RARE} * middle").select("gram", "item_id"), "seeds")
    pairs = hits.join(seeds, "gram").select(*place, "item_id").distinct()
    pairs = pairs.join(found.select(*place, "doc_id", "words").dropDuplicates(place), place)
    pairs = pairs.join(items.select("item_id", "item"), "item_id")
    scored = pairs.select("k1", "k2", "doc_id", "item_id", "at", "item", "words").mapInArrow(
        _align_rows(threshold), "k1 long, k2 long, doc_id long, item_id long, score double, start_word int, end_word int"
    )
    best = scored.groupBy("k1", "k2", "doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word")).alias("b")
    )
    return best.select("k1", "k2", "doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start_word"), "b.end_word")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain a test item."""
    keys = leaks(spark, docs, benchmark, threshold).select("k1", "k2").distinct()
    k1, k2 = row_key()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1, k2)
    return rows.join(keys, ["k1", "k2"], "left_anti").select("row.*")
