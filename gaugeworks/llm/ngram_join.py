"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles. Two documents link when
100 * |intersection| >= threshold * |union|. All links count, none is estimated:

* Documents with equal sets are one class; only one node of each class is joined.
* Under one order of all shingles (by hash), a set of size n keeps the prefix of its first
  n - ceil(t * n) + K shingles. Linked sets share at least ceil(t * n) shingles for the larger
  n, so they share at least K of the smaller set inside both prefixes (K grows with n).
* Shingles in one prefix only can link nothing; a set with fewer than K shared ones drops out.
* The rest are ordered rarest first. A set indexes its first (count - K + 1) shingles that are
  rare one by one. Pairs that share no rare one share K frequent ones; these are dealt into
  G < K groups by hash, two of them meet in one group, and each pair of frequent shingles in a
  group is indexed as a combination. G is a power of two fixed by the size, and a set also
  indexes the next smaller G when a partner of its size range could use that.
* Sets that meet on an index key are held against each other by parity bits: of two sets, no
  more bits differ than shingles do, so a pair with too many different bits cannot link. What
  may link is joined into tentative components; they hold every link.
* In each tentative component all sets are counted against each other, in blocks of bounded
  size. That gives the number of links of every set and the edges of the real components.

Hot values: equal texts are one set already in the task that reads them; shingles that hold a
large share of some task's rows are frequent without being counted, so no task gathers them; an
index key with many sets, or a large component, is split into pairs of blocks.

Defined results: null or blank text has no shingles (n_shingles 0) and links to nothing;
fewer words than the width make one shingle; repeated rows come back as often as they came, with
equal results; rows that share a doc_id but not the text are joined by their own texts; a null
doc_id takes part and comes back as null. component_id is the smallest non-null doc_id of the
component; n_links counts the other sets that a row's set links with (copies of a set count
once, and equal sets are no links). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.textkernel import mix64, shingle_sets, slices
from gaugeworks.llm.workspace import Workspace, components

#: Prefix shingles in at most so many sets are indexed one by one, others in pairs.
RARE = 64
#: Members of an index key, and of a component, that one task holds against each other; also shingles of a component's block.
KEY_BLOCK, BLOCK, BLOCK_SHINGLES = 1024, 256, 1 << 17
#: So many of the shingles with a large share of a task's rows are kept out of the count; any others are counted like the rest.
HOT_SHINGLES, HOT_SHARE = 1 << 14, 0.02


def misses(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many of n shingles a partner may lack: n - ceil(threshold * n / 100)."""
    n = np.asarray(n, np.int64)
    return n - (n * threshold + 99) // 100


def shared_floor(n: np.ndarray, threshold: int) -> np.ndarray:
    """K: shingles that linked sets share inside their prefixes."""
    return 1 + np.maximum(1, misses(n, threshold) // 4)


def _ceil_share(n: int, threshold: int) -> int:
    return (n * threshold + 99) // 100


def groupings(n: int, threshold: int) -> list[int]:
    """The group counts under which a set of size n indexes its frequent shingles."""
    own = 1 << (int(shared_floor(n, threshold) - 1).bit_length() - 1)
    least = 1 << (int(shared_floor(_ceil_share(n, threshold), threshold) - 1).bit_length() - 1)
    out, g = [own], own
    while g > least:
        g //= 2
        out.append(g)
    return out


def parity_bits(h: np.ndarray) -> bytes:
    """Bit k: whether an odd number of hashes fall on k; as many bits as the next power of two from the set's size, 64 at least."""
    size = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


_SETS = "node long, doc_id long, th long, n int, set_hi long, set_lo long, prefix array<long>, bits binary"


def _sets(width: int, threshold: int):
    """Rows to sets. node is unique; of equal sets in a task only the first has its prefix and bits."""

    def run(batches):
        from pyspark import TaskContext

        node, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            for lo, rows in slices(batch.column(2), 512):
                part = batch.slice(lo, rows)
                h, off = shingle_sets(part.column(2), width)
                n = np.diff(off)
                spans = [h[a:b] for a, b in zip(off[:-1], off[1:])]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in spans]
                new = []
                for d, s in zip(digest, spans):
                    new.append(len(s) > 0 and d not in seen)
                    seen.add(d)
                new = np.array(new, bool)
                pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                take = np.where(new, np.minimum(n, misses(n, threshold) + shared_floor(n, threshold)), 0)
                starts = np.concatenate([[0], np.cumsum(take)])
                row = np.repeat(np.arange(len(n)), take)
                vals = h[np.arange(starts[-1]) - starts[row] + off[row]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node + np.arange(len(n))),
                        part.column(0),
                        part.column(1),
                        pa.array(n.astype(np.int32)),
                        pa.array(pair[:, 0].copy()),
                        pa.array(pair[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(vals)),
                        pa.array([parity_bits(s) if k else None for s, k in zip(spans, new)], pa.binary()),
                    ],
                    names=["node", "doc_id", "th", "n", "set_hi", "set_lo", "prefix", "bits"],
                )
                node += len(n)

    return run


def _locally_hot(batches):
    """Prefix shingles that a large share of the task's rows have, with their counts there."""
    values, rows = [], 0
    for batch in batches:
        values.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        rows += batch.num_rows
    if values:
        tok, m = np.unique(np.concatenate(values), return_counts=True)
        hot = m > max(64, HOT_SHARE * rows)
        yield pa.RecordBatch.from_arrays([pa.array(tok[hot]), pa.array(m[hot])], names=["tok", "m"])


def _index_keys(threshold: int, rare: int):
    """(node, n, shared shingles with their frequency) to index keys."""

    def one(n: int, tok: np.ndarray, df: np.ndarray) -> np.ndarray:
        k = int(shared_floor(n, threshold))
        order = np.lexsort((tok, df))
        tok, df = tok[order].view(np.uint64), df[order]
        head = len(tok) - k + 1
        keys = [mix64(tok[:head][df[:head] <= rare])]
        often = np.sort(tok[df > rare])
        for g in groupings(n, threshold):
            if len(often) < g + 1:
                continue
            grp = mix64(often ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(g - 1)
            by = np.lexsort((often, grp))
            t, gr = often[by], grp[by]
            for a, b in zip(*_runs(gr)):
                i, j = np.triu_indices(b - a, 1)
                keys.append(mix64(t[a + i] * np.uint64(3) + mix64(t[a + j]) + np.uint64(g)))
        return np.unique(np.concatenate(keys))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part, keys, nodes = batch.slice(lo, 128), [], []
                for node, n, tok, df in zip(*(part.column(i) for i in range(4))):
                    got = one(n.as_py(), tok.values.to_numpy(zero_copy_only=False), df.values.to_numpy(zero_copy_only=False))
                    keys.append(got.view(np.int64))
                    nodes.append(np.full(len(got), node.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return run


def _runs(values: np.ndarray):
    """Starts and ends of runs of equal values in a sorted array."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(values)]]).astype(int)


class _Forest:
    """Union-find over the nodes that one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root and y != x:
            up[x] = root
            x = y
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _grouped(batches, keys: int):
    """Rows of sorted batches by runs of equal values in the first `keys` columns: lists of batch slices."""
    held, was = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            now = tuple(c[a] for c in cols)
            if held and now != was:
                yield was, held
                held = []
            was = now
            held.append(batch.slice(a, b - a))
    if held:
        yield was, held


def _column(parts: list[pa.RecordBatch], k: int) -> np.ndarray:
    return np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])


def _may_link(threshold: int):
    """Groups (key, i, j) of (node, n, block, bits) to the edges of a forest over the pairs that may link."""

    def narrow(rows: np.ndarray, words: int) -> np.ndarray:
        while rows.shape[1] > words:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def run(batches):
        forest = _Forest()
        for (_, i, j), parts in _grouped(batches, 3):
            node, n, block = _column(parts, 3), _column(parts, 4).astype(np.int64), _column(parts, 5)
            bits = [np.frombuffer(x, np.uint64) for x in _column(parts, 6)]
            width = np.array([len(x) for x in bits])
            by = np.lexsort((node, n))
            node, n, block, width = node[by], n[by], block[by], width[by]
            bits = [bits[k] for k in by]
            label = np.arange(len(node))
            edges = []
            # A set and its larger partners: a partner has as many bits or more.
            tables = {w: np.stack([b for b in bits if len(b) == w]) for w in np.unique(width)}
            first = {w: int(np.argmax(width == w)) for w in tables}
            for k in range(len(node) - 1):
                lo, hi = k + 1, int(np.searchsorted(n, n[k] * 100 // threshold, "right"))
                if hi <= lo:
                    continue
                for w in tables:
                    a, b = max(lo, first[w]), min(hi, first[w] + len(tables[w]))
                    if a >= b:
                        continue
                    other = np.arange(a, b)
                    other = other[(label[other] != label[k]) & ((block[other] != block[k]) if i != j else True)]
                    if not len(other):
                        continue
                    rows = narrow(tables[w][other - first[w]], len(bits[k]))
                    apart = np.bitwise_count(rows ^ bits[k]).sum(1, dtype=np.int64)
                    near = other[(100 + threshold) * apart <= (100 - threshold) * (n[other] + n[k])]
                    for o in near:
                        if label[o] != label[k]:
                            label[label == label[o]] = label[k]
                            edges.append((int(node[k]), int(node[o])))
            edges = [(a, b) for a, b in edges if forest.join(a, b)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges]), pa.array([e[1] for e in edges])], names=["a", "b"])

    return run


def _whole_sets(width: int):
    """(node, set_hi, set_lo, text) to the hashes of the node's whole set, where the text has that set."""

    def run(batches):
        for batch in batches:
            for lo, rows in slices(batch.column(3), 256):
                part = batch.slice(lo, rows)
                h, off = shingle_sets(part.column(3), width)
                spans = [h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
                digest = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in spans), np.int64).reshape(-1, 2)
                good = (digest[:, 0] == part.column(1).to_numpy()) & (digest[:, 1] == part.column(2).to_numpy())
                kept = np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(kept)), pa.array([spans[k] for k in kept], pa.binary())], names=["node", "hashes"]
                )

    return run


def _link_counts(threshold: int):
    """Groups (comp, i, j) of (node, block, hashes): the links of every node, and the edges of a forest over them."""

    def run(batches):
        forest = _Forest()
        for (_, i, j), parts in _grouped(batches, 3):
            node, block = _column(parts, 3), _column(parts, 4)
            sets = [np.frombuffer(x, np.uint64) for x in _column(parts, 5)]
            n = np.array([len(s) for s in sets], np.int64)
            _, code, m = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            place = np.cumsum(m > 1) - 1
            owner, common = np.repeat(np.arange(len(sets)), n), (m > 1)[code]
            owner, code = owner[common], place[code[common]]
            by = np.argsort(code, kind="stable")
            owner, code = owner[by], code[by]
            shared = np.zeros((len(sets), len(sets)), np.float64)
            for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
                a, b = np.searchsorted(code, [lo, lo + 4096])
                dense = np.zeros((len(sets), 4096), np.float32)
                dense[owner[a:b], code[a:b] - lo] = 1
                shared += dense @ dense.T
            shared = shared.astype(np.int64)
            linked = np.triu((100 + threshold) * shared >= threshold * (n[:, None] + n[None, :]), 1)
            if i != j:
                linked &= block[:, None] != block[None, :]
            x, y = np.nonzero(linked)
            count = np.bincount(x, minlength=len(sets)) + np.bincount(y, minlength=len(sets))
            edges = [(int(a), int(b)) for a, b in zip(node[x], node[y]) if forest.join(int(a), int(b))]
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*node[own].tolist(), *(e[0] for e in edges)], pa.int64()),
                    pa.array([*[None] * len(own), *(e[1] for e in edges)], pa.int64()),
                    pa.array([*count[own].tolist(), *[None] * len(edges)], pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    return run


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """rows, each once for every pair (i, j) of blocks of its key that its own block is one of.

    The column `blocks` has the number of blocks; a row's own one is drawn from a hash of its node.
    """
    own = rows.withColumn("block", F.expr(f"int(pmod(xxhash64(node), {blocks}))"))
    each = own.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks} - 1)")))
    return each.select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *[c for c in own.columns if c not in (key, blocks)])


def jaccard_classes(
    spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 75, rare: int = RARE
) -> tuple[DataFrame, DataFrame]:
    """Membership and links of the join.

    membership: one row (doc_id, n_shingles, text_hash, set_id, class_id, component_id, n_links) per input
    row; set_id names the class of equal sets and class_id the component (null: no shingles). links:
    (a, b), set ids that link, as many as connect every component; n_links has the number of all links.
    """
    work = Workspace(spark, "ngram-join")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sets = work.cut(base.mapInArrow(_sets(width, threshold), _SETS), "sets", "lz4")
    some = sets.where("n > 0")
    # Of equal sets the smallest node that has a prefix stands for the class.
    classes = some.groupBy("set_hi", "set_lo").agg(
        F.min(F.when(F.col("bits").isNotNull(), F.col("node"))).alias("node"), F.min("doc_id").alias("rep")
    )
    classes = work.cut(classes, "classes")

    hot = some.where("bits is not null").select("prefix").mapInArrow(_locally_hot, "tok long, m long")
    hot = hot.groupBy("tok").agg(F.sum("m").alias("m")).orderBy(F.desc("m"), "tok").limit(HOT_SHINGLES).select("tok")
    hot = F.broadcast(work.cut(hot, "hot"))
    tokens = some.select("node", F.explode("prefix").alias("tok"))
    counted = tokens.join(hot, "tok", "left_anti").repartition("tok")
    often = counted.groupBy("tok").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    left = counted.join(often, "tok").select("node", "tok", "df")
    left = left.union(tokens.join(hot, "tok").select("node", "tok", F.lit(2**30).alias("df")))
    k = F.expr(f"1 + greatest(1, int((n - (n * {threshold} + 99) div 100) div 4))")
    stand = some.where("bits is not null").select("node", "n").join(classes.select("node"), "node")
    shared = (
        left.groupBy("node")
        .agg(F.collect_list(F.struct("tok", "df")).alias("t"))
        .join(stand, "node")
        .where(F.size("t") >= k)
        .select("node", "n", F.col("t.tok").alias("tok"), F.col("t.df").alias("df"))
    )
    index = work.cut(shared.mapInArrow(_index_keys(threshold, rare), "key long, node long"), "index")

    # Keys with the same members tell the same: one of them is enough.
    met = index.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"))
    met = met.where("m > 1").groupBy("m", "s").agg(F.min("key").alias("key"))
    met = met.select("key", F.expr(f"int((m + {KEY_BLOCK - 1}) div {KEY_BLOCK})").alias("blocks"))
    keyed = index.join(met, "key").join(some.where("bits is not null").select("node", "n", "bits"), "node")
    keyed = _in_blocks(keyed, "key", "blocks").select("key", "i", "j", "node", "n", "block", "bits")
    keyed = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = work.cut(keyed.mapInArrow(_may_link(threshold), "a long, b long"), "edges")
    near = components(work, edges, "near")

    # Every link lies in one of these components: there all sets are counted against each other.
    whole = near.join(some.select("node", "doc_id", "th", "set_hi", "set_lo"), "node")
    whole = work.cut(whole.select("node", "set_hi", "set_lo", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "th"), "near")
    found = base.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "th", "text")
    found = whole.join(work.sieved(found, whole, "th"), ["k", "th"]).select("node", "set_hi", "set_lo", "text")
    found = found.mapInArrow(_whole_sets(width), "node long, hashes binary").dropDuplicates(["node"])
    found = work.cut(found.join(near, "node"), "whole")
    size = found.groupBy("comp").agg(
        F.expr(f"int(ceil(greatest(count(1) / {BLOCK}, sum(length(hashes)) / {8 * BLOCK_SHINGLES})))").alias("blocks")
    )
    pairs = _in_blocks(found.join(size, "comp"), "comp", "blocks").select("comp", "i", "j", "node", "block", "hashes")
    pairs = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    counts = work.cut(pairs.mapInArrow(_link_counts(threshold), "a long, b long, links long"), "counts")
    links = counts.where("b is not null").select("a", "b")
    degree = counts.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    comp = components(work, links, "cc")

    named = classes.join(comp, "node", "left").join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("set_hi", "set_lo", "node", "comp", "component_id", "n_links")
    members = (
        sets.select("doc_id", "th", "n", "set_hi", "set_lo")
        .join(named, ["set_hi", "set_lo"], "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.col("th").alias("text_hash"),
            F.col("node").alias("set_id"),
            F.col("comp").alias("class_id"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
    members = work.cut(members, "members")
    work.drop("sets", "classes", "hot", "index", "edges", "whole")
    return members, links


def without_near_copies(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: int = 75) -> DataFrame:
    """docs with one document of each component: that with the smallest id (null last), then text hash.

    Documents without words are near nothing and stay; of repeated rows of a kept document one stays.
    """
    members, _ = jaccard_classes(spark, docs, width, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("s")
    chosen = members.where("class_id is not null").groupBy("class_id").agg(first)
    chosen = chosen.select(F.coalesce("s.doc_id", F.lit(-(2**63))).alias("k"), F.col("s.text_hash").alias("th"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"),
        F.xxhash64(text).alias("th"),
        text.rlike(r"[^\x20\x09-\x0D]").alias("worded"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    kept = rows.where("worded").join(chosen, ["k", "th"]).dropDuplicates(["k", "th"])
    return kept.select("row.*").union(rows.where("not worded").select("row.*"))
