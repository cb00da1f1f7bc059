"""Line dedup by every repeated run of lines.

A run is MIN_LINES or more consecutive lines of one text with MIN_BYTES or more bytes, or one line with
MIN_ALONE or more: a passage that was written as one paragraph. A line goes if it lies in a run that also stands at an earlier place of the corpus (smaller id, then position), however
long the run is and whatever surrounds it; so each line that goes has an equal line that stays.

To find these lines, only the shortest runs are needed: for each line the shortest run that starts
there, and the shortest that ends there. Whether a run is one of these depends on its own lines alone,
each is a run itself, and those inside a longer run cover all of its lines: a line whose shortest run
forward leaves the longer run is covered by the shortest run that ends with it. (MIN_ALONE is at least
MIN_BYTES: lines that are too short together hold none that is long alone.)

A first pass counts 64-bit hashes of the shortest runs. A Bloom filter of the repeated ones, of at most
FILTER_BITS bits, lets a second pass over the texts send out the bytes of (nearly) these alone, with a
128-bit BLAKE2b digest; what passes the filter wrongly finds no partner. Runs of one digest are compared
byte by byte, by the smallest and the largest of them, which Spark aggregates before the shuffle; should
they differ, all of them stay. A run that very many documents share is one key of a plain join, which
Spark splits. Texts are dealt by document once, to lose their lines.

Defined results: null text stays null, empty text stays empty, a text all of whose lines go becomes
empty; a shorter line that repeats between different neighbours is no run and stays; rows with equal id and text
are one document (all stay or lose the same lines); a run that occurs twice inside one document, also
overlapping itself, stays once; a null id counts as the smallest; columns of the input
are kept as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.textkernel import column_bytes, slices, span_hashes
from gaugeworks.llm.workspace import Workspace, row_key

MIN_LINES, MIN_BYTES, MIN_ALONE = 2, 40, 200
FILTER_BITS = 2**27
#: Bytes of runs in one Arrow batch, about.
BATCH_BYTES = 2**23
_RUNS = "k1 long, k2 long, first int, n int, d1 long, d2 long, run binary"


def chunk_lines(col: pa.Array):
    """The shortest runs of every text: row, first line within the row, number of lines, bytes, hash."""
    data, off = column_bytes(col)
    return _runs(data, off)[1:]


def _runs(data: np.ndarray, off: np.ndarray):
    """Of the shortest runs: first byte, row, first line within the row, number of lines, bytes, hash."""
    brk = np.flatnonzero(data == 10)
    # Line starts: each text's start, and behind every line feed; a text of n feeds has n + 1 lines.
    feeds = np.searchsorted(brk, off)
    n_lines = np.diff(feeds) + 1
    row = np.repeat(np.arange(len(n_lines)), n_lines)
    line0 = np.concatenate([[0], np.cumsum(n_lines)])
    line = np.arange(line0[-1])
    nth = line - line0[row]
    at = feeds[row] + nth
    start = np.where(nth == 0, off[row], (brk[np.maximum(at - 1, 0)] + 1) if len(brk) else off[row])
    last = nth == n_lines[row] - 1
    end = np.where(last, off[row + 1], brk[np.minimum(at, len(brk) - 1)] if len(brk) else off[row + 1])
    stop = np.maximum(np.searchsorted(end, start + MIN_BYTES), line + MIN_LINES - 1)
    begin = np.minimum(np.searchsorted(start, end - MIN_BYTES, "right") - 1, line - MIN_LINES + 1)
    alone = end - start >= MIN_ALONE
    stop, begin = np.where(alone, line, stop), np.where(alone, line, begin)
    forth, back = stop < line0[row + 1], begin >= line0[row]
    count = max(len(line), 1)
    both = np.unique(np.concatenate([line[forth] * count + stop[forth], begin[back] * count + line[back]]))
    begin, stop = both // count, both % count
    first = start[begin]
    return first, row[begin], nth[begin], stop - begin + 1, end[stop] - first, span_hashes(data, first, end[stop])


def _hashes(batches):
    """One hash a row of the shortest runs of (k1, k2, text)."""
    for batch in batches:
        for lo, n in slices(batch.column(2), 1024):
            h = chunk_lines(batch.column(2).slice(lo, n))[-1]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _run_rows(bits: np.ndarray):
    """Rows of _RUNS for (k1, k2, text): the shortest runs that pass the filter."""

    def run(batches):
        for batch in batches:
            for lo, rows in slices(batch.column(2), 1024):
                part = batch.slice(lo, rows)
                data, off = column_bytes(part.column(2))
                begin, row, first, n, size, h = _runs(data, off)
                passing = np.flatnonzero(_passes(bits, h))
                blocks = np.flatnonzero(np.diff(np.cumsum(size[passing]) // BATCH_BYTES)) + 1
                view = memoryview(np.ascontiguousarray(data))
                for keep in np.split(passing, blocks):
                    spans = [view[a:z] for a, z in zip(begin[keep].tolist(), (begin + size)[keep].tolist())]
                    digests = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in spans])
                    digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    at = pa.array(row[keep])
                    cols = [part.column(0).take(at), part.column(1).take(at)]
                    cols += [pa.array(x[keep].astype(np.int32)) for x in (first, n)] + [pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1)]
                    cols.append(pa.array([bytes(x) for x in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "first", "n", "d1", "d2", "run"])

    return run


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for part in (h, h >> np.uint64(32)):
        at = part & np.uint64(len(bits) * 64 - 1)
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _bloom(repeated: DataFrame) -> np.ndarray:
    """A Bloom filter of h as 64-bit words; the driver receives at most FILTER_BITS / 64 of them."""
    size = 2**10
    count = repeated.count()
    while size < min(16 * count, FILTER_BITS):
        size *= 2
    places = repeated.selectExpr(f"explode(array(h & {size - 1}L, shiftrightunsigned(h, 32) & {size - 1}L)) as at")
    words = places.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")
    )
    bits = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return bits.view(np.uint64)


def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """Texts without the lines of their cuts (first line times 2**32 plus number of lines), and how many went."""
    kept, gone = text.to_pylist(), [0] * len(text)
    for k, places in enumerate(cuts.to_pylist()):
        if places:
            lines = kept[k].split("\n")
            places = np.array(places, np.int64)
            first, n = places >> 32, places & (2**32 - 1)
            edges = np.bincount(first, minlength=len(lines) + 1) - np.bincount(first + n, minlength=len(lines) + 1)
            goes = np.cumsum(edges)[:-1] > 0
            kept[k] = "\n".join([lines[i] for i in np.flatnonzero(~goes)])
            gone[k] = int(goes.sum())
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.int32())], names=["text", "gone"])


def staying(found: DataFrame) -> DataFrame:
    """(d1, d2, s) of the runs that stand more than once, all of the same bytes; s is the place where one stays."""
    of = found.groupBy("d1", "d2").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "first")).alias("s"), F.min("run").alias("low"), F.max("run").alias("high")
    )
    return of.where("m > 1 and low = high").select("d1", "d2", "s")


def dedup_lines(spark: SparkSession, docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with repeated runs of lines taken out of `text`, and n_lines and removed_lines in front of its columns.

    n_lines counts the lines of the text that came in. Without counts only the columns of docs come back.
    """
    work = Workspace(spark, "line-dedup")
    keyed = docs.select(*row_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = docs.select(*row_key(), F.col("text").cast("string").alias("text")).where("text is not null")
    hashes = text.mapInArrow(_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    repeated = work.cut(hashes.where("m > 1").select("h"), "repeated")
    found = work.cut(text.mapInArrow(_run_rows(_bloom(repeated)), _RUNS), "found")
    work.drop("repeated")
    stays = work.cut(staying(found), "stays")
    later = found.drop("run").join(stays, ["d1", "d2"]).where("struct(k1, k2, first) <> s")
    cuts = later.groupBy("k1", "k2").agg(F.collect_set(F.expr("shiftleft(bigint(first), 32) + n")).alias("cuts"))
    without = F.arrow_udf(_without, "struct<text string, gone int>")
    out = keyed.join(cuts, ["k1", "k2"], "left").withColumn("rest", without(F.col("doc.text").cast("string"), F.col("cuts")))
    found = ["coalesce(size(split(doc.text, '\\n', -1)), 0) as n_lines", "rest.gone as removed_lines"]
    return out.selectExpr(
        *(found if counts else []),
        *["rest.text as text" if c == "text" else f"doc.`{c}`" for c in docs.columns],
    )
