"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass over the texts turns each document into a short vector of transformed statistics. Labelled
training rows give each class a mean and a covariance, from sums that Spark adds up; the covariance
is shrunk towards the pooled one and towards a multiple of the identity. The score is the logistic
of the log-density difference of the two Gaussians plus the log prior ratio; densities are
Mahalanobis distances under Cholesky factors that are computed once per model.

Defined results: null text is empty text and gets the score of its (constant) statistics; null
labels are ignored, repeated labels count each time; without labels of both classes the score is
the smoothed share of label 1 (0.5 without any); a null doc_id is scored and counts as not held
out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.textkernel import column_bytes, mix64, slices, span_hashes, words
from gaugeworks.llm.workspace import Workspace, bounded_batches

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digit", "sentence_mark", "exclaim", "symbol",
    "non_ascii", "line_rate", "distinct_words", "top_word", "word_entropy", "distinct_triples", "distinct_lines",
    "caps_words", "marked_words",
)


def _classes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER = _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _classes("0123456789")
_MARK = _classes(".,;:")
_LOUD = _classes("!?")
_SYMBOL = _classes("#$%&*|<>{}[]~^=+_\\/@")


def _within(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[hi] - total[lo]).astype(float)


def _odds(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed so that none and all stay finite."""
    return np.log((k + 0.5) / (np.maximum(n - k, 0) + 0.5))


def _groups(value: np.ndarray, row: np.ndarray, rows: int):
    """Distinct values per row: their number, the largest count and the entropy of the counts."""
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    count, of = np.diff(np.concatenate([at, [len(v)]])).astype(float), r[at]
    distinct = np.bincount(of, minlength=rows).astype(float)
    total = np.bincount(row, minlength=rows).astype(float)
    top = np.zeros(rows)
    np.maximum.at(top, of, count)
    share = count / np.maximum(total[of], 1)
    entropy = np.bincount(of, -share * np.log(share), minlength=rows)
    return distinct, top, entropy, total


def statistics(col: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, off = column_bytes(col)
    lo, hi, rows = off[:-1], off[1:], len(off) - 1
    chars = _within((data & 0xC0) != 0x80, lo, hi)
    low, start, end, first = words(data, off)
    row = np.repeat(np.arange(rows), np.diff(first))
    n_words = np.diff(first).astype(float)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, minlength=rows) / np.maximum(n_words, 1)
    sd = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=rows) / np.maximum(n_words, 1) - mean**2, 0))
    h = span_hashes(low, start, end)
    distinct, top, entropy, _ = _groups(h, row, rows)
    same3 = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    triple = mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:])))[same3] if len(row) > 2 else np.zeros(0, np.uint64)
    triples, _, _, n_triples = _groups(triple, row[2:][same3] if len(row) > 2 else np.zeros(0, int), rows)
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([lo, breaks + 1]))
    cuts = cuts[cuts < len(data)]
    ends = np.minimum(np.concatenate([cuts[1:], [len(data)]]), len(data)) if len(cuts) else cuts
    line_row = np.searchsorted(off, cuts, side="right") - 1
    lines, _, _, n_lines = _groups(span_hashes(data, cuts, ends), line_row, rows)
    upper = _UPPER[data]
    loud_word = (_within(upper, start, end) >= 2) & (_within((low >= 97) & (low <= 122) & ~upper, start, end) == 0)
    marked = _SYMBOL[data[end - 1]] | _LOUD[data[end - 1]] if len(end) else np.zeros(0, bool)
    cols = [
        np.log1p(chars),
        np.log1p(n_words),
        np.log1p(mean),
        np.log1p(sd),
        _odds(_within(upper, lo, hi), chars),
        _odds(_within(_DIGIT[data], lo, hi), chars),
        _odds(_within(_MARK[data], lo, hi), chars),
        _odds(_within(_LOUD[data], lo, hi), chars),
        _odds(_within(_SYMBOL[data], lo, hi), chars),
        _odds(_within(data >= 0xC0, lo, hi), chars),
        _odds(_within(data == 10, lo, hi), chars),
        _odds(distinct, n_words),
        _odds(top, n_words),
        entropy / np.log(np.maximum(n_words, 2)),
        _odds(triples, n_triples),
        _odds(lines, n_lines),
        _odds(np.bincount(row, loud_word, minlength=rows), n_words),
        _odds(np.bincount(row, marked, minlength=rows), n_words),
    ]
    return np.stack(cols, axis=1)


def _statistics_rows(batches):
    for batch in batches:
        for lo, n in slices(batch.column(1), 512):
            part = batch.slice(lo, n)
            x = statistics(part.column(1))
            off = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=["doc_id", "x"]
            )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the transformed statistics of every text."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(_statistics_rows, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors and log determinants; log prior ratio of 1 to 0."""

    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.prior)
        if len(self.mean):
            d = [((x - m) @ w.T) for m, w in zip(self.mean, self.whiten)]
            dens = [-0.5 * ((z**2).sum(axis=1) + ld) for z, ld in zip(d, self.log_det)]
            logit = logit + dens[1] - dens[0]
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _of_text(batch):
    for lo, n in slices(batch.column(2), 512):
        yield lo, statistics(batch.column(2).slice(lo, n))


def _of_statistics(batch):
    yield 0, batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)


def _moments(read):
    """Per task and class: count, sums and sums of products of (labels 0, labels 1, what is read), as (label, i, j, v) rows."""

    def run(batches):
        i, j = np.triu_indices(len(STATISTICS) + 1)
        m = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
        for batch in batches:
            times = np.stack([batch.column(k).to_numpy() for k in (0, 1)]).astype(float)
            for lo, x in read(batch):
                x = np.hstack([np.ones((len(x), 1)), x])
                for k in (0, 1):
                    m[k] += (x * times[k, lo : lo + len(x), None]).T @ x
        for k in np.flatnonzero(m[:, 0, 0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[k][i, j])],
                names=["label", "i", "j", "v"],
            )

    return run


def class_sums(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, i, j, v): what `fit` adds up, of rows (doc_id, and x or else text) with labels (doc_id, label 0 or 1).

    Texts become sums in one pass through Python: a task never holds two Python workers.
    """
    times = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.expr("count_if(label = 0)").alias("n0"), F.expr("count_if(label = 1)").alias("n1"))
    of, read = ("x", _of_statistics) if "x" in rows.columns else ("text", _of_text)
    return times.join(rows, "doc_id").select("n0", "n1", of).mapInArrow(_moments(read), "label int, i int, j int, v double")


def fit(rows: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.01) -> Model:
    """Model from rows (doc_id, and x, their statistics, or else text) and labels (doc_id, label 0 or 1).

    The driver receives one number per class and pair of statistics, whatever the number of rows.
    """
    sums = class_sums(rows, labels)
    got = sums.groupBy("label", "i", "j").agg(F.sum("v").alias("v")).collect()
    size = len(STATISTICS) + 1
    m = np.zeros((2, size, size))
    for r in got:
        m[r.label, r.i, r.j] = m[r.label, r.j, r.i] = r.v
    n = m[:, 0, 0]
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if n.min() < 2:
        return Model(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), prior)
    mean = m[:, 0, 1:] / n[:, None]
    cov = np.stack([m[k, 1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    cov = (1 - shrink) * cov + shrink * pooled + ridge * scale
    chol = np.linalg.cholesky(cov)
    whiten = np.linalg.inv(chol)
    log_det = 2 * np.log(np.stack([np.diag(c) for c in chol])).sum(axis=1)
    return Model(mean, whiten, log_det, prior)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of statistics."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnt(spark: SparkSession, docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None) -> Model:
    """Model of the labels (doc_id, quality) of documents that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held_out())
    if stats is None:
        stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fit(stats, marked)


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs that score `least` or more, all their columns as they are; only the text goes to Python, and a truth value back."""
    bounded_batches(spark)
    model = learnt(spark, docs, labels)

    def run(col: pa.Array) -> pa.Array:
        keep = [model.score(statistics(col.slice(lo, n))) >= least for lo, n in slices(col, 512)]
        return pa.array(np.concatenate([np.zeros(0, bool), *keep]))

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from labels (doc_id, quality)."""
    work = Workspace(spark, "quality-qda")
    stats = work.cut(document_statistics(docs), "stats")
    model = learnt(spark, docs, labels, stats)
    out = scored(stats, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", F.expr("int(score >= 0.5)").alias("predicted"))
