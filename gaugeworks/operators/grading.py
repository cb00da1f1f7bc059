"""Grading of answers: differences of results, calibration, bands, held-out questions, nearest anchors, literals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# When a question is routed to a lens.
FLOOR, CONFIDENT, MARGIN = 0.78, 0.95, 0.07
# Numbers of the vectors of a tile; a task holds two tiles.
TILE_VALUES = 8_000_000


def difference(a: DataFrame, b: DataFrame, places: int = 6) -> DataFrame:
    """Rows that one result has more often than the other; surplus > 0: a has more. Numbers are rounded."""

    def signed(df: DataFrame, sign: int) -> DataFrame:
        cols = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
        return df.select(*cols, F.lit(sign).alias("surplus"))

    both = signed(a, 1).unionByName(signed(b, -1))
    return both.groupBy(*a.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def calibration(df: DataFrame, p: Column, right: Column, bins: int = 10) -> DataFrame:
    """Per bin of stated confidence: answers, mean confidence, accuracy, gap, Brier score. Nulls count nowhere."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    known = df.select(p.cast("double").alias("p"), right.cast("double").alias("y")).where("p is not null and y is not null")
    out = known.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg("p").alias("confidence"),
        F.avg("y").alias("accuracy"),
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
    )
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row from `calibration`: Brier score and expected calibration error over all answers."""
    n = F.sum("answers")
    return bins.agg((F.sum(F.expr("brier * answers")) / n).alias("brier"), (F.sum(F.expr("gap * answers")) / n).alias("error"))


def coverage_curve(df: DataFrame, p: Column, right: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold: share of answers at least as confident and their accuracy, from one pass."""
    facts = []
    for t in thresholds:
        facts.append(F.struct(F.lit(t).alias("threshold"), (F.count_if(p >= t) / F.count(p)).alias("coverage"), F.avg(F.when(p >= t, right.cast("double"))).alias("accuracy")))
    return df.agg(F.array(*facts).alias("t")).select(F.inline("t"))


def order_statistic(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Per group the value at place floor(q * (n - 1)), not interpolated; nulls have no place.

    Equal values are counted before the window, so it holds one row per distinct value of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*by)
    placed = counts.withColumn("upto", F.sum("m").over(w.orderBy(value))).withColumn("n", F.sum("m").over(w))
    at = F.floor(F.lit(q) * (F.col("n") - 1))
    return placed.where((F.col("upto") > at) & (F.col("upto") - F.col("m") <= at)).select(*by, F.col(value).alias("band"))


def plain(text: str) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))


def held_out(df: DataFrame, text: str, seed: str, percent: int) -> DataFrame:
    """df with `held_out`, decided by the plain text and the seed, so that equal questions fall on one side."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(plain(text), F.lit(""))))
    return df.withColumn("held_out", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)


def contaminated(held: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Held-out rows whose plain text is among the known ones."""
    seen = known.select(plain(text).alias("plain")).where("plain <> ''").distinct()
    return held.withColumn("plain", plain(text)).join(seen, "plain", "left_semi").drop("plain")


def cosine(column: str, vector: list[float]) -> Column:
    """Cosine of an array column with a fixed vector; null for other lengths and zero vectors."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    dot = F.aggregate(F.zip_with(column, v, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = reduce(lambda s, x: s + x * x, map(float, vector), 0.0) ** 0.5
    return F.when(F.size(column) == len(vector), F.try_divide(dot, norm * F.lit(own)))


def nearest(df: DataFrame, key: str, column: str, vector: list[float], k: int) -> DataFrame:
    """The k rows nearest to a vector, equal ones by key."""
    scored = df.select(key, cosine(column, vector).alias("cosine")).where("cosine is not null")
    return scored.orderBy(F.desc("cosine"), key).limit(k)


def route(df: DataFrame, lens: str, column: str, vector: list[float]) -> DataFrame:
    """Per lens the best cosine of its anchors with a question, its place, and whether the question goes there.

    The first lens takes the question when it is confident, or above the floor and ahead of the second by the margin.
    """
    best = df.groupBy(lens).agg(F.max(cosine(column, vector)).alias("best")).where("best is not null")
    top = best.orderBy(F.desc("best"), lens).limit(2).agg(F.sort_array(F.collect_list("best"), False).alias("t"))  # two rows
    first, second = F.col("t")[0], F.coalesce(F.get("t", F.lit(1)), F.lit(-1.0))
    sure = (first >= CONFIDENT) | ((first >= FLOOR) & (first - second >= MARGIN))
    return best.join(F.broadcast(top)).select(lens, "best", ((F.col("best") == first) & sure).alias("routed"))


def own_anchors(df: DataFrame, lens: str, text: str) -> DataFrame:
    """Anchors whose text belongs to one lens only; shared ones tell nothing about where to go."""
    shared = df.groupBy(text).agg(F.count_distinct(lens).alias("lenses")).where("lenses > 1").select(text)
    return df.join(shared, text, "left_anti")


def cross_claims(df: DataFrame, lens: str, key: str, column: str, floor: float = 0.95) -> DataFrame:
    """Per pair of lenses that claim nearly the same: the largest cosine of their anchors, at `floor` or above.

    Equal vectors of a lens count once. All others are dealt into tiles, and each pair of tiles meets in one
    group, so every pair of anchors is met exactly once, and none is left out for want of a coordinate that tells
    far ones apart. Work grows with the square of the distinct vectors, where their boxes (`_met`) do not part them.
    """
    norm = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + double(x) * double(x)))")
    vector = F.col(column) if dict(df.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")
    rows = df.select(F.col(lens).alias("lens"), vector.alias("v")).where("lens is not null and v is not null")
    rows = rows.where(norm > 0).distinct()
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    tiles = max(-(-n * width // TILE_VALUES), min(6, -(-n // 4096)), 1)
    own = rows.withColumn("tile", F.pmod(F.xxhash64("lens", "v"), F.lit(tiles)).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pair = [F.size("v").alias("size"), F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    kind = rows.schema["lens"].dataType.simpleString()
    met = dealt.select("lens", "v", "tile", *pair).groupBy("size", "a", "b").applyInArrow(lambda t: _met(t, floor), f"x {kind}, y {kind}, cosine double")
    best = met.groupBy(F.least("x", "y").alias("lens_a"), F.greatest("x", "y").alias("lens_b")).agg(F.max("cosine").alias("cosine"))
    return best.where(F.col("cosine") >= floor)


def _met(table: pa.Table, floor: float) -> pa.Table:
    """Best cosines between different lenses for the rows of two tiles (or inside one), where they reach the floor.

    Rows go in blocks of near ones. Two blocks whose boxes are farther apart than unit vectors at the floor are not
    compared; others are first in single precision, and in double where that may reach the floor.
    """
    coded = table["lens"].combine_chunks().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(code), -1)
    tile = table["tile"].to_numpy()
    unit = (v / np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))[:, None]).astype(np.float32)
    slack = max(1e-4, 2e-7 * v.shape[1])
    sides = [[at[np.argsort(code[at], kind="stable")] for at in _blocks(unit, np.flatnonzero(tile == t))] for t in np.unique(tile)]
    boxes = [(np.array([unit[at].min(0) for at in s]), np.array([unit[at].max(0) for at in s])) for s in sides]
    (low, high), found, held, most_held = boxes[-1], [], 0, 1 << 20

    def exact(at):
        rows = v[at].astype(np.float64)
        return rows / np.sqrt((rows * rows).sum(1))[:, None]

    for p, left in enumerate(sides[0]):
        gap = np.maximum(np.maximum(low - boxes[0][1][p], boxes[0][0][p] - high), 0).astype(np.float64)
        apart = (gap * gap).sum(1) > 2 - 2 * floor + 2 * slack
        a, firsts = unit[left], np.flatnonzero(np.diff(code[left], prepend=-1))
        for q in range(p if len(sides) == 1 else 0, len(sides[-1])):
            if apart[q] or (a @ unit[right := sides[-1][q]].T).max() < floor - slack:
                continue
            starts = np.flatnonzero(np.diff(code[right], prepend=-1))
            most = np.maximum.reduceat(np.maximum.reduceat(exact(left) @ exact(right).T, firsts, axis=0), starts, axis=1)
            x, y = code[left[firsts]][:, None], code[right[starts]][None, :]
            i, j = np.nonzero((x != y) & ~(most < floor))
            x, y = x[i, 0], y[0, j]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), most[i, j]], 1))
            held += len(x)
            if held > most_held:
                found = [_best_per_pair(found)]
                held, most_held = len(found[0]), max(1 << 20, 2 * len(found[0]))
    best = _best_per_pair(found)
    x, y = (names.take(pa.array(best[:, k].astype(np.int64))) for k in (0, 1))
    return pa.table({"x": x, "y": y, "cosine": pa.array(best[:, 2])})


def _best_per_pair(found: list[np.ndarray]) -> np.ndarray:
    """Of rows (lens, lens, cosine), that with the largest cosine for each pair of lenses."""
    rows = np.concatenate([np.zeros((0, 3)), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(np.any(rows[1:, :2] != rows[:-1, :2], axis=1), True)[: len(rows)]]


def _blocks(v: np.ndarray, at: np.ndarray, most: int = 1024) -> list[np.ndarray]:
    """The rows `at` of v in parts of at most so many, halved along the coordinate that varies most."""
    out, todo = [], [at]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        half = len(at) // 2
        at = at[np.argpartition(v[at, v[at].var(0).argmax()], half)]
        todo += [at[half:], at[:half]]
    return out


def accuracy_trend(runs: DataFrame, lens: str, clock: str, score: str) -> DataFrame:
    """Per lens: runs, the latest score, the one before it and the change; a run per lens and moment."""
    w = W.partitionBy(lens).orderBy(F.desc(clock))
    nth = runs.select(lens, clock, score, F.row_number().over(w).alias("nth"))
    out = nth.groupBy(lens).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(F.when(F.col("nth") == 1, F.col(score))).alias("latest"),
        F.max(F.when(F.col("nth") == 2, F.col(score))).alias("before"),
    )
    return out.withColumn("change", F.col("latest") - F.col("before"))


def split_accuracy(cases: DataFrame, split: str, covered: str, correct: str) -> DataFrame:
    """Per part of a split: cases, the share that was answered, and of those the share that was right."""
    per = cases.groupBy(split).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col(covered)).alias("answered"), F.count_if(F.col(covered) & F.col(correct)).alias("right")
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return per.select(split, "cases", ratio("answered", "cases").alias("coverage"), ratio("right", "answered").alias("accuracy"))


def rewritten(df: DataFrame, column: str, literals: list[str], aliases: dict[str, str] = {}) -> DataFrame:
    """Per literal the one value of the column that it names, case and blanks aside or by an alias; null if none or several."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    low = F.lower(F.trim("value"))
    each = []
    for x in literals:
        names = [x.strip().lower()] + [v.strip().lower() for a, v in aliases.items() if a.strip().lower() == x.strip().lower()]
        hit = F.when(low.isin(names), F.col("value"))
        each.append(F.struct(F.lit(x).alias("literal"), F.coalesce(F.max(F.when(F.col("value") == x, F.col("value"))), F.when(F.count(hit) == 1, F.max(hit))).alias("value")))
    return values.agg(F.array(*each).alias("t")).select(F.inline("t"))


def coverage_gaps(asked: DataFrame, name: str, governed: DataFrame, metric: str) -> DataFrame:
    """Names that were asked for and that no governed metric has, by the same name or by the same words in any order."""
    words = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+"))), " ")
    counts = asked.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count(F.lit(1)).alias("asked"))
    counts = counts.withColumn("words", words("name"))
    return counts.join(governed.select(words(metric).alias("words")).distinct(), "words", "left_anti").drop("words")


def unknown_literals(df: DataFrame, column: str, literals: list[str]) -> DataFrame:
    """Per literal that a column's values lack: the value nearest by edits, and how many; one pass over the values."""
    values = df.select(F.col(column).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.lit(1).alias("one"))
    each = []
    for x in literals:
        edits = F.levenshtein(F.lower("v"), F.lit(x.lower()))
        near = F.min(F.struct(edits.alias("edits"), F.col("v").alias("value")))
        each.append(F.struct(F.lit(x).alias("literal"), F.coalesce(F.max(F.col("v") == x), F.lit(False)).alias("known"), near.alias("near")))
    out = values.agg(F.array(*each).alias("t")).select(F.inline("t")).where("not known")
    return out.select("literal", F.col("near.value").alias("nearest"), F.col("near.edits").alias("edits"))


def conflicts(df: DataFrame, term: str, body: str) -> DataFrame:
    """Terms that are defined in more than one way, case and white space aside."""
    canon = F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))
    return df.groupBy(term).agg(F.count_distinct(canon).alias("ways"), F.count(F.lit(1)).alias("definitions")).where("ways > 1")


def agreed(df: DataFrame, metric: str, tier: str, value: str) -> DataFrame:
    """Per metric, among variants of its best (lowest) tier, the value most of them give; ties to the smaller value."""
    best = df.groupBy(metric).agg(F.min(tier).alias(tier))
    counts = df.join(best, [metric, tier]).groupBy(metric, value).agg(F.count(F.lit(1)).alias("variants"))
    first = F.min(F.struct((-F.col("variants")).alias("m"), F.col(value).alias("value")))
    return counts.groupBy(metric).agg(first.alias("s")).select(metric, F.col("s.value").alias(value), (-F.col("s.m")).alias("variants"))
