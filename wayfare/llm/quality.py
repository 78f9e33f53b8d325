"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of every whole text (characters, words, lines, repetition) are computed once and stored; all that follows reads
these few numbers and no text. cos(statistics x W + b) with Gaussian W approximates a Gaussian kernel; the normal equations
Z'Z and Z'y of the labelled rows are summed inside each partition, then between partitions, apart for each of FOLDS folds, so
that subtracting a fold's sums gives the equations of the others. The driver solves systems of FEATURES unknowns, whatever the
rows. Scores of every fold by the model of the others choose the ridge among RIDGES, and give the curve of the calibration:
shares of good rows in GRID steps of the raw score, pooled until they rise. All labelled rows take part; there is no sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import held_out, in_small_batches, persisted, release

#: Random features, folds of the cross-fit, ridges to choose from (as shares of the rows) and seed of W.
FEATURES, FOLDS, RIDGES, SEED = 256, 4, (1e-6, 1e-5, 1e-4, 1e-3), 11
#: Width of the kernel, in standard deviations of all statistics together.
WIDTH = 1.5
#: Steps of the raw score, from LOW to HIGH, in which the calibration is counted.
GRID, LOW, HIGH = 4096, -1.0, 2.0
THRESHOLD = 0.5

_ENDS = frozenset(".,;:?'\")]}»”…")
STATISTICS = (
    "log_bytes", "letters", "capitals", "digits", "signs", "spaces", "beyond_ascii", "entropy", "log_word", "distinct_words", "top_word", "echoes", "odd_ends", "wordless",
    "short_words", "log_line", "distinct_lines", "lines_ended", "capital_words", "distinct_grams",
)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | (_BYTE >= 9) & (_BYTE <= 13)
_SIGN = ~(_LETTER | _DIGIT | _SPACE)
_MEMBERS = np.stack([_LETTER, _UPPER, _DIGIT, _SIGN, _SPACE, _BYTE >= 128]).astype(float)


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; those of the empty text are zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    n = len(raw)
    letters, capitals, digits, signs, spaces, beyond = _MEMBERS @ seen / n
    share = seen[seen > 0] / n
    words = text.split()
    m = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines) or 1
    ends = Counter(w[-1] for w in words)
    grams = {*zip(words, words[1:], words[2:], strict=False)}
    return [
        float(np.log1p(n)), letters, capitals / max(letters, 1e-9), digits, signs, spaces, beyond, float(-(share * np.log2(share)).sum()), float(np.log1p(sum(map(len, words)) / m)),
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(str.__eq__, words, words[1:])) / m, sum(c for x, c in ends.items() if not x.isalnum() and x not in _ENDS) / m,
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / m, sum(c for w, c in counts.items() if len(w) < 4) / m, float(np.log1p(n / k)), len(set(lines)) / k,
        sum(x.rstrip()[-1] in ".?!" for x in lines) / k, sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / m, len(grams) / max(1, m - 2),
    ]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of every row of docs, stored: one pass over whole texts. A null text counts as empty."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kind = pa.list_(pa.float64())
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(1)], type=kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    return persisted(in_small_batches(read).mapInArrow(measure, "doc_id long, stats array<double>"), "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    width: float = WIDTH

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        w, b = rng.normal(0, 1 / (self.width * np.sqrt(d)), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        # What lies very far from all else is as far as 8 deviations.
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(stats))])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    #: Middles of the calibration's steps and their pooled shares; empty if there was nothing to learn from.
    at: np.ndarray
    share: np.ndarray
    ridge: float = 0.0

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.share) if len(self.at) else np.zeros(len(stats))


def isotonic(count: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Least-squares rising shares of good in count, in order: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for c, g in zip(count.tolist(), good.tolist(), strict=True):
        pools.append([c, g, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.repeat([g / c for c, g, _ in pools], [int(k) for *_, k in pools])


def _summed(known: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Z'Z, Z'y and rows of each fold: partitions sum their own rows, then row i of all partitions' sums meets in one group."""
    size = FEATURES + 1
    row = "fold int, i int, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = features(_matrix(batch.column(2)))
            for k in range(FOLDS):
                if (mine := fold == k).any():
                    own[k] += z[mine].T @ np.column_stack([z[mine], y[mine]])
        for k in np.flatnonzero(own[:, -1, -2]):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(own[k].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, dtype=np.int32)), pa.array(np.arange(size, dtype=np.int32)), lists], names=["fold", "i", "sums"])

    def total(rows: pa.Table) -> pa.Table:
        whole = _matrix(rows["sums"].combine_chunks()).sum(axis=0)
        return pa.table({"fold": rows["fold"].slice(0, 1), "i": rows["i"].slice(0, 1), "sums": pa.array([whole.tolist()])})

    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for r in known.select("fold", "y", "stats").mapInArrow(partial, row).groupBy("fold", "i").applyInArrow(total, row).collect():
        a[r.fold, r.i], b[r.fold, r.i] = r.sums[:-1], r.sums[-1]
    return a, b, a[:, -1, -1]


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", held: Column | None = None) -> Model:
    """A model of all labelled rows of stats (measured()), but those held out: by default crc32(doc_id as text) mod 3 is 1.

    An id with several labels counts as bad if one says so; each row of a repeated id counts.
    """
    held = held_out(F.col("doc_id"), 3, 1) if held is None else held
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.when(F.min("y") > 0, 1.0).otherwise(0.0).alias("y"))
    fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")), F.lit(FOLDS)).cast("int")
    known = persisted(stats.join(known, "doc_id").select(fold.alias("fold"), "y", "stats"), "labelled")
    d = len(STATISTICS)
    moments = known.agg(*[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        return Model(Features(np.zeros(d), np.ones(d)), np.zeros(FEATURES + 1), np.array([]), np.array([]))
    mean, scale = np.array(moments[0::2]), np.array(moments[1::2])
    features = Features(mean, np.where(scale > 1e-9, scale, 1.0))
    a, b, n = _summed(known, features)

    def solved(a: np.ndarray, b: np.ndarray, n: float, ridge: float) -> np.ndarray:
        return np.linalg.solve(a + ridge * max(n, 1) * np.diag([1.0] * FEATURES + [1e-6]), b)

    # fold x unknown x ridge: the model of the other folds.
    others = np.stack([np.stack([solved(a.sum(0) - a[k], b.sum(0) - b[k], n.sum() - n[k], r) for r in RIDGES], axis=1) for k in range(FOLDS)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            z = features(_matrix(batch.column(2)))
            raw = np.stack([z @ w for w in others])[fold, np.arange(len(z))]
            step = np.clip((raw - LOW) / (HIGH - LOW) * GRID, 0, GRID - 1).astype(np.int32)
            error = (raw - y[:, None]) ** 2
            for r in range(len(RIDGES)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), r, dtype=np.int32)), pa.array(step[:, r]), pa.array(y), pa.array(error[:, r])], names=["ridge", "step", "y", "error"])

    found = known.select("fold", "y", "stats").mapInArrow(scored, "ridge int, step int, y double, error double").groupBy("ridge", "step").agg(F.count("*").alias("n"), F.sum("y").alias("good"), F.sum("error").alias("error")).collect()
    best = min(range(len(RIDGES)), key=lambda r: (sum(x.error for x in found if x.ridge == r), r))
    curve = sorted((x.step, x.n, x.good) for x in found if x.ridge == best)
    step, count, good = map(np.array, zip(*curve, strict=True))
    return Model(features, solved(a.sum(0), b.sum(0), n.sum(), RIDGES[best]), LOW + (step + 0.5) * (HIGH - LOW) / GRID, isotonic(count, good), RIDGES[best])


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of stats (measured()): doc_id, held_out, score, predicted. No shuffle.

    Empty texts have statistics like any other and get the score of these. Without labelled rows every score is 0. Repeated
    rows are scored one by one and alike; an empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(_matrix(batch.column(1))) if len(batch) else np.array([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=pa.float64())], names=["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
