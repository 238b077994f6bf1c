"""Quality classifier: random Fourier features, ridge regression by partition-summed normal equations, isotonic calibration.

Each text gives a few statistics (lengths, shares of character classes, repetition). They are standardised and mapped by
random cosines whose inner products approximate a Gaussian kernel. Every partition of labelled rows adds up its share of
the normal equations; their sums, whose size depends on the number of features alone, give the ridge weights. Rows of the
calibration fold, which the ridge never sees, are counted in bins of the raw score, and pooling adjacent violators over the
bins makes the score a calibrated probability. All labelled rows are used. Standardised statistics beyond 8 deviations count
as 8, for the cosines say nothing there, and the ridge's scores below -0.5 or above 1.5 as these, the ends of the bins.

Edge cases: null and empty texts have all statistics 0 and a score like any other; labels that are null count as none, of
several labels of an id the greatest counts; without labelled training rows every score is 0.5, with one class all scores
follow its smoothed share; repeated rows score alike; a null doc_id is scored and never trains; an empty table gives no
rows; columns other than doc_id and text are ignored (score_documents) or kept (keep_good).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._spark import cut, short_lived_shuffles
from ledgerloom.llm._text import grams, slices, words

FEATURES = (
    "log_bytes", "word_length", "upper", "digit", "stop", "symbol", "space", "beyond_ascii",
    "distinct_words", "top_word", "same_as_before", "distinct_lines", "words_a_line", "repeated_grams", "long_words",
)
COSINES, BANDWIDTH, RIDGE = 192, 4.0, 1e-3
FOLDS, OUT_FOLD = 3, 1
BINS = 1024
#: Labelled rows that add to one partial sum, about.
PART_ROWS = 20_000

_CLASS = np.full(256, 5, np.uint8)  # other ASCII
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[128:] = 6


def _statistics(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(FEATURES)))
    for a, b, raw, offs in slices(column):
        starts, ends, hashes, at = words(raw, offs)
        runs = grams(hashes, 4)
        kinds = _CLASS[raw]
        for i in range(b - a):
            lo, hi, x, y = offs[i], offs[i + 1], at[i], at[i + 1]
            size, n = hi - lo, y - x
            if not size:
                continue
            share = np.bincount(kinds[lo:hi], minlength=7) / size
            letters = share[0] + share[1]
            row = out[a + i]
            row[:8] = np.log1p(size), 0, share[1] / letters if letters else 0, share[2], share[3], share[5], share[4], share[6]
            lines = raw[lo:hi].tobytes().split(b"\n")
            row[11:13] = len(set(lines)) / len(lines), np.log1p(n / len(lines))
            if n:
                w, lengths = hashes[x:y], ends[x:y] - starts[x:y]
                counts = np.unique(w, return_counts=True)[1]
                row[1], row[8], row[9] = np.log1p(lengths.mean()), len(counts) / n, counts.max() / n
                row[10], row[14] = (w[1:] == w[:-1]).mean() if n > 1 else 0, (lengths > 16).mean()
                if n >= 4:
                    row[13] = 1 - len(np.unique(runs[x : y - 3])) / (n - 3)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array<double> in the order of FEATURES) for every row of docs."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics(batch.column(1))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        describe, "doc_id long, x array<double>"
    )


class Cosines:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(11))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / BANDWIDTH, (len(mean), COSINES))
        self.phase = rng.uniform(0, 2 * np.pi, COSINES)

    def __call__(self, lists: pa.Array) -> np.ndarray:
        x = np.asarray(lists.flatten()).reshape(-1, len(self.mean))
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.phase) * np.sqrt(2 / COSINES)
        return np.hstack([z, np.ones((len(z), 1))])


def _normal_equations(train: DataFrame, cosines: Cosines) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over train (x, y)."""
    size = COSINES + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = cosines(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        i = np.flatnonzero(np.triu(np.ones((size, size + 1))))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel()[i])], names=["i", "v"])

    rows = train.mapInArrow(add_up, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(size * (size + 1))
    for i, v in rows:
        flat[i] = v
    full = flat.reshape(size, size + 1)
    upper = full[:, :size]
    return upper + np.triu(upper, 1).T, full[:, size]


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to y with weights n, for ascending x."""
    blocks: list[list[float]] = []
    for mean, weight in zip(y, n, strict=True):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            p = blocks[-1]
            blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + k]
    return np.concatenate([np.full(int(k), m) for m, _, k in blocks]) if blocks else np.zeros(0)


def _crc(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


class Model:
    """A learned classifier; without cosines every score is prior."""

    def __init__(self, prior: float, cosines: Cosines | None = None, beta=None, x=None, y=None):
        self.prior, self.cosines, self.beta, self.x, self.y = prior, cosines, beta, x, y

    def raw(self, lists: pa.Array) -> np.ndarray:
        return np.clip(self.cosines(lists) @ self.beta, -0.5, 1.5)

    def score(self, lists: pa.Array) -> np.ndarray:
        return np.interp(self.raw(lists), self.x, self.y) if self.cosines else np.full(len(lists), self.prior)


def learn(described: DataFrame, labels: DataFrame) -> Model:
    """A classifier of described (doc_id, x), from the labels (doc_id, quality) outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .filter("y is not null and doc_id is not null")
        .filter(_crc() % FOLDS != OUT_FOLD)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    labelled = cut(described.join(known, "doc_id").withColumn("calibrates", F.floor(_crc() / FOLDS) % 4 == 0))
    cells = [F.get("x", i) for i in range(len(FEATURES))]
    sums = labelled.agg(
        F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *(F.avg(c) for c in cells), *(F.stddev_pop(c) for c in cells)
    ).first()
    n, good = sums[0], sums[1]
    if good in (0, n):
        return Model((good + 1) / (n + 2))
    f = len(FEATURES)
    cosines = Cosines(np.array(sums[2 : 2 + f]), np.maximum(np.array(sums[2 + f :]), 1e-6))
    train = labelled.filter(~F.col("calibrates")).select("x", "y").repartition(n // PART_ROWS + 1)
    a, b = _normal_equations(train, cosines)
    model = Model(good / n, cosines, np.linalg.solve(a + RIDGE * max(a[-1, -1], 1) * np.eye(len(a)), b))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(batch.column(1)))], names=["y", "raw"])

    bins = (
        labelled.filter("calibrates").select("y", "x").mapInArrow(raw, "y int, raw double")
        .groupBy(F.floor((F.col("raw") + 0.5) / 2 * (BINS - 1)).alias("bin"))
        .agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )  # at most BINS rows
    model.x, y, n_ = (np.array([r[k] for r in bins] or [0.0, 1.0], float) for k in ("x", "y", "n"))
    model.y = pool_adjacent(model.x, y, n_)
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels: doc_id, quality."""
    with short_lived_shuffles(docs.sparkSession):
        described = cut(statistics(docs))
        model = learn(described, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], names=["doc_id", "score"])

    return described.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (_crc() % FOLDS == OUT_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; texts are described twice, so that none is shuffled."""
    with short_lived_shuffles(docs.sparkSession):
        model = learn(cut(statistics(docs)), labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics(batch.column(at))
            offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            scores = model.score(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())))
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
