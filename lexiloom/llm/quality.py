"""Operator 7: quality classifier by ordinal cumulative-link regression.

A graded rating y in 0..K-1 has P(y <= k) = sigmoid(threshold_k - score): one weight vector over
hashed text features is shared by all grades and only the ordered thresholds differ. The expected
grade and the tail probability P(y >= K-1) select documents.

Fitted on the driver from at most ``SAMPLE`` labelled rows, a documented bound, of which only hashed
features are gathered. Scoring is map-only over every whole text with a weight vector of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Labelled rows that a model is fitted on, at most; the rows with the smallest hash of their id.
SAMPLE = 8000
#: Weights for words, then for what follows words (two bytes), then for shares of the text.
WORDS, ENDINGS, SHARES = 1 << 18, 1 << 16, 64
#: Bytes of the beginnings of words that are features too: inflected forms share them.
HEADS = (5, 7)
#: Least number of sampled texts with a feature, strength of the L1 penalty, steps of the fit.
LEAST, PENALTY, STEPS = 4, 2e-4, 400
#: A document is kept if the probability of the highest grade is at least this.
KEEP = 0.75


def features(column: pa.Array):
    """For each text, the distinct indexes of its features: hashed words (runs of letters and
    digits), beginnings of words, the two bytes after words, and
    ranges of the shares of repeated neighbours and of distinct words. An empty text has only the shares."""
    data, offsets = kernel.flat(column)
    for row, at, hashes, starts, ends in kernel.words(column, places=True, separator=kernel.MARKS):
        for k in range(len(at) - 1):
            h = hashes[at[k] : at[k + 1]]
            stop = ends[at[k] : at[k + 1]] + int(offsets[row + k])
            n = len(h)
            types = np.unique(h)
            end = int(offsets[row + k + 1])
            after = [np.where(stop + j < end, data[np.minimum(stop + j, end - 1)], 0).astype(np.int64) for j in (0, 1)] if n else [stop, stop]
            ending = WORDS + (after[0] << 8 | after[1])
            repeated = int(8 * np.count_nonzero(h[1:] == h[:-1]) / max(1, n - 1))
            distinct = int(8 * len(types) / max(1, n))
            shares = WORDS + ENDINGS + np.array([repeated, 9 + distinct, 18 + min(15, int(np.log2(n + 1)))])
            start, bits = starts[at[k] : at[k + 1]] + int(offsets[row + k]), np.uint64(WORDS - 1)
            heads = []
            for size in HEADS:
                some = np.unique(start[stop - start >= size])
                head = np.full(len(some), size, dtype=np.uint64)
                for j in range(size):
                    head = head * np.uint64(0x100000001B3) + kernel._LOWER[data[some + j]]
                heads.append((np.unique(kernel.mix(head)) & bits).astype(np.int64))
            yield np.concatenate([*heads, (types & bits).astype(np.int64), np.unique(ending), shares])


@dataclass
class Model:
    """Weights of the features and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, index: np.ndarray) -> float:
        return float(self.weights[np.unique(index)].sum())

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the highest grade."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))
        return above.sum(1), above[:, -1]


def fitted(rows: list[tuple[np.ndarray, int]], grades: int) -> Model:
    """A model of rows (feature indexes, grade) by proximal gradient steps with momentum on the mean log-likelihood.

    No rows give a model without weights whose thresholds are 0, 1, ...
    """
    size = WORDS + ENDINGS + SHARES
    if not rows:
        return Model(np.zeros(size, np.float32), np.arange(grades - 1, dtype=float))
    lists = [np.unique(x) for x, _ in rows]
    y = np.array([g for _, g in rows])
    index = np.concatenate(lists)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    often = np.bincount(index, minlength=size) >= min(LEAST, len(rows))
    index, doc = index[often[index]], doc[often[index]]
    names = np.flatnonzero(often)
    place = np.zeros(size, np.int32)
    place[names] = np.arange(len(names))
    index = place[index]
    # ordered thresholds: the first, and logarithms of the steps to the next ones
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(grades - 1))
    first, steps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    w = v = np.zeros(len(names))
    rate = 4.0 / max(1.0, float(np.bincount(doc).mean()) ** 0.5)
    n = len(y)
    for t in range(STEPS):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        s = np.bincount(doc, weights=v[index], minlength=n)
        cdf = 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), y + 1] - full[np.arange(n), y], 1e-9)
        density = np.concatenate([np.zeros((n, 1)), cdf * (1 - cdf), np.zeros((n, 1))], axis=1)
        up, low = density[np.arange(n), y + 1] / p, density[np.arange(n), y] / p
        gradient = np.bincount(index, weights=((up - low) / n)[doc], minlength=len(names))  # of the loss by each weight
        by_theta = np.array([(np.where(y == k, -up, 0) + np.where(y == k + 1, low, 0)).mean() for k in range(grades - 1)])
        following = v - rate * gradient
        following = np.sign(following) * np.maximum(np.abs(following) - rate * PENALTY, 0)
        v, w = following + (t / (t + 3)) * (following - w), following
        first -= 0.5 * by_theta.sum()
        for k in range(len(steps)):
            steps[k] = np.clip(steps[k] - 0.5 * np.exp(steps[k]) * by_theta[k + 1 :].sum(), -6, 3)
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return Model(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def sampled(df: DataFrame, labels: DataFrame, grade: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> list[tuple[np.ndarray, int]]:
    """Features and grades of at most so many labelled rows: those with the smallest hash of the key. Null keys and grades are left out."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in features(batch.column(0))], pa.list_(pa.int32())), batch.column(1)], ["x", "y"])

    chosen = labels.select(key, F.col(grade).cast("int").alias("_grade")).dropna().dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(rows)
    found = df.select(key, text).join(F.broadcast(chosen), key)  # at most ``rows`` small rows
    found = found.groupBy(key).agg(F.min(text).alias(text), F.first("_grade").alias("_grade")).select(text, "_grade")  # keys may repeat
    table = found.mapInArrow(run, "x array<int>, y int").toArrow()
    if not len(table):
        return []
    lists = table["x"].combine_chunks()
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
    return [(flat[i:j], y) for i, j, y in zip(at[:-1], at[1:], table["y"].to_pylist())]


def graded(df: DataFrame, model: Model, text: str = "text", keep: float | None = None) -> DataFrame:
    """df with expected_grade and p_highest; with keep, only rows whose p_highest is at least that.

    Rows with a null or empty text are scored by their shares alone. Columns of those names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [c for c in df.columns if c.lower() not in ("expected_grade", "p_highest")]
    place = kept.index(text)

    def run(batches):
        model = shared.value
        for batch in batches:
            expected, highest = model.grades(np.array([model.score(x) for x in features(batch.column(place))], dtype=float))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(highest)], [*kept, "expected_grade", "p_highest"])
            yield out if keep is None else out.filter(pa.array(highest >= keep))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*kept).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", expected_grade double, p_highest double")


def model_of(df: DataFrame, labels: DataFrame) -> Model:
    """The model for labels with marks quality and toxic: a document's grade is quality + 1 - toxic, 0 to 2."""
    rated = labels.withColumn("_rating", F.col("quality") + 1 - F.col("toxic"))
    return fitted(sampled(df, rated, "_rating"), 3)
