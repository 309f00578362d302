import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import quality


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1")
    model = quality.model_of(documents, train)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.graded(documents.select("doc_id", "text"), model).join(held, "doc_id").collect()
    good = [r for r in rows if r.quality and not r.toxic]
    bad = [r for r in rows if not r.quality or r.toxic]
    assert sum(r.p_highest >= quality.KEEP for r in good) >= 0.9 * len(good)
    assert sum(r.p_highest < quality.KEEP for r in bad) >= 0.6 * len(bad)


def test_features_of_long_and_empty_texts():
    text = "word, " * 700_000 + "x" * 3_000_000 + " end."
    whole, none, null = quality.features(pa.array([text, "", None]))
    short = next(quality.features(pa.array(["word, word, " + "x" * 3_000_000 + " end."])))
    assert len(set(whole)) == len(set(short)) and len(none) == len(null) == 3


def test_edges(spark):
    rows = [(1, None, 9.0), (1, None, 9.0), (2, "", 9.0), (3, "some words", 9.0), (None, "some words", 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, P_Highest double")
    none = spark.createDataFrame([(None, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.model_of(df, none)
    out = quality.graded(df, model).collect()
    assert len(out) == 5 and set(out[0].asDict()) == {"doc_id", "text", "expected_grade", "p_highest"}
    assert quality.graded(df.limit(0), model, keep=0.5).count() == 0


def likelihood(model, rows):
    """Mean log-likelihood of grades and its gradient by each weight, by the definition of the model."""
    total, gradient, cut = 0.0, {}, [-math.inf, *model.thresholds.tolist(), math.inf]
    below = lambda z: 0.0 if z == -math.inf else 1.0 if z == math.inf else 1 / (1 + math.exp(-z))
    for x, y in rows:
        s = sum(float(model.weights[k]) for k in set(x))
        up, low = below(cut[y + 1] - s), below(cut[y] - s)
        total += math.log(up - low) / len(rows)
        slope = (low * (1 - low) - up * (1 - up)) / (up - low) / len(rows)
        for k in set(x):
            gradient[k] = gradient.get(k, 0.0) + slope
    return total, gradient


def test_fit_against_its_definition():
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        y = rng.randrange(3)
        rows.append((np.array([k for k in range(60) if rng.random() < (0.02 + 0.1 * y if k < 20 else 0.05)], dtype=np.int64), y))
    model = quality.fitted(rows, 3)
    best, gradient = likelihood(model, rows)
    for k, g in gradient.items():  # the conditions of an optimum with an L1 penalty
        w = float(model.weights[k])
        assert abs(g - math.copysign(quality.PENALTY, w)) < 2e-3 if w else abs(g) < quality.PENALTY + 2e-3
    for _ in range(20):
        moved = quality.Model(model.weights.copy(), model.thresholds + np.array([rng.uniform(-0.1, 0.1), 0.2]))
        assert likelihood(moved, rows)[0] < best + 1e-3
    for x, y in rows[:20]:
        s = sum(float(model.weights[k]) for k in set(x))
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        expected, highest = model.grades(np.array([model.score(x)]))
        assert expected[0] == pytest.approx(sum(above), abs=1e-6) and highest[0] == pytest.approx(above[-1], abs=1e-6)


def test_sample_keeps_its_bound(spark):
    df = spark.createDataFrame([(k % 5, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, grade int")
    assert len(quality.sampled(df, labels, "grade", rows=4)) == 4
