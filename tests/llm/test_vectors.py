import numpy as np
import pytest

from lexiloom.llm import vectors


def brute(rows, least=0.98):
    good = {}
    for key, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v or []], dtype=float)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            good[key] = (label, x / np.sqrt((x * x).sum()))
    up = {k: k for k, _, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    n, keys = dict.fromkeys(up, 0), sorted(good)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y >= least:
                n[a] += 1
                n[b] += 1
                r, s = sorted((root(a), root(b)))
                up[s] = r
    return {k: (n[k], root(k), root(k) == k) for k in up}


@pytest.mark.parametrize("block", [vectors.BLOCK, 16])
def test_recall_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((60, 64))
    for k in range(600):
        x = centres[k % 60] + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.16, 0.5])
        rows.append((k, [float(c) for c in np.float32(x)], int(k % 60 % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [1.0, None], 1), (1003, [float("nan")] * 64, 1), (1004, [1.0] * 64, None), (1005, [], 1), (1006, [1e-300, 2e-300], 1), (1007, [1e300, 2e300], 1)]
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(30)] + [(3000, rows[5][1], 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    expected = brute(rows)
    assert set(found) == set(expected) and sum(n for n, _, _ in expected.values()) > 1500
    missed = {k for k in found if found[k] != expected[k]}
    assert not missed - {1006, 1007}, [(found[k], expected[k]) for k in missed]
    assert found[1006] == (1, 1006, True) and found[1007] == (1, 1006, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0) for r in vectors.near_duplicates(twice).collect()) == [0, 1, 1]


def test_repeated_keys_and_other_keys(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert found == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1)]
    named = vectors.near_duplicates(df.selectExpr("concat('k', vec_id) vec_id", "embedding", "'x' label")).collect()
    assert sorted((r.vec_id, r.component_id) for r in named) == [("k1", "k1"), ("k1", "k1"), ("k2", "k1"), ("k3", "k1")]
