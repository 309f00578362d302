import random

import numpy as np

from lexiloom.llm import jaccard


def brute(rows):
    def shingles(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, up = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def cases(rng):
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(40)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for k in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if k % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = shared
        out.append((k, " ".join(words).upper() if k % 7 == 0 else "\t\n ".join(words)))
    return [*out, (900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one TWO"), (905, "two one"), (906, "É one two three four five"), (907, "é one two three four five")]


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    for listed, most in ((1 << 22, 4096), (0, 7)):
        monkeypatch.setattr(jaccard, "LISTED", listed)
        monkeypatch.setattr(jaccard, "MOST", most)
        if most < 10:  # all links by step 2
            monkeypatch.setattr(jaccard, "near_copies", lambda ones: ones.limit(0).selectExpr("id src", "id dst"))
        rows = cases(rng)
        df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
        assert found == brute(rows)


def test_edges(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "x"), (3, text + " k"), (8, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert found == sorted([(5, 6, 3), (5, 6, 3), (None, 6, 3), (None, 1, None), (3, 7, 3), (8, 0, 8)], key=str)
    assert sorted((r.doc_id or 0) for r in jaccard.representatives(df).collect()) == [0, 0, 3, 8]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_bound_of_bitmaps_and_prefix():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) * 9 // 10], rng.integers(0, 1 << 63, len(a) // 10, dtype=np.uint64)]))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        size = min(len(x), len(y))
        differing = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
        assert 2 * len(np.intersect1d(a, b)) <= len(a) + len(b) - differing
        if jaccard.linked(a, b):
            assert np.isin(a[: jaccard.prefix_length(len(a))], b[: jaccard.prefix_length(len(b))]).any()


def test_bands_hold_every_pair_of_sizes():
    n = np.arange(1, 3000)
    band = jaccard.band_of(n)
    for k in n.tolist():
        fit = n[(4 * n >= 3 * k) & (3 * n <= 4 * k)]
        assert abs(band[fit - 1] - band[k - 1]).max() <= 1


def test_repeated_keys_and_other_keys(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " x"), (8, b + " x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5)]
    df = spark.createDataFrame([("q", a), ("p", a + " x"), ("z", b)], "name string, text string")
    assert sorted((r.name, r.component_id) for r in jaccard.near_duplicates(df, "name").collect()) == [("p", "p"), ("q", "p"), ("z", "z")]


def test_long_text(spark):
    rng = random.Random(2)
    words = [str(rng.randrange(50_000)) for _ in range(300_000)]
    other = list(words)
    for k in range(0, 300_000, 60):
        other[k] = "x"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "short text")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
