import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexiloom.llm import suffixtree


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return [*out, ""]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def spelling(parts):
    """The spelling model of the different training words of each batch."""
    seen = Counter()
    for part in parts:
        for w in {w for k, t in part if not held(k) for w in words(t)[:-1]}:
            b = b"  " + w.encode() + b" "
            seen.update(b[k] << 16 | b[k + 1] << 8 | b[k + 2] for k in range(len(b) - 2))
    return suffixtree.Spelling(np.array(list(seen)), np.array(list(seen.values())))


def brute(rows, model, depth):
    """Scores by a tree of dictionaries."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for k, t in rows:
        if not held(k):
            w = words(t)
            for i in range(len(w)):
                for d in range(min(depth, i) + 1):
                    counts[d][tuple(w[i - d : i])][w[i]] += 1
    root = counts[0][()]
    total, once = sum(root.values()), max(1, sum(c == 1 for w, c in root.items() if w))
    spelled = lambda w: float(model.words(np.frombuffer(w.encode(), np.uint8), np.array([len(w.encode())]))[0])
    rests = {}

    def p(context, w):
        if not context:
            return (root[w] + once * 10 ** spelled(w)) / (total + once)
        own, r = counts[len(context)][context], rest(context)
        above = p(context[1:], w)
        return above if r is None else r * above + ((own[w] - 0.5) / sum(own.values()) if own[w] >= 2 else 0)

    def rest(context):
        if context not in rests:
            own = counts[len(context)].get(context, {})
            n, listed = sum(own.values()), {w: c for w, c in own.items() if c >= 2}
            left = 1 - sum(c - 0.5 for c in listed.values()) / max(n, 1)
            sent = lambda x: round(-math.log2(x) * suffixtree._STEPS) / suffixtree._STEPS * math.log(2)
            gain = sum(c * (math.log((c - 0.5) / n) + sent(p(context[1:], w))) for w, c in listed.items()) + (n - sum(listed.values())) * math.log(max(left, 1e-12))
            rests[context] = left if listed and gain > 0.5 * len(listed) * math.log(n) else None
        return rests[context]

    def score(t):
        w = words(t)
        return sum(math.log10(p(tuple(w[max(0, i - depth) : i]), w[i])) for i in range(len(w)))

    out = [score(t) for _, t in rows]
    return out, rests


@pytest.mark.parametrize("hot", [1 << 20, 4])
def test_scores_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixtree, "HOT", hot)
    monkeypatch.setattr(suffixtree, "SHARE", 60)
    rng = random.Random(11)
    vocabulary = ["the", "a", "é", "Of", "to", *("".join(rng.choices("abcdé", k=4)) for _ in range(40))]
    passages = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(4)]
    rows = []
    for k in range(80):
        t = rng.choices(vocabulary, weights=[30, 20, 9, 9, 9, *[1] * 40], k=rng.randint(0, 25))
        if k % 3 == 0:
            t.insert(rng.randint(0, len(t)), rng.choice(passages))
        rows.append((k, " ".join(t)))
    rows += [(k + 200, t) for k, t in rows[:15]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    batches = suffixtree.batches_of(df.selectExpr("doc_id key", "text", "true train"), "bigint").collect()
    assert len(batches) == 5
    texts = dict(rows)
    expected, rests = brute(rows, spelling([[(k, texts[k]) for k in b["keys"]] for b in batches]), suffixtree.DEPTH)
    found = {r.doc_id: r.score for r in suffixtree.scored(df).collect()}
    assert max(abs(found[k] - s) for (k, _), s in zip(rows, expected)) < 1e-6
    depths = Counter(len(c) for c, r in rests.items() if r is not None)
    assert all(depths[d] for d in range(1, suffixtree.DEPTH + 1)) and any(r is None for c, r in rests.items() if len(c) == 1)
    order = [(k, " ".join(reversed(t.split()))) for k, t in rows if held(k)]
    mixed = suffixtree.scored(spark.createDataFrame([r for r in rows if not held(r[0])] + order, "doc_id long, text string")).collect()
    assert sum(r.score for r in mixed if r.held_out) < sum(found[k] for k, _ in order)  # the order of words counts


def test_spelling_is_a_distribution():
    model = spelling([[(next(k for k in range(9) if not held(k)), "abra abracadabra cab abba é")]])
    n = model.logs.shape[0]
    weight = np.ones(n)
    weight[0] = 256
    assert np.allclose((10.0 ** model.logs.astype(float) * weight).sum(axis=-1), 1, atol=1e-5)


def test_base_scores(spark):
    rng = random.Random(9)
    syllables = ["the", "An", "é", "ing", "qu", "TH", "ß", "o"]
    rows = [(k, " \n".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 80)))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (None, "the end"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    found = suffixtree.scored(df).collect()
    assert len(found) == len(rows)
    counts = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(k), held(k), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for k, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    assert suffixtree.scored(df.limit(0)).count() == 0


def test_long_text_and_other_keys(spark):
    df = spark.createDataFrame([("x", "word " * 300_000 + "q" * 200_000), ("y", "word word"), ("z", "other")], "name string, text string")
    found = {r.name: r for r in suffixtree.scored(df, "name").collect()}
    assert found["x"].n_tokens == 300_002 and found["x"].score < found["y"].score < 0


def test_held_out_texts_score_above_the_base(spark):
    found = suffixtree.scored(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert found.s > found.b


def test_packed_numbers_and_groups():
    arrays = [np.array([1 << 63, 3, 1 << 20], np.uint64), np.zeros(0, np.int32), np.array([-1, 3], np.int64), np.array([-2, 0.25], np.float32), np.array([0, 65535], np.uint16), np.zeros(3, np.uint32)]
    found = suffixtree.unpacked(suffixtree.packed(*arrays), *(a.dtype for a in arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, found))
    for hashes in ([5, 4, 5, 4, 4, 1 << 63, 5], [9 << 40, 1, 9 << 40], [7], []):  # last bits alone differ; first bits differ
        order, start, first = suffixtree._grouped(np.array(hashes, np.uint64))
        assert [hashes[k] for k in order] == sorted(hashes) and [hashes[k] for k in first] == sorted(set(hashes))
        assert first.tolist() == [hashes.index(h) for h in sorted(set(hashes))] and start.tolist() == [sorted(hashes).index(h) for h in sorted(set(hashes))]
