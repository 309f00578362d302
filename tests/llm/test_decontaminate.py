import random

import numpy as np
import pytest

from lexiloom.llm import decontaminate


def brute(text, item, least):
    """Greedy string tiling by its definition."""
    free_t, free_i, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best, found = 0, []
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and free_t[a + n] and free_i[b + n]:
                    n += 1
                if n >= least and n > best:
                    best, found = n, []
                if n >= least and n == best:
                    found.append((a, b))
        if not found:
            return covered
        for a, b in found:
            if all(free_t[a : a + best]) and all(free_i[b : b + best]):
                free_t[a : a + best] = [False] * best
                free_i[b : b + best] = [False] * best
                covered += best


@pytest.mark.parametrize("at_once", [decontaminate.AT_ONCE, 6])
def test_tiling_against_its_definition(monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    rng = random.Random(4)
    for _ in range(500):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 24))], dtype=np.uint64)
        text = np.array([rng.randrange(4) for _ in range(rng.randint(0, 60))], dtype=np.uint64)
        matches = decontaminate.Benchmark([(0, item)]).matches(text)
        made = decontaminate.tiles(len(text), len(item), matches[0]) if 0 in matches else []
        assert sum(n for _, _, n in made) == brute(text.tolist(), item.tolist(), min(5, len(item)))


def test_long_text_of_one_word_and_other_types(spark):
    items = spark.createDataFrame([("x", "a " * 200), ("y", "p q r s t u v")], "item_id string, text string")
    df = spark.createDataFrame([(1.5, "a " * 100_000), (2.5, "z p q r s t u v z"), (3.5, "q " * 100_000)], "doc_id double, text string")
    found = sorted((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in decontaminate.leaks(df, items).collect())
    assert found == [(1.5, "x", 1, 200), (2.5, "y", 1, 7)]
    dated = items.selectExpr("date'2020-01-01' item_id", "text", "1 coverage")
    assert decontaminate.leaks(df, dated).count() == 2


def test_reordered_passages_and_edges(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "Two words"), (3, None), (None, "a b c d e f"), (4, " ")], "item_id long, text string")
    moved = "xx " + " ".join(words[20:]) + " yy " + " ".join(words[:20]) + " zz"
    rows = [(1, moved, 0.5), (1, moved, 0.5), (2, " ".join(words[:19]), 0.5), (3, "here tWo\n WORDS there", 0.5), (4, None, 0.5), (5, "", 0.5), (None, "Two words", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    for block in (decontaminate.BLOCK_WORDS, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = sorted(((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in decontaminate.leaks(df, items).collect()), key=str)
        assert found == sorted([(1, 1, 2, 40), (1, 1, 2, 40), (3, 2, 1, 2), (None, 2, 1, 2)], key=str)
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminated(df, items).collect()) == [0, 2, 4, 5]
    assert decontaminate.leaks(df, items.limit(0)).count() == decontaminate.leaks(df.limit(0), items).count() == 0


def test_items_with_shared_and_null_ids(spark, monkeypatch):
    texts = ["a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string").coalesce(1)
    df = spark.createDataFrame(list(enumerate([*texts, "none of them"])), "doc_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 6):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()]
        assert sorted(found, key=str) == [(0, 1), (1, 1), (2, None), (3, None)]
    assert [r.doc_id for r in decontaminate.decontaminated(df, items).collect()] == [4]
