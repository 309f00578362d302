import hashlib
import random
import re

from lexiloom.llm import secrets


def brute(text):
    word = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[r]}:{a}:{b}" for a, r, b in sorted(out))


def test_base_spans_and_random_ones(spark):
    rng = random.Random(5)
    parts = ["token", "Secret: ", "=", " ", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é😀", "api_KEY", ".", "\n", "ß"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "deadbeef" * 5 + " x " * 3000 + "token=abcdefgh " * 700), (1003, "aé kQ3xZ9vBw7LpT2mN8rYcD4Fh1Jg zz"), (1004, "anordinaryidentifierofwords and some_snake_case_identifier")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    syllables = ["an", "or", "di", "na", "ry", "den", "ti", "fier", "of", "word", "some", "snake", "case", "name", "let", "ter"]
    words = spark.createDataFrame([(" ".join("".join(rng.choices(syllables, k=3)) for _ in range(2000)),)], "text string")
    found = secrets.secrets(df, secrets.trained(secrets.samples(spark, words))).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        base = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in found}
    assert spans[1000] == spans[1001] == spans[1004] == "" and spans[1003] == "random:3:30"
    assert secrets.secrets(df.limit(0), secrets.trained(df.select("text").limit(0).selectExpr("text", "true random"))).count() == 0
