import hashlib
import random
import re
import time

from lexiloom.llm import pii


def brute(text):
    """The contract's base spans, by plain finditer."""
    out = []
    for m in re.finditer(pii.EMAIL, text):
        out.append(("email", *m.span()))
    for m in re.finditer(pii.IP, text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(pii.CARD, text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(pii.PHONE, text):
        if 8 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_random():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "b.c", "1", "25", "255", " ", "-", "+1", "(", ")", "é", "\n", "4539 5787 6362 1486", "x@y.z"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute(t), t


def test_rows_and_redaction(spark):
    text = "Ana mail a.b@c.de, ip 10.0.0.1 and 256.1.1.1 card 4539578763621486 call +1 (212) 555-0100 now"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.personal_data(df).collect()
    assert len(found) == 5
    one = [r for r in found if r.doc_id == 1]
    assert len(one) == 2 and one[0].n_email == one[0].n_ip == one[0].n_card == one[0].n_phone == 1
    expected = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert one[0].base_sha256 == hashlib.sha256(expected.encode()).hexdigest() and one[0].spans.startswith(expected)
    assert {r.spans for r in found if r.doc_id in (2, 3)} == {""}
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame([(1, "mail a.b@c.de, é +1 (212) 555-0100!"), (2, None)], "doc_id long, text string")).collect()}
    assert clean == {1: "mail <email>, é <phone>!", 2: None}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"customer account 10.0.0.{k} active word{k} end") for k in range(12)]
    rows += [(100, "their account ZX-889-1234 active today"), (101, "other year 1999-2000 long ago")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert found[100] == "context:14:25"
    assert found[101] == ""


def test_long_runs_take_linear_time():
    begin = time.time()
    for piece in ("0", "a", "a@", "1.", "1.0.0.", "語", "+1 (", "1 ", "a1", "x@y.z,"):
        pii._instances(t := piece * (1_000_000 // len(piece)), pii.base_spans(t))
    assert time.time() - begin < 60
    assert pii.base_spans("0" * 5000 + "1.0.0.1") == [("ip", 0, 5007)]
    assert pii.base_spans("7" * 5000 + ".0.0.1") == []


def graph(rows, rounds, threshold, support):
    """The accepted instances, by plain loops over (pattern, instance, seed)."""
    seeds = {i: 1.0 for _, i, s in rows if s}
    known = dict(seeds)
    for _ in range(rounds):
        sure = {}
        for p in {p for p, _, _ in rows}:
            own = {i for q, i, _ in rows if q == p}
            good = [known[i] for i in own if i in known]
            if len(good) >= support and sum(good) / (len(own) + pii.PRIOR) >= threshold:
                sure[p] = sum(good) / (len(own) + pii.PRIOR)
        known = dict(seeds)
        for p, i, _ in rows:
            if i not in seeds and p in sure:
                known[i] = max(known.get(i, 0.0), sure[p])
    return known


def test_graph_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        seeds = set(range(40))
        rows = sorted({(rng.randrange(8), i, i in seeds) for i in range(60) for _ in range(2)} | {(100 + i % 3, i, False) for i in range(40, 60)})
        found = {r.instance: r.c for r in pii.accepted(spark.createDataFrame(rows, "pattern long, instance long, seed boolean"), 3, 0.4, 3).collect()}
        expected = graph(rows, 3, 0.4, 3)
        assert found.keys() == expected.keys() and all(abs(found[k] - c) < 1e-9 for k, c in expected.items())
        assert len(found) > 40


def test_patterns_come_in_through_discovered_instances(spark):
    rows = [(k, f"account 10.0.{k}.1 word{k}") for k in range(90)]
    codes = [f"ZX-{k}-8891" for k in range(20)]
    rows += [(200 + k, f"account {c} plain{k} and then badge {c} other{k}") for k, c in enumerate(codes)]
    rows += [(300, "my badge QQ-5512-77 here"), (301, "in the year 1999-2000 again")]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[300] == "context:9:19" and found[301] == ""
    one = spark.createDataFrame([r for r in rows if r[0] != 200], "doc_id long, text string")
    assert pii.discovered(pii._scan(one, "doc_id", "text"), rounds=1).where("key = 300").count() == 0


def test_repeated_and_null_keys_and_clashing_names(spark):
    rows = [(k, f"customer account 10.0.0.{k} active word{k} end") for k in range(12)]
    rows += [(50, "their account ZX-889-1234 active today"), (50, "a quite different text without any of it"), (None, "their account ZX-889-1234 active today"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _s string, mark int")
    found = sorted((str(r.doc_id), r.spans) for r in pii.personal_data(df).where("doc_id is null or doc_id = 50").collect())
    assert found == [("50", ""), ("50", "context:14:25"), ("None", ""), ("None", "context:14:25")]
    clean = sorted((str(r.doc_id), str(r.text), r._s, r.mark) for r in pii.redacted(df).where("doc_id is null or doc_id = 50").collect())
    assert clean == [("50", "a quite different text without any of it", "x", 1), ("50", "their account <context> active today", "x", 1), ("None", "None", "x", 1), ("None", "their account <context> active today", "x", 1)]
