import random
import re

from lexiloom.llm import lines


def brute(rows, least):
    """Removed units as (key, start, end, first key, first start)."""
    first, found = {}, []
    for key, text in sorted(set(rows)):
        place = 0
        for unit, gap in zip(re.split(lines.BREAK, text), [*re.findall(lines.BREAK, text), ""]):
            norm = " ".join(unit.lower().split())
            if norm and len(norm.split(" ")) >= least:
                found.append((key, place, place + len(unit), norm))
                first[norm] = min(first.get(norm, (key, place)), (key, place))
            place += len(unit) + len(gap)
    return sorted((k, a, b, *first[n]) for k, a, b, n in found if first[n] != (k, a))


def test_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["one two three.", "One  two\tthree.", "é ö. ", "😀 a b c d!", "\n", "\n\n", " ", "x", "last one here? ", ""]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(120)]
    rows += [(7, rows[7][1]), (200, "same words again. " * 900)]
    df = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id long, text string, digest int, start int")
    found = sorted(map(tuple, lines.repeats(df, least_words=3).distinct().collect()))
    assert found == brute(rows, 3)
    texts = dict(rows)
    for r in lines.deduplicated(df, least_words=3).collect():
        gone = [(a, b) for k, a, b, _, _ in found if k == r.doc_id]
        assert [(s.start, s.end) for s in r.removed or []] == gone
        assert r.text == "".join(c for k, c in enumerate(texts[r.doc_id]) if not any(a <= k < b for a, b in gone))


def test_edges(spark):
    long = "some eight words that stand in one line"
    df = spark.createDataFrame([(None, long), (1, long), (2, None), (3, "")], "doc_id long, text string")
    assert [r.doc_id for r in lines.repeats(df).collect()] == [1]
    assert {r.doc_id: r.text for r in lines.deduplicated(df).collect()} == {None: long, 1: "", 2: None, 3: ""}
    assert lines.repeats(df.limit(0)).count() == lines.deduplicated(df.limit(0)).count() == 0


def test_whole_lines(spark):
    rows = [(1, "Hi!\nthe and. to thanedble the, anea. x\n\nred\nsun"), (2, "The and.  to thanedble the, anea. x\nhi!\n\nred sun"), (3, "new\n\nred \nsun\n\n \n"), (4, "a hi! b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, lines.repeats(df, whole=True).collect()))
    first = rows[0][1]
    there = [(2, rows[1][1][:35], first.index("the")), (2, "hi!", 0), (2, "red sun", first.index("red")), (3, "red \nsun", first.index("red"))]
    assert [(k, dict(rows)[k][a:b], s) for k, a, b, _, s in found] == there and {r[3] for r in found} == {1}
    assert [r.text for r in lines.deduplicated(df, whole=True).orderBy("doc_id").collect()] == [first, "\n\n\n", "new\n\n\n\n \n", "a hi! b"]


def test_outermost(spark):
    line = "one two three four five six seven eight. short end. "
    df = spark.createDataFrame([(None, line), (1, line), (2, "other start. " + line + "tail")], "doc_id long, text string")
    found = sorted(tuple(r)[:3] for r in lines.repeats(df, whole=True).collect())
    assert found == [(1, 0, len(line)), (2, 13, 13 + 40)]
