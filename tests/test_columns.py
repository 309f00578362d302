"""Columns that formats and callers use, on the cases that define them."""

import json

from pyspark.sql import functions as F

from lexiloom.functions import gametext, langcodes, predicates, text, wire
from lexiloom.operators import lineage, memory, outcome


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string").orderBy("k").select(column).collect()]


def test_regions():
    assert [langcodes.regional_code(x) for x in ("PT", "zh-CN", "xx-YY")] == ["pt-BR", "zh-CN", "xx-YY"]


def test_languages_and_names_of_files(spark):
    assert values(spark, langcodes.english_name("t"), ["pt_BR", "english", "xx"])[1:] == ["English", "Xx"]
    assert values(spark, langcodes.from_filename("t")["pattern"], ["a/en.json", "English.json", "menu_en.csv", "menu_pt-BR.csv", "en_menu.csv", "menu.csv"]) == ["code_exact", "name_exact", "suffix", "suffix_composite", "prefix", None]
    assert values(spark, langcodes.is_translatable_file("t", "en"), ["a/en.json", "a/es.json", "menu.csv"]) == [True, False, True]
    assert values(spark, langcodes.is_translatable_file("t", "auto"), ["a/es.json"]) == [True]
    named = values(spark, langcodes.target_filename("t", "es"), ["a/EN.json", "a/english.json", "menu_en.csv", "en_menu.csv", "x/menu.csv"])
    assert named == ["a/ES.json", "a/spanish.json", "menu_es.csv", "es_menu.csv", "x/menu_es.csv"]
    assert [langcodes.provider_code("en"), langcodes.provider_code("pt"), langcodes.provider_code("de_at"), langcodes.provider_code("de_at", True), langcodes.provider_code("auto", True)] == ["EN-US", "PT-BR", "DE-AT", "DE", ""]


def test_text_columns(spark):
    assert values(spark, text.ruby_unwrapped("t"), [r"a \r[base,reading] b", r"\r[x]"]) == ["a base b", r"\r[x]"]
    assert values(spark, text.pointer_escaped("t"), ["a/b~c"]) == ["a~1b~0c"]
    assert values(spark, text.pointer_unescaped(text.pointer_escaped("t")), ["~1/", "~0"]) == ["~1/", "~0"]
    assert values(spark, text.sniffed_line_end("t"), ["a\r\nb", "a\rb", "a\nb\r", "a"]) == ["\r\n", "\r", "\n", "\n"]
    assert values(spark, text.has_cjk("t"), ["日本", "abc", "ｱ"]) == [True, False, False]
    assert predicates.allowed_keys([" Name ", "", "text"]) == ("name", "text") and predicates.allowed_keys(["a", "*"]) is None and predicates.allowed_keys([]) is None


def test_spans_of_columns(spark):
    found = values(spark, F.transform(gametext.spans_of(gametext.message_spans)("t"), lambda s: F.concat_ws(":", s["start"], s["end"], s["source"])), ["<Ana>Hi there", "name: Bob", "$gameParty.x", "<b>bold</b>", None])
    assert found == [["1:4:Ana", "5:13:Hi there"], ["6:9:Bob"], [], ["0:11:<b>bold</b>"], []]
    assert values(spark, gametext.guarded_text()("t")["body"], ["if(a == 1) Yes", "if (a) Yes", "show_if(f(')')) Go", "if(x = 1){"]) == ["Yes", "if (a) Yes", "Go", "if(x = 1){"]


def test_records_of_a_folder(spark, tmp_path):
    entry = {"original_sha256": "a", "translated_sha256": "b", "status": "success"}
    (tmp_path / "meta.json").write_text(json.dumps({"schema_version": lineage.SCHEMA_VERSION, "files": {"x/y.txt": entry}}, indent=1))
    assert [tuple(r) for r in lineage.loaded(spark, str(tmp_path / "meta.json")).collect()] == [("x/y.txt", "a", "b", "success")]
    (tmp_path / "newer.json").write_text(json.dumps({"schema_version": lineage.SCHEMA_VERSION + 1, "files": {"x": entry}}))
    (tmp_path / "broken.json").write_text("{")
    assert lineage.loaded(spark, str(tmp_path / "newer.json")).count() == lineage.loaded(spark, str(tmp_path / "broken.json")).count() == 0


def test_files_with_other_extensions_are_not_listed(spark, tmp_path):
    from lexiloom.sources import formats

    for name in ("A.CSV", "b.csv", "c.png", "d.csv.bak", ".hidden/e.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("id,text\n1,Hello there\n")
    found = formats.files(spark, str(tmp_path), formats.FORMATS["csv"])
    assert sorted(r.name for r in found.select("name").collect()) == ["A.CSV", "b.csv"]
    assert sorted(r.rel for r in lineage.scanned(spark, str(tmp_path), ["csv"]).collect()) == ["A.CSV", "b.csv"]
    assert lineage.scanned(spark, str(tmp_path)).count() == 4 and formats.files(spark, str(tmp_path), formats.FORMATS["lines"]).count() == 0


def test_wire_forms(spark):
    texts = ["a", "b\n" * 300, "x" * 900 + "\n" + "y" * 449 + "\nz", "\n" + "q" * 460, "é" * 451, "", "k" * 450, "m" * 449 + "\n\n"]

    def cut(text, size=450):
        out = []
        while len(text) > size:
            at = text.rfind("\n", 1, size)
            out.append(text[: at if at > 0 else size])
            text = text[at + 1 if at > 0 else size :]
        return out + [text] * bool(text)

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", wire.pieces("t").alias("p"))
    assert {r.k: r.p for r in df.collect()} == {k: cut(t) for k, t in enumerate(texts)}
    replies = [(' "He said" ', "He said"), ("“é”", "é"), ('"', '"'), ('"a" b', '"a" b'), ("“a\"", "“a\""), ("", "")]
    got = spark.createDataFrame(replies, "r string, want string").select(wire.unquoted("r").alias("u"), "want").collect()
    assert [r.u for r in got] == [r.want for r in got]
    rows = [("a" + wire.DELIMITER + "b", 2, ["a", "b"]), ("a <span> </span>b", 2, ["a", "b"]), ("a b", 2, None), ("a", 1, ["a"])]
    assert [r.p for r in spark.createDataFrame(rows, "r string, n int, w array<string>").select(wire.parted("r", "n").alias("p")).collect()] == [r[2] for r in rows]


def test_phrase_search(spark):
    sources = ['He said "go" (now): AND NOT', "Olá, Mundo!", "ola mundo novo", "mundo ola", "...", "golden ola", None]
    tm = spark.createDataFrame([(k, "en" if k != 2 else "fr", "pt", s) for k, s in enumerate(sources)], "id long, src_lang string, tgt_lang string, source string")
    found = lambda phrase, *rest: [r.id for r in memory.search(tm, "en", "pt", phrase, *rest).orderBy("id").collect()]
    assert found('"GO" (now): and') == [0] and found("OLA mundo") == [1] and found("olá") == [1, 3, 5] and found("ola", 2) == [1, 3]
    assert found("go") == [0] and found("") == found(" ?") == [] and found("ola", None) == [1, 3, 5] and found("ola", 0) == [1, 3, 5]


def test_review_of_segments(spark):
    rows = [("en", "a", "b", False), ("en", "a", "a", False), ("en", "a", " a ", False), ("en", "a", "a", True), ("en", "a", "", True), ("en", "a", None, False), ("PT", "a", "a", False)]
    df = spark.createDataFrame(rows, "src_lang string, source string, target string, cached boolean")
    assert [r.status for r in outcome.reviewed(df, "pt").collect()] == ["ok", "partial", "partial", "ok", "partial", "partial", "ok"]
    assert outcome.reviewed(df, "pt", "partial").count() == 4
