import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from lexiloom.functions.codes import restored
from lexiloom.functions.masking import DEFAULT_PATTERNS, IntegrityError, Masker, unmasked
from lexiloom.operators import memory
from lexiloom.plans import translate
from lexiloom.sources import interchange
from lexiloom.sources.formats import FORMATS, extracted, files, injected

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't see this file

TM = "id long, src_lang string, tgt_lang string, source string, target string, source_hash string, engine string, model string, game string, context string, status string, created_at string, updated_at string"
ENTRY = "ord long, src_lang string, tgt_lang string, source_text string, target_text string, engine string, status string, game string, allow_identity boolean"


@given(st.text(alphabet="ab\\C[2]{}<>/ _XTOK0.!", max_size=40))
@settings(max_examples=300, deadline=None)
def test_mask_round_trip(text):
    masked, found = Masker(DEFAULT_PATTERNS).mask(text)
    if "__XTOK_" not in text:
        assert unmasked(masked, found) == text


def test_integrity():
    masked, found = Masker().mask("\\C[1]a<b>")
    for bad in (masked.replace("__XTOK_0__", ""), masked + "__XTOK_0__", masked + "__XTOK_7__"):
        with pytest.raises(IntegrityError):
            unmasked(bad, found)


def test_codes():
    assert restored(r"\F[a] \C[1]", r"\f[a] \c[1] \f") == r"\F[a] \c[1] \f"
    assert restored(r"\Fa[x]\fA[y]", r"\fa[z]") == r"\fa[z]"


def test_upsert_fold_is_a_sequential_replay(spark):
    rng = random.Random(1)
    rank = {"locked": 0, "reviewed": 1, "machine": 2}
    entries = [(k, "en", "pt", f"s{rng.randrange(12)}", f"t{k}", "google", rng.choice(list(rank)), rng.choice(["", "g1", "g2"]), False) for k in range(300)]
    state = {}
    for _, _, _, s, t, _, status, game, _ in entries:
        old = state.get(s)
        if old is None or rank[status] <= rank[old[1]]:
            state[s] = (t, status, game or (old[2] if old else None) or None)
    out = memory.merged(spark.createDataFrame([], TM), spark.createDataFrame(entries, ENTRY), "now").collect()
    assert {r.source: (r.target, r.status, r.game) for r in out} == state
    assert len({r.id for r in out}) == len(out)


class Losing(translate.Wrapping):
    def translate(self, texts, src_lang, tgt_lang):
        return [t.replace("__XTOK_0__", "") if "lose" in t else f"PT[{t}]" for t in texts]


def test_run_and_second_run(spark, tmp_path):
    folder = tmp_path / "game" / "data"
    folder.mkdir(parents=True)
    (folder / "System.json").write_text('{"gameTitle": "Quest", "terms": {"messages": {"m": "A sign says \\\\C[1]go"}}}')
    (folder / "Map001.json").write_text('{"events": [null, {"pages": [{"list": [{"code": 401, "parameters": ["A sign says \\\\C[1]go"]}, {"code": 401, "parameters": ["lose \\\\C[2]it"]}]}]}]}')
    game = FORMATS["game"]
    found = files(spark, str(tmp_path / "game"), game)
    segments = extracted(found, game).selectExpr("path", "path file", "id", "ord", "'en' src_lang", "kind", "source")
    empty = spark.createDataFrame([], TM)
    result = translate.translated(segments, empty, "pt", "google", Losing(), patterns=DEFAULT_PATTERNS, game="q")
    assert tuple(result.stats().first()) == (4, 0, 3, 1)
    states = {r.file.rsplit("/", 1)[1]: r.outcome for r in translate.outcomes(result, "pt").collect()}
    assert states == {"System.json": "success", "Map001.json": "partial"}
    new = {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in injected(found, result.occurrences, game).collect()}
    assert '"m": "PT[A sign says \\\\C[1]go]"' in new["System.json"] and "lose \\\\C[2]it" in new["Map001.json"]
    tm = memory.merged(empty, result.entries, "2026-01-01").cache()
    again = translate.translated(segments, tm, "pt", "google", None)
    assert tuple(again.stats().first())[:2] == (4, 3)


class Failing(translate.Wrapping):
    calls = 0

    def translate(self, texts, src_lang, tgt_lang):
        Failing.calls += 1
        if len(texts) > 1:
            return texts[:1]
        if "bad" in texts[0]:
            raise translate.Unavailable
        return [t.upper() for t in texts]


def test_retries_mismatch_and_circuit():
    caller = translate.Caller(Failing(), translate.Retry(attempts=3), sleep=lambda s: None)
    assert caller.batch(["a", "b"], "en", "pt") == (["A", "B"], True)
    assert caller.batch(["bad"], "en", "pt") == (["bad"], False)
    calls = Failing.calls
    assert caller.batch(["a"], "en", "pt") == (["a"], False) and Failing.calls == calls


def test_interchange(spark, tmp_path):
    pairs = spark.createDataFrame([("a < b & c", "x \"q\"", 2), ("first\tone", "é", 1)], "source string, target string, min_id long")
    path = str(tmp_path / "m.tmx")
    interchange.write_tmx(pairs, path, "en", "pt")
    units, skipped = interchange.tmx_units(spark, path)
    assert sorted(map(tuple, units.collect())) == [("en", "pt", "a < b & c", 'x "q"'), ("en", "pt", "first\tone", "é")]
    old = tmp_path / "old.tmx"
    old.write_text('<tmx><body><tu><tuv lang="en"><seg>a</seg></tuv><tuv lang="pt"><seg>b</seg></tuv></tu><tu><tuv lang="en"><seg>a</seg></tuv></tu></body></tmx>')
    units, skipped = interchange.tmx_units(spark, str(old))
    assert units.count() == 1 and skipped.first()[0] == 1
    (tmp_path / "c" / "GoogleTraslator").mkdir(parents=True)
    (tmp_path / "c" / "GoogleTraslator" / "cache_en_pt.json").write_text('{"a": "b", "c": "c", "d": null, "": "x"}')
    (tmp_path / "c" / "GoogleTraslator" / "other.json").write_text("{}")
    entries, counts = interchange.legacy_caches(spark, str(tmp_path / "c"))
    assert tuple(counts.first()) == (1, 2, 1, 1)
    tm = memory.merged(spark.createDataFrame([], TM), entries, "now")
    assert {(r.source, r.target, r.engine) for r in tm.collect()} == {("a", "b", "google"), ("c", "c", "google")}
