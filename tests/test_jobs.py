import json
import sys
import time

import pytest
from pyspark import cloudpickle

from lexiloom import commands
from lexiloom.operators import filenames
from lexiloom.plans import job
from lexiloom.plans.translate import RateLimited, Wrapping
from lexiloom.sources.detection import detected, game_name, is_restricted
from lexiloom.streaming import events

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't see this file


def tree(root):
    folder = root / "Hero" / "www" / "data"
    folder.mkdir(parents=True)
    (folder / "System.json").write_text('{"gameTitle": "Quest", "currencyUnit": "Gold", "terms": {"messages": {"a": "Press any key"}}}')
    (folder / "Map001.json").write_text('{"events": [null, {"pages": [{"list": [{"code": 401, "parameters": ["Press any key"]}, {"code": 401, "parameters": ["Welcome home"]}]}]}]}')
    (folder / "Map002.json").write_text('{"events": []}')
    return root / "Hero"


def test_run_verify_estimate(spark, tmp_path):
    game = tree(tmp_path)
    tm = job.Memory(spark, str(tmp_path / "tm"))
    config = job.Config(str(game), str(tmp_path / "out"), "en", "pt")
    assert tuple(job.estimated(spark, config, tm).first())[:2] == (5, 0)
    states = {r.file.rsplit("/", 1)[1]: (r.n_segments, r.outcome) for r in job.run(spark, config, tm, Wrapping()).collect()}
    assert states == {"System.json": (3, "success"), "Map001.json": (2, "success")}
    assert tm.read().count() == 4
    out = tmp_path / "out" / "www" / "data"
    assert json.loads((out / "System.json").read_text())["gameTitle"] == "PT[Quest]" and (out / "Map002.json").read_text() == '{"events": []}'
    assert tuple(job.estimated(spark, config, tm).first()) == (5, 5, 0, 0)
    assert {r.rel: r.state for r in job.verified(spark, str(tmp_path / "out")).collect()} == {"www/data/System.json": "intact", "www/data/Map001.json": "intact", "www/data/Map002.json": "unchanged"}
    (out / "System.json").write_text("{}")
    (game / "www" / "data" / "Map001.json").write_text('{"events": [1]}')
    (game / "www" / "data" / "Map003.json").write_text("{}")
    (out / "Map002.json").unlink()
    assert {r.rel[9:]: r.state for r in job.verified(spark, str(tmp_path / "out")).collect()} == {"System.json": "edited", "Map001.json": "original_changed", "Map002.json": "translation_missing", "Map003.json": "new"}


def test_configurations(tmp_path):
    game = tree(tmp_path)
    with pytest.raises(ValueError):
        job.Config(str(game), "o", "en", "").checked()
    with pytest.raises(ValueError):
        job.Config(str(game), "o", "pt", "PT").checked()
    with pytest.raises(ValueError):
        job.Config(str(game), "o", "en", "pt", format="csv", options=(("delimiter", "ab"),)).checked()
    with pytest.raises(ValueError):
        job.Config(str(game), "o", "en", "pt", options=(("other", "1"),)).checked()


def test_detection(tmp_path):
    game = tree(tmp_path)
    assert (detected(str(game)).format, detected(str(game)).files, detected(str(game)).language) == ("game", 3, "en")
    assert game_name(str(game / "www" / "data")) == "Hero" and is_restricted("/") and is_restricted("/home/x/.Trash/y") and not is_restricted(str(game))
    table = tmp_path / "x.csv"
    table.write_text("a,b")
    assert detected(str(table)).format == "csv" and detected(str(tmp_path)).format == "csv"
    with pytest.raises(FileNotFoundError):
        detected(str(tmp_path / "none"))


def test_names(spark):
    rows = [("a1", "d", "x", ".txt", "Name"), ("a2", "d", "y", ".txt", "name"), ("a3", "d", "z", ".txt", "Name_1"), ("a4", "d", "z", ".t?t", "a/b"), ("a5", "e", "q", ".txt", "con"), ("a6", "e", "q", "", " . ")]
    df = spark.createDataFrame(rows, "rel string, folder string, stem string, ext string, translated string")
    named = filenames.allocated(df)
    assert {r.rel: r.target for r in named.collect()} == {"a1": "Name.txt", "a2": "name_1.txt", "a3": "Name_1_1.txt", "a4": "a_b.t_t", "a5": "_con.txt", "a6": "unnamed"}
    assert tuple(filenames.summary(named).first()) == (6, 2)


def test_progress_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = events.progress(stream, "1 hour", "1 day").writeStream.format("memory").queryName("progress").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    expected = events.progress(source, "1 hour")
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, expected.collect()))
    lines = events.written_as_lines(stream.select("event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "c2"))
    lines.processAllAvailable()
    lines.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == source.count()


def test_translation_in_place_reads_the_originals(spark, tmp_path):
    game = tree(tmp_path)
    before = (game / "www" / "data" / "System.json").read_text()
    tm = job.Memory(spark, str(tmp_path / "tm"))
    config = job.Config(str(game), str(game), "en", "pt")
    assert tuple(job.estimated(spark, config, tm).first())[:2] == (5, 0) and not (tmp_path / "Hero.originals").exists()
    for _ in range(2):  # the second run doesn't translate translations
        job.run(spark, config, tm, Wrapping()).collect()
        assert json.loads((game / "www" / "data" / "System.json").read_text())["gameTitle"] == "PT[Quest]"
        assert (tmp_path / "Hero.originals" / "www" / "data" / "System.json").read_text() == before
    assert tm.read().count() == 4 and tuple(job.estimated(spark, config, tm).first())[:2] == (5, 5)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("tmp")]


def test_a_failing_run_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    game = tree(tmp_path)
    monkeypatch.setattr(job, "committed", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        job.run(spark, job.Config(str(game), str(tmp_path / "out"), "en", "pt"), job.Memory(spark, str(tmp_path / "tm")), Wrapping())
    assert sorted(p.name for p in tmp_path.iterdir()) == ["Hero", "tm"]


class Counting(Wrapping):
    """Writes down what it is asked, in a file, as tasks have copies of it."""

    def __init__(self, log):
        super().__init__()
        self.log = str(log)

    def translate(self, texts, src_lang, tgt_lang):
        with open(self.log, "a") as out:
            out.write("".join(t + "\n" for t in texts))
        return super().translate(texts, src_lang, tgt_lang)


class Limited(Wrapping):
    def translate(self, texts, src_lang, tgt_lang):
        raise RateLimited


def test_incremental_runs_translate_changed_files_alone(spark, tmp_path):
    game, out = tree(tmp_path), tmp_path / "out"
    tm = job.Memory(spark, str(tmp_path / "tm"))
    config = job.Config(str(game), str(out), "en", "pt", incremental=True)
    job.run(spark, config, tm, Counting(tmp_path / "log"))
    assert sorted((tmp_path / "log").read_text().split("\n")) == ["", "Gold", "Press any key", "Quest", "Welcome home"]
    (tmp_path / "log").unlink()
    assert job.run(spark, config, tm, Counting(tmp_path / "log")).count() == 0 and tuple(job.estimated(spark, config, tm).first())[:2] == (0, 0)
    place = game / "www" / "data" / "Map001.json"
    place.write_text(place.read_text().replace("Welcome home", "Farewell"))
    before = (out / "www" / "data" / "System.json").stat().st_mtime_ns
    states = job.run(spark, config, tm, Counting(tmp_path / "log")).collect()
    assert [(r.file.rsplit("/", 1)[1], r.n_segments, r.n_cached, r.outcome) for r in states] == [("Map001.json", 2, 1, "success")]
    assert (tmp_path / "log").read_text() == "Farewell\n" and "PT[Farewell]" in (out / "www" / "data" / "Map001.json").read_text()
    assert (out / "www" / "data" / "System.json").stat().st_mtime_ns == before
    assert {r.rel: r.state for r in job.verified(spark, str(out)).collect()} == {"www/data/System.json": "intact", "www/data/Map001.json": "intact", "www/data/Map002.json": "unchanged"}
    assert job.run(spark, job.Config(str(game), str(out), "en", "pt"), tm, Wrapping()).count() == 2
    (out / ".lineage" / "meta.json").write_text("broken")  # no record: all files
    assert job.run(spark, config, tm, Wrapping()).count() == 2


def test_a_limit_leaves_partial_files_and_is_reported(spark, tmp_path):
    game, out = tree(tmp_path), tmp_path / "out"
    tm = job.Memory(spark, str(tmp_path / "tm"))
    config = job.Config(str(game), str(out), "en", "pt", incremental=True)
    with pytest.raises(RateLimited) as limit:
        job.run(spark, config, tm, Limited())
    assert tuple(job.finished(limit.value.args[0]).first()) == (2, 0, 0, 2)
    assert (out / "www" / "data" / "Map001.json").read_text() == (game / "www" / "data" / "Map001.json").read_text()
    assert {r.rel: r.state for r in job.verified(spark, str(out)).collect()} == {"www/data/System.json": "partial", "www/data/Map001.json": "partial", "www/data/Map002.json": "unchanged"}
    assert tuple(job.finished(job.run(spark, config, tm, Wrapping())).first()) == (2, 2, 0, 0)  # partial files are taken up again
    with pytest.raises(ValueError):
        job.run(spark, config, tm, None)


def test_a_review_that_rejects_writes_no_file(spark, tmp_path):
    game, seen = tree(tmp_path), []
    before = (game / "www" / "data" / "System.json").read_text()
    tm = job.Memory(spark, str(tmp_path / "tm"))
    config = job.Config(str(game), str(game), "en", "pt")

    def review(folder):
        with open(f"{folder}/www/data/System.json") as file:
            seen.append(json.loads(file.read())["gameTitle"])
        return len(seen) > 1

    with pytest.raises(job.Rejected):
        job.run(spark, config, tm, Wrapping(), review)
    assert (game / "www" / "data" / "System.json").read_text() == before and tm.read().count() == 4
    job.run(spark, config, tm, Wrapping(), review)
    assert seen == ["PT[Quest]"] * 2 and "PT[Quest]" in (game / "www" / "data" / "System.json").read_text()


def test_commands(spark, tmp_path, capsys):
    game, out = tree(tmp_path), tmp_path / "out"
    memory = ["--memory", str(tmp_path / "tm")]
    assert commands.main([*memory, "translate", "-i", str(game), "-o", str(out), "-s", "en", "-d", "pt"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"files": 2, "success": 2, "cached": 0, "partial": 0}
    assert commands.main([*memory, "adopt", str(out), "--original", str(game), "-e", "game"]) == 0
    assert json.loads(capsys.readouterr().out) == {"success": 2, "unchanged": 1}


def test_names_that_meet_across_roots(spark):
    """The pass over whole folders, name by name, and the dealt one: the same targets. Cases, taken numbers, extensions that begin with a digit, null folders and order."""
    parts = ["Name", "NAME", "name_1", "Name_1_2", "a_", "a__1", "ΑΣ", "ας", "Kelvin", "kelvin", "KELVIN_3", "İx", "i̇x", "q"]
    rows = [(f"{n:05}" if n % 97 else None, None if n % 5 == 4 else f"d{n % 5}", n, ("5x", "") [n // 5 % 2] if n % 5 == 3 else (".txt", "", ".TXT")[n // 5 % 3], parts[n * 7 // 3 % len(parts)] + ("_15x" if n % 11 == 0 else "")) for n in range(97, 700) if n % 97]
    named = filenames.allocated(spark.createDataFrame(rows, "rel string, folder string, n int, ext string, translated string")).collect()
    expected, used = {}, {}
    for rel, folder, n, ext, stem in sorted(rows):
        taken, candidate, k = used.setdefault(folder, set()), stem + ext, 0
        while candidate.lower() in taken:
            k += 1
            candidate = f"{stem}_{k}{ext}"
        taken.add(candidate.lower())
        expected[rel] = (folder, n, ext, stem, candidate, k > 0)
    assert {r.rel: (r.folder, r.n, r.ext, r.translated, r.target, r.collided) for r in named} == expected and len(named) == len(expected)


def test_names_taken_many_times(spark):
    files = spark.range(60_000).selectExpr("lpad(id, 9, '0') as rel", "'d' as folder", "'.txt' as ext", "if(id % 2 = 0, 'Name', 'NAME') as translated")
    began = time.time()
    named = filenames.allocated(files).where("rel in ('000000000', '000000001', '000059999')").orderBy("rel").collect()
    assert [r.target for r in named] == ["Name.txt", "NAME_1.txt", "NAME_59999.txt"] and time.time() - began < 60
