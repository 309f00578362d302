"""Whole runs over folders: estimate, translate, verify, adopt; what a command line offers.

A run reads files, extracts segments, translates them in one plan and writes files beside the
originals. Memories are folders of Parquet tables, one for each state: a change writes the next one
and then names it in a pointer file, so that a reader never meets half a table.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates
from ..operators import estimate, lineage, memory
from ..operators.memory import Policy
from ..sources import binary, ruby  # noqa: F401  (they register their formats)
from ..sources.detection import FORMAT_NAMES, detected
from ..sources.formats import FORMATS, extracted, files, injected
from . import translate

TM_SCHEMA = "id long, src_lang string, tgt_lang string, source string, target string, source_hash string, engine string, model string, game string, context string, status string, created_at string, updated_at string"


class Memory:
    """A memory in a folder: CURRENT names the table that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def read(self) -> DataFrame:
        try:
            with open(os.path.join(self.folder, "CURRENT")) as file:
                name = file.read().strip()
        except FileNotFoundError:
            return self.spark.createDataFrame([], TM_SCHEMA)
        return memory.checked(self.spark.read.parquet(os.path.join(self.folder, name)))

    def write(self, table: DataFrame) -> None:
        name = f"state-{time.time_ns()}"
        table.select(memory.COLUMNS).write.parquet(os.path.join(self.folder, name))
        pointer = os.path.join(self.folder, "CURRENT")
        with open(pointer + ".new", "w") as file:
            file.write(name)
        os.replace(pointer + ".new", pointer)

    def kept(self, replies: DataFrame) -> DataFrame:
        """A run's translations, written beside the states: what a provider has answered isn't asked for again when an executor is lost."""
        place = os.path.join(self.folder, f"replies-{time.time_ns()}")
        replies.write.parquet(place)
        return self.spark.read.schema(replies.schema).parquet(place)


class Rejected(Exception):
    """A review turned the run down: the memory has its pairs, but no file was written."""


@dataclass(frozen=True)
class Config:
    """A run. engine: the name under which pairs are stored; format: auto or one of the formats; incremental: only the
    files that the target's record lacks, or names as changed, partial or missing; options: those of the format."""

    source: str
    target: str
    src_lang: str = "auto"
    tgt_lang: str = ""
    engine: str = "google"
    format: str = "auto"
    memory_only: bool = False
    switch_engine: bool = False
    incremental: bool = False
    options: tuple = ()

    def checked(self) -> Config:
        """The configuration, if it says where to and between which languages."""
        if not self.tgt_lang:
            raise ValueError("a target language is needed")
        if self.src_lang not in ("", "auto") and self.src_lang.lower() == self.tgt_lang.lower():
            raise ValueError("source and target language are the same")
        known = {"csv": {"columns", "delimiter"}, "json": {"keys"}, "binary": {"preserve_title", "font"}}.get(self.kind(), set())
        if unknown := {k for k, _ in self.options} - known:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        if len(dict(self.options).get("delimiter", ",")) != 1:
            raise ValueError("a delimiter is one character")
        return self

    def kind(self) -> str:
        if self.format != "auto":
            return FORMAT_NAMES[self.format.lower()]
        return detected(self.source).format


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S")


def _rel(path: str, root: str) -> Column:
    """The path below a root."""
    top = "/" + os.path.abspath(root).strip("/") + "/"
    return F.substr(path, F.instr(path, F.lit(top)) + len(top))


def record_of(folder: str) -> dict | None:
    """The record of a translated folder; none if it is missing, broken or of a newer schema."""
    try:
        with open(os.path.join(folder, lineage.FOLDER, lineage.FILE), encoding="utf-8") as file:
            meta = json.load(file)
    except (OSError, ValueError):
        return None
    return meta if isinstance(meta, dict) and meta.get("schema_version", lineage.SCHEMA_VERSION + 1) <= lineage.SCHEMA_VERSION else None


def outdated(spark: SparkSession, config: Config) -> DataFrame | None:
    """Files (rel) that a run over changes takes up; None, which means all, if it isn't one or the target has no record.

    Nothing is translated here: contents are hashed where they are read and compared with the record.
    """
    if not config.incremental or not os.path.isdir(config.source) or record_of(config.target) is None:
        return None
    return verified(spark, config.target, config.source).where(predicates.needs_translation("state")).select("rel")


def _segments(spark: SparkSession, config: Config, only: DataFrame | None = None):
    found = detected(config.source)
    kind = FORMATS[config.kind()]
    lang = found.language if config.src_lang in ("", "auto") else config.src_lang
    options = dict(config.options) | {"src": lang, "tgt": config.tgt_lang}
    plan = files(spark, config.source, kind)
    if kind.name == "binary":
        options["lookup_types"] = binary.looked_up(plan)
    if only is not None:
        plan = plan.withColumn("rel", _rel("path", config.source)).join(only, "rel", "left_semi").drop("rel")
    segments = extracted(plan, kind, options).withColumns({"file": F.col("path"), "src_lang": F.lit(lang)})
    return found, kind, options, plan, segments.where("error is null"), segments.where("error is not null").select("path", "error")


def estimated(spark: SparkSession, config: Config, tm: Memory) -> DataFrame:
    """One row: segments, those in memory, characters to send, milliseconds; nothing is written."""
    config = config.checked()
    if os.path.abspath(config.source) == os.path.abspath(config.target) and os.path.isdir(originals(config.source)):
        config = from_originals(config)
    *_, segments, _ = _segments(spark, config, outdated(spark, config))
    hits = memory.lookup(segments, tm.read(), config.tgt_lang, config.engine, Policy(switch_engine=config.switch_engine))
    limit = estimate.PROVIDERS.get(config.engine, estimate.Capabilities())
    rows = estimate.estimated(hits, [], limit)
    return rows.withColumn("est_ms", F.lit(0).cast("long")) if config.memory_only else rows


def originals(source: str) -> str:
    """The folder beside a translated one that keeps its originals."""
    return os.path.abspath(source) + ".originals"


def from_originals(config: Config) -> Config:
    """The run as it reads: where a folder is translated in place, from its originals, which are kept once, before the first run.

    A copy that was broken off is made anew: it only gets its name when it is whole.
    """
    if os.path.abspath(config.source) != os.path.abspath(config.target):
        return config
    kept = originals(config.source)
    if not os.path.isdir(kept):
        shutil.rmtree(kept + ".new", ignore_errors=True)
        shutil.copytree(config.source, kept + ".new", ignore=shutil.ignore_patterns(lineage.FOLDER))
        os.replace(kept + ".new", kept)
    return replace(config, source=kept)


def run(spark: SparkSession, config: Config, tm: Memory, provider: translate.Provider | None, review: Callable[[str], bool] | None = None) -> DataFrame:
    """Translate a folder into another one, or in place from its kept originals; store new pairs and the record; rows (file, n_segments, n_missing, n_cached, outcome).

    review: looks at the folder of new files before any is put in its place; Rejected if it turns them
    down. RateLimited, with the rows as its argument, if the provider has set a limit: what had come by
    then is written, and the files that lack something are recorded as partial.
    """
    config = from_originals(config.checked())
    if provider is None and not config.memory_only:
        raise ValueError("a provider is needed")
    only = outdated(spark, config)
    if only is not None:  # written, as the record that it comes from is replaced below
        place = os.path.join(config.target, lineage.FOLDER, "outdated")
        only.write.mode("overwrite").parquet(place)
        only = spark.read.schema(only.schema).parquet(place)
    found, kind, options, plan, segments, _ = _segments(spark, config, only)
    result = translate.translated(
        segments, tm.read(), config.tgt_lang, config.engine, None if config.memory_only else provider, kind.patterns, Policy(switch_engine=config.switch_engine), found.name,
        kept=tm.kept,
    )
    states = translate.outcomes(result, config.tgt_lang).persist()
    states.count()
    tm.write(memory.merged(tm.read(), result.entries, now()))
    root = os.path.abspath(config.source)
    work = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(config.target)))
    try:
        for row in injected(plan, result.occurrences, kind, options).toLocalIterator():  # a partition at a time
            rel = os.path.relpath(row.path.split(":", 1)[-1].replace("//", "/", 1) if row.path.startswith("file:") else row.path, root)
            place = os.path.join(work, rel)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place, "wb") as out:
                out.write(bytes(row.content))
        if review is not None and not review(work):
            raise Rejected(config.target)
        committed(work, config.target)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    recorded(spark, config.target, config.source, kind.extensions, states)
    if result.health().first().rate_limited:
        raise translate.RateLimited(states)
    return states


def finished(states: DataFrame) -> DataFrame:
    """One row: the files of a run by outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return states.agg(F.count("*").alias("files"), *map(count, ("success", "cached", "partial")))


def committed(work: str, target: str) -> None:
    """Move every file of a work folder to its place, each in one step."""
    for folder, _, names in os.walk(work):
        for name in names:
            place = os.path.join(target, os.path.relpath(os.path.join(folder, name), work))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(os.path.join(folder, name), place)


def recorded(spark: SparkSession, translated: str, original: str, extensions, states: DataFrame | None = None) -> dict[str, int]:
    """Write the record of a translated folder; the number of files in it by status. states: outcomes of a run, (file, outcome);
    files that the run didn't take up keep their status."""
    was, is_ = lineage.scanned(spark, os.path.abspath(original), extensions), lineage.scanned(spark, os.path.abspath(translated), extensions)
    job = previous = None
    if states is not None:
        job = states.select(_rel("file", original).alias("rel"), F.when(F.col("outcome") == "partial", "partial").otherwise("success").alias("status"))
        if record_of(translated) is not None:
            previous = lineage.loaded(spark, os.path.join(translated, lineage.FOLDER, lineage.FILE))
    rows = lineage.built(was, is_, job, previous).toLocalIterator()
    record = {r.rel: {"original_sha256": r.original_sha256, "translated_sha256": r.translated_sha256, "status": r.status} for r in rows}
    folder = os.path.join(translated, lineage.FOLDER)
    os.makedirs(folder, exist_ok=True)
    place = os.path.join(folder, lineage.FILE)
    meta = {"schema_version": lineage.SCHEMA_VERSION, "updated_at": now(), "original_dir": os.path.relpath(original, translated), "extensions": list(extensions), "files": record}
    with open(place + ".new", "w", encoding="utf-8") as out:
        json.dump(meta, out, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(place + ".new", place)
    counts: dict[str, int] = {}
    for entry in record.values():
        counts[entry["status"]] = counts.get(entry["status"], 0) + 1
    return counts


def verified(spark: SparkSession, translated: str, original: str | None = None) -> DataFrame:
    """Rows (rel, state) of a translated folder with a record."""
    meta = record_of(translated)
    if meta is None:
        raise FileNotFoundError(f"{translated} has no record that can be read")
    original = original or os.path.join(translated, meta["original_dir"])
    was = lineage.scanned(spark, os.path.abspath(original), meta["extensions"]) if os.path.isdir(original) else None
    records = lineage.loaded(spark, os.path.join(translated, lineage.FOLDER, lineage.FILE))
    return lineage.verified(records, lineage.scanned(spark, os.path.abspath(translated), meta["extensions"]), was)
