"""Lineage of translated files: content hashes, the record of a run, and the eight states of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, glob_of

SCHEMA_VERSION = 1
#: Folder of the record within a translated tree; scans skip it.
FOLDER, FILE = ".lineage", "meta.json"


def extensions_normalized(extensions) -> list[str]:
    """Lower-case, with a dot, sorted, each once."""
    return sorted({e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in extensions) if e})


def has_extension(rel, extensions) -> Column:
    """Whether a path ends in one of the extensions; all do if none are given."""
    names = extensions_normalized(extensions)
    low, out = F.lower(F.col(rel) if isinstance(rel, str) else rel), F.lit(not names)
    for e in names:
        out = out | low.endswith(e)
    return out


def scanned(spark: SparkSession, root: str, extensions=()) -> DataFrame:
    """Rows (rel, sha256) of the files of a tree; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(extensions_normalized(extensions))).load(root)
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.substr("path", F.instr("path", F.lit(top)) + len(top))
    rows = files.select(rel.alias("rel"), content_hash("content").alias("sha256"))
    return rows.where(~F.col("rel").startswith(f"{FOLDER}/") & has_extension("rel", extensions))


def built(original: DataFrame | None, translated: DataFrame, job_status: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Records (rel, original_sha256, translated_sha256, status) of files that both trees hold; of the translated tree alone
    without an original one. Status: the job's, else the former, else by the hashes."""
    rows = translated.select("rel", F.col("sha256").alias("translated_sha256"))
    if original is not None:
        rows = rows.join(original.select("rel", F.col("sha256").alias("original_sha256")), "rel")
        derived = F.when(F.col("translated_sha256") != F.col("original_sha256"), "success").otherwise("unchanged")
    else:
        rows, derived = rows.withColumn("original_sha256", F.lit(None).cast("string")), F.lit("success")
    known = []
    for name, status in (("job", job_status), ("former", previous)):
        if status is not None:
            rows = rows.join(status.select("rel", F.col("status").alias(name)), "rel", "left")
            known.append(F.nullif(name, F.lit("")))
    return rows.select("rel", "original_sha256", "translated_sha256", F.coalesce(*known, derived).alias("status"))


def verified(records: DataFrame, translated: DataFrame, original: DataFrame | None) -> DataFrame:
    """Rows (rel, state) of recorded files and of new ones. A change of the original comes before one of the translation."""
    now = records.join(translated.select("rel", F.col("sha256").alias("t_now")), "rel", "left")
    state = (
        F.when(F.coalesce("t_now", F.lit("")) == "", "translation_missing")
        .when(F.col("t_now") != F.col("translated_sha256"), "edited")
        .when(F.col("status") == "partial", "partial")
        .when(F.col("status") == "unchanged", "unchanged")
        .otherwise("intact")
    )
    known = F.col("original_sha256").isNull()
    if original is None:
        return now.select("rel", F.when(known, state).otherwise("original_missing").alias("state"))
    source = original.select("rel", F.col("sha256").alias("o_now"))
    both = now.join(source, "rel", "left").select(
        "rel",
        F.when(known, state).when(F.coalesce("o_now", F.lit("")) == "", "original_missing").when(F.col("o_now") != F.col("original_sha256"), "original_changed").otherwise(state).alias("state"),
    )
    new = source.join(records, "rel", "left_anti").select("rel", F.lit("new").alias("state"))
    return both.unionByName(new)


def summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """Records of a meta file; none if it is missing, broken or of a newer schema. Rows (rel, original_sha256, translated_sha256, status)."""
    entry = "struct<original_sha256:string,translated_sha256:string,status:string>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema_version int, files map<string,{entry}>").alias("m"))
    rows = text.where(F.col("m.schema_version") <= SCHEMA_VERSION).select(F.explode("m.files").alias("rel", "f"))
    return rows.select("rel", "f.*")
