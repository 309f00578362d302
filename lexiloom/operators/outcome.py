"""From unique translations back to occurrences, and from occurrences to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed


def unique_sources(segments: DataFrame) -> DataFrame:
    """Rows (kind, source, first_ord, occurrences): each text once, whatever number of files holds it."""
    return segments.groupBy("kind", "source").agg(F.min("ord").alias("first_ord"), F.count("*").alias("occurrences"))


def resolved(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """segments with target and cached from translations (kind, source, target, cached); the source where there is none."""
    found = segments.drop("target", "cached").join(translations.select("kind", "source", "target", "cached"), ["kind", "source"], "left")
    return found.withColumns({"target": F.coalesce(F.nullif("target", F.lit("")), F.col("source")), "cached": F.coalesce("cached", F.lit(False))})


def untranslated(src_lang: Column, tgt_lang: Column) -> Column:
    """A fresh target that equals its source, between different languages."""
    return (F.lower(src_lang) != F.lower(tgt_lang)) & (trimmed("target") == trimmed("source"))


def file_outcomes(rows: DataFrame, tgt_lang: str, file: str = "file") -> DataFrame:
    """Rows (file, n_segments, n_missing, n_cached, outcome): partial with a miss, cached if all came from memory, else success."""
    missing = ~F.col("cached") & untranslated(F.col("src_lang"), F.lit(tgt_lang))
    sums = rows.groupBy(file).agg(F.count("*").alias("n_segments"), F.count_if(missing).alias("n_missing"), F.count_if("cached").alias("n_cached"))
    outcome = F.when(F.col("n_missing") > 0, "partial").when(F.col("n_cached") == F.col("n_segments"), "cached").otherwise("success")
    return sums.withColumn("outcome", outcome)


def reviewed(rows: DataFrame, tgt_lang: str, status: str = "all") -> DataFrame:
    """rows (src_lang, source, target, cached) with status: partial without a target or with a fresh one that equals its source, else ok.
    status: partial for these alone."""
    target, missing = F.coalesce("target", F.lit("")), F.coalesce(~F.col("cached") & untranslated(F.col("src_lang"), F.lit(tgt_lang)), F.lit(False))
    out = rows.withColumn("status", F.when((target == "") | missing, "partial").otherwise("ok"))
    return out.where("status = 'partial'") if status == "partial" else out


def cacheable(rows: DataFrame) -> DataFrame:
    """Fresh targets that a memory may keep: there, other than the source, and without a leaked placeholder."""
    return rows.where((F.col("target") != "") & (F.col("target") != F.col("source")) & ~F.col("target").contains("__XTOK_"))


def overlaid(layers: DataFrame, key: str = "rel", priority: str = "priority") -> DataFrame:
    """The row of the highest priority of each path: archive below loose file below translation."""
    rest = [c for c in layers.columns if c != key]
    return layers.groupBy(key).agg(F.max_by(F.struct(*rest), priority).alias("_top")).select(key, "_top.*")


def loose_first(packed: DataFrame, loose: DataFrame, key: str = "rel") -> DataFrame:
    """Packed entries that no loose file stands for."""
    return packed.join(loose.select(key), key, "left_anti")
