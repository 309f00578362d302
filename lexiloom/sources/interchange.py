"""Memories in other forms: TMX files, and the JSON caches of an older program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escaped

_TU = "tuv array<struct<_lang:string,`_xml:lang`:string,seg:string>>"


def tmx_units(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Units (src_lang, tgt_lang, source, target) of TMX files, and one row with the number of incomplete ones skipped.

    Of the variants with a language and a text the first is the source and the second the target.
    """
    rows = spark.read.format("xml").option("rowTag", "tu").option("ignoreNamespace", False).schema(_TU).load(path)
    variants = F.transform("tuv", lambda v: F.struct(F.coalesce(F.nullif(v.getField("_xml:lang"), F.lit("")), v.getField("_lang")).alias("lang"), v.getField("seg").alias("seg")))
    good = F.filter(variants, lambda v: (F.coalesce(v["lang"], F.lit("")) != "") & (F.coalesce(v["seg"], F.lit("")) != ""))
    found = rows.select(good.alias("v"))
    whole = found.where(F.size("v") >= 2).select(F.col("v")[0]["lang"].alias("src_lang"), F.col("v")[1]["lang"].alias("tgt_lang"), F.col("v")[0]["seg"].alias("source"), F.col("v")[1]["seg"].alias("target"))
    return whole, found.agg(F.count_if(F.coalesce(F.size("v"), F.lit(0)) < 2).alias("skipped"))


def tmx_lines(pairs: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """One line of TMX for each pair (source, target, min_id), in the order of min_id."""
    tuv = lambda lang, text: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), xml_escaped(text), F.lit("</seg></tuv>"))
    return pairs.orderBy("min_id").select(F.concat(F.lit("<tu>"), tuv(src_lang, "source"), tuv(tgt_lang, "target"), F.lit("</tu>")).alias("value"))


def write_tmx(pairs: DataFrame, path: str, src_lang: str, tgt_lang: str, tool: str = "lexiloom") -> None:
    """One TMX file on the driver; pairs are streamed to it, a partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n')
        out.write(f'<tmx version="1.4"><header creationtool="{tool}" creationtoolversion="1.0" datatype="plaintext" segtype="sentence" adminlang="en" srclang="{src_lang}" o-tmf="{tool}" /><body>')
        for row in tmx_lines(pairs, src_lang, tgt_lang).toLocalIterator():
            out.write(row.value)
        out.write("</body></tmx>")


def tmx_entries(units: DataFrame, engine: str = "human", status: str = "reviewed") -> DataFrame:
    """Units as entries for a memory."""
    return units.select(
        F.monotonically_increasing_id().alias("ord"), "src_lang", "tgt_lang", F.col("source").alias("source_text"), F.col("target").alias("target_text"), F.lit(engine).alias("engine"), F.lit(status).alias("status"),
        F.lit(None).cast("string").alias("game"), F.lit(False).alias("allow_identity"),
    )


def legacy_caches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries of <folder>/<engine>/cache_<src>_<tgt>.json, objects of source to target, and one row of counts
    (files, imported, null_skipped, identity). Targets that aren't strings are skipped, identities kept."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/cache_*.json")
    name = F.regexp_extract("path", r"/([^/]+)/cache_([a-z]{2,})_([a-z]{2,})\.json\z", 0)
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/cache_([a-z]{2,})_([a-z]{2,})\.json\z", k)
    rows = files.where(name != "").select("path", part(1).alias("engine"), part(2).alias("src_lang"), part(3).alias("tgt_lang"), F.from_json(F.decode("content", "UTF-8"), "map<string,variant>").alias("m"))
    kind = F.schema_of_variant("v")
    pairs = rows.select("path", "engine", "src_lang", "tgt_lang", F.posexplode("m").alias("n", "source_text", "v")).where("source_text <> ''").withColumn("target_text", F.when(kind == "STRING", F.variant_get("v", "$", "string")))
    entries = pairs.where("target_text is not null").select(
        F.monotonically_increasing_id().alias("ord"), "src_lang", "tgt_lang", "source_text", "target_text", "engine", F.lit("machine").alias("status"), F.lit(None).cast("string").alias("game"), F.lit(True).alias("allow_identity")
    )
    counts = pairs.agg(F.count_distinct("path").alias("files"), F.count("target_text").alias("imported"), F.count_if(F.col("target_text").isNull()).alias("null_skipped"), F.count_if(F.col("source_text") == F.col("target_text")).alias("identity"))
    return entries, counts
