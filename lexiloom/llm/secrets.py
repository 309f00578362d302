"""Operator 1: secret scans by fixed shapes and by two character Markov models.

Beside the base shapes, every long run of key characters is scored by the log-likelihood ratio of
two first-order character models, one of random strings and one of ordinary identifiers, both
counted from labelled samples with add-one smoothing. Runs whose ratio is high enough, and that no
base span touches, become spans of kind "random".

DataFrame functions only. The scan is map-only: pieces between matches and the matches themselves
give positions, so nothing is exploded or shuffled. The models are 68 x 68 numbers, whatever the
sample, and travel as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import running

# The base kinds, as spans order them, and their shapes; for assign, group 2 is the value.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: The characters of the models; any other character counts as the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."

#: Characters of the shortest run that is scored; least log-likelihood ratio, in nats a character, of a secret.
RUN, RATIO = 20, 0.35
#: Labelled samples of each kind that the models of ``samples`` are counted from, at most.
SAMPLE = 4000


def samples(spark: SparkSession, words: DataFrame, text: str = "text", size: int = SAMPLE) -> DataFrame:
    """Labelled samples (text, random): key-like strings from digests of numbers in four alphabets, and
    identifiers joined from the words of a table in four styles; at most ``size`` of each."""
    n = F.col("id").cast("string")
    digest, more = F.sha2(n, 256), F.sha2(F.concat(F.lit("more"), n), 256)
    keys = spark.range(size).select(
        F.element_at(
            F.array(
                F.substring(digest, 1, 40),
                F.base64(F.unhex(digest)),
                F.translate(F.upper(F.concat(digest, more)), "ABCDEF018", "QXKZJWRMY").substr(1, 32),
                F.translate(F.base64(F.unhex(more)), "+/=", "-_"),
            ),
            (F.col("id") % 4 + 1).cast("int"),
        ).alias("text"),
        F.lit(True).alias("random"),
    )
    token = F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("w")
    plain = words.select(token).distinct().orderBy(F.xxhash64("w"), "w").limit(size)
    h = F.abs(F.xxhash64("w"))
    other = F.reverse(F.lower("w"))
    names = plain.select(
        F.element_at(
            F.array(
                F.concat_ws("_", F.lower("w"), F.lower("w")),
                F.concat(F.lower("w"), F.initcap("w"), F.initcap(F.lower("w"))),
                F.concat_ws("-", F.lower("w"), F.lower("w"), (h % 100).cast("string")),
                F.concat(F.lower("w"), F.lit("/"), F.lower("w"), F.lit("."), F.substring(other, 1, 3)),
                F.concat_ws("_", F.upper("w"), F.upper("w")),
                F.concat(F.lower("w"), F.lower("w")),
            ),
            (h % 6 + 1).cast("int"),
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    return keys.unionByName(names)


def _codes(text: Column) -> Column:
    """The numbers of a text's characters in the alphabet."""
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(len(ALPHABET))) - 1)


def trained(labelled: DataFrame) -> list[int]:
    """The log-likelihood ratio, in thousandths, of each pair of neighbouring characters: random against ordinary.

    labelled: (text, random). Null and empty texts and null marks are left out; without samples every ratio is 0.
    """
    size = len(ALPHABET)
    codes = labelled.where(F.col("random").isNotNull() & (F.length("text") > 1)).select("random", _codes(F.col("text")).alias("c"))
    pairs = codes.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * size + b)).alias("pair"))
    counts = {True: [1] * size * size, False: [1] * size * size}
    for row in pairs.groupBy("random", "pair").count().collect():  # at most 2 x 68 x 68 rows
        counts[row["random"]][row["pair"]] += row["count"]
    totals = {r: [sum(n[s : s + size]) for s in range(0, size * size, size)] for r, n in counts.items()}
    return [round(1000 * (math.log(counts[True][k] / totals[True][k // size]) - math.log(counts[False][k] / totals[False][k // size]))) for k in range(size * size)]


def ratio(text: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of a text in nats a character, 0 for fewer than two characters."""
    table = F.from_json(F.lit(str(model)), "array<int>")  # folds into a literal
    codes = _codes(text)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x) / (1000.0 * F.greatest(F.length(text), F.lit(1)))


def _matches(text: Column, shape: str, kind: str, value_group: int = 0) -> Column:
    """All matches as structs (start, rank, end, value), in code points."""
    found = F.regexp_extract_all(text, F.lit(shape), F.lit(0))
    gaps = F.split(text, shape, -1)
    # a match and the gap before it; where each match ends follows from their running sum
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = F.zip_with(running(steps), steps, lambda a, n: a + n)
    values = F.regexp_extract_all(text, F.lit(shape), F.lit(value_group)) if value_group else found
    spans = F.zip_with(
        ends, F.arrays_zip(found.alias("m"), values.alias("v")),
        lambda e, x: F.struct((e - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end"), x["v"].alias("value")),
    )
    return F.when(text.rlike(shape), spans).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string>>"))


def _text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(df: DataFrame, model: list[int], key: str = "doc_id", text: str = "text", least_ratio: float = RATIO) -> DataFrame:
    """Rows (key, n_assign, n_access, n_hex, n_random, base_sha256, spans), one for each row of df.

    Matches are leftmost and don't overlap within a kind; those that are too short are dropped and
    not retried. base_sha256 is over kind:start:end of the base spans by start, then kind; spans has the
    random ones too. A null or empty text has none. Rows that repeat a key are scanned each.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    out = df.select(F.col(key), F.col(text).alias("_text"))
    # a run shorter than the least length fails in any case, so it needn't be matched
    shapes = {"assign": (ASSIGN, 2), "access": (f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}+", 0), "hex": (f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+", 0)}
    for kind, (shape, group) in shapes.items():
        out = out.withColumn(f"_{kind}", F.filter(_matches(t, shape, kind, group), lambda s: F.length(s["value"]) >= LEAST[kind]))
    run = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN},}}+={{0,2}}"
    out = out.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex"))).withColumn("_runs", _matches(t, run, "random"))
    random = F.filter("_runs", lambda r: ~F.exists("_base", lambda b: (r["start"] < b["end"]) & (r["end"] > b["start"])) & (ratio(r["value"], model) >= least_ratio))
    out = out.withColumn("_random", F.when(F.size("_runs") > 0, random).otherwise(F.col("_runs")))
    return out.select(
        key, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_text(F.col("_base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("_base", "_random"))).alias("spans"),
    )
