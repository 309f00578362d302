"""Operators on a translation memory: lookup, merge, migration, export and repair, as lazy plans.

A memory is a table (id, src_lang, tgt_lang, source, target, source_hash, engine, model, game, context,
status, created_at, updated_at). updated_at is text and compared as text. Parquet can't be changed in
place: what changes a memory returns the new table, to be written beside the old one.

Scale: rows of a memory are unique by (src_lang, tgt_lang, source_hash, engine), so a lookup key has as
many candidates as there are engines; picks and merges are aggregates with map-side combining, not
windows, wherever only one row is wanted. Joins state no broadcast: adaptive execution knows sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, name_tags_fixed, normalized_engine, normalized_source, source_hash, trimmed, words

COLUMNS = ["id", "src_lang", "tgt_lang", "source", "target", "source_hash", "engine", "model", "game", "context", "status", "created_at", "updated_at"]
KEY = ["src_lang", "tgt_lang", "source_hash", "engine"]
REQUIRED = {"src_lang", "tgt_lang", "source", "target", "source_hash", "engine", "status"}

# Ranks of the statuses (any other ranks with machine), engines that tests have left in memories.
RANKS = {"locked": 0, "reviewed": 1, "machine": 2}
TEST_ENGINES = ("prefix_translate", "basetranslate", "dummyprescantranslator")
PLACEHOLDER = "__XTOK_"
FOUND = 20  # rows of a search


@dataclass(frozen=True)
class Policy:
    """Whose translations a lookup may use: strict, those of its engine; switching, protected ones and those of its engine; else all."""

    strict_engine: bool = False
    switch_engine: bool = False

    def accepts(self, engine: str) -> Column:
        protected = F.col("status").isin("locked", "reviewed")
        if self.switch_engine:
            return protected | (F.col("engine") == engine) if engine else protected
        if self.strict_engine and engine:
            return F.col("engine") == engine
        return F.lit(True)


def checked(memory: DataFrame) -> DataFrame:
    """The memory, if it has the columns that every memory needs."""
    if missing := REQUIRED - set(memory.columns):
        raise ValueError(f"not a translation memory: it lacks {', '.join(sorted(missing))}")
    return memory


def rank(status="status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "locked", 0).when(s == "reviewed", 1).otherwise(2)


def best_candidates(memory: DataFrame, engine: str = "", policy: Policy = Policy()) -> DataFrame:
    """Rows (src_lang, tgt_lang, source_hash, target): for each text the candidate of the highest status, then of the
    preferred engine, then the latest, then of the smallest id."""
    other = (F.col("engine") != engine) if engine else F.lit(False)
    # a minimum: descending text as its complement can't be written, so the latest is taken among the best first
    first = F.struct(rank().alias("r"), F.coalesce(other, F.lit(True)).alias("o"))
    accepted = memory.where(policy.accepts(engine))
    ordered = accepted.groupBy("src_lang", "tgt_lang", "source_hash").agg(
        F.max_by(F.struct("target"), F.struct((-first["r"]).alias("r"), (~first["o"]).alias("o"), F.coalesce("updated_at", F.lit("")).alias("u"), (-F.col("id")).alias("i"))).alias("best")
    )
    return ordered.select("src_lang", "tgt_lang", "source_hash", "best.target")


def lookup(segments: DataFrame, memory: DataFrame, tgt_lang: str, engine: str = "", policy: Policy = Policy()) -> DataFrame:
    """segments (src_lang, source, ...) with hit_target: the exact match, else one that differs in white space alone; null if there is none.

    Blank sources are never looked up. The second kind takes the smallest id whatever its status, and
    texts without a letter or digit have none, as a word index doesn't hold them. Each distinct text is looked up once.
    """
    engine = (engine or "").lower()
    asked = segments.select("src_lang", "source").where(~is_blank("source")).distinct().withColumn("source_hash", source_hash("source"))
    pairs = memory.where(F.col("tgt_lang") == tgt_lang)
    best = best_candidates(pairs, engine, policy).select("src_lang", "source_hash", F.col("target").alias("exact"))
    exact = asked.join(best, ["src_lang", "source_hash"], "left")
    norm = normalized_source("source")
    indexed = F.rlike(norm, F.lit(r"[\pL\pN]"))
    loose = pairs.where(policy.accepts(engine) & indexed).groupBy("src_lang", norm.alias("norm")).agg(F.min_by("target", "id").alias("near"))
    missed = exact.where(F.col("exact").isNull() & indexed).select("src_lang", "source", norm.alias("norm")).join(loose, ["src_lang", "norm"]).select("src_lang", "source", "near")
    found = exact.join(missed, ["src_lang", "source"], "left").select("src_lang", "source", F.coalesce("exact", "near").alias("hit_target"))
    return segments.join(found, ["src_lang", "source"], "left")


def search(memory: DataFrame, src_lang: str, tgt_lang: str, phrase: str, limit: int | None = FOUND) -> DataFrame:
    """Rows of two languages whose source has the words of a phrase side by side, in whatever case and with whatever accents.

    What stands between words doesn't count, and a phrase without a word finds nothing. Those of the
    smallest ids, as many as limit; None: all.
    """
    plain = lambda c: F.collate(words(c), "UNICODE_CI_AI")
    pair = memory.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang))
    found = pair.where(plain("source").contains(plain(F.lit(phrase))) & (F.trim(words(F.lit(phrase))) != ""))
    return found if limit is None else found.orderBy("id").limit(limit if limit > 0 else FOUND)


def storable(entries: DataFrame) -> DataFrame:
    """The entries that a memory takes: no blank source, no empty target, no machine translation that equals its source
    between different languages, unless allow_identity. Missing languages or engines are errors."""
    bad = entries.where(~F.coalesce((F.col("src_lang") != "") & (F.col("tgt_lang") != "") & (F.col("engine") != ""), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("entries need languages and an engine")
    return entries.where(_taken())


def _taken() -> Column:
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("machine"))
    identity = (status == "machine") & (F.col("src_lang") != F.col("tgt_lang")) & (trimmed("source_text") == trimmed("target_text")) & ~F.coalesce("allow_identity", F.lit(False))
    return ~is_blank("source_text") & F.coalesce(F.col("target_text") != "", F.lit(False)) & ~F.coalesce(identity, F.lit(False))


def keyed(entries: DataFrame) -> DataFrame:
    """Storable entries in the columns of a memory, with their order ord."""
    return entries.where(_taken()).select(
        "ord", "src_lang", "tgt_lang", F.col("source_text").alias("source"), F.col("target_text").alias("target"), source_hash("source_text").alias("source_hash"),
        normalized_engine("engine").alias("engine"), F.nullif("game", F.lit("")).alias("game"), F.coalesce(F.nullif("status", F.lit("")), F.lit("machine")).alias("status"),
    )


def merged(memory: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """The memory after entries (ord, src_lang, tgt_lang, source_text, target_text, engine, status, game, allow_identity)
    are stored one after another in the order of ord.

    A store is accepted unless it would lower the status; the closed form of the fold: the last row of the lowest
    rank wins, the row in the memory counting as the first; game is the last one given among accepted rows, those
    whose rank is the lowest so far; created_at stays. New rows get ids after the largest, in the order of ord.
    """
    old = memory.select(*COLUMNS, F.lit(-1).cast("long").alias("ord"))
    new = keyed(entries).select(
        F.lit(None).cast("long").alias("id"), "src_lang", "tgt_lang", "source", "target", "source_hash", "engine", F.lit(None).cast("string").alias("model"), "game",
        F.lit(None).cast("string").alias("context"), "status", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.col("ord").cast("long").alias("ord"),
    )
    rows = old.unionByName(new).withColumn("r", rank())
    winner = rows.groupBy(*KEY).agg(
        F.max_by(F.struct("target", "status", "updated_at"), F.struct((-F.col("r")).alias("r"), "ord")).alias("w"),
        F.min_by(F.struct("id", "source", "model", "context", "created_at"), "ord").alias("f"), F.min("ord").alias("born"),
        F.min(F.when(F.col("r") < 1, F.col("ord"))).alias("first_locked"), F.min(F.when(F.col("r") < 2, F.col("ord"))).alias("first_better"),
    )
    limit = F.when(F.col("r") == 1, F.col("first_locked")).when(F.col("r") == 2, F.col("first_better"))
    games = rows.where("game is not null").join(winner.select(*KEY, "first_locked", "first_better"), KEY).where(limit.isNull() | (F.col("ord") < limit))
    kept = winner.join(games.groupBy(*KEY).agg(F.max_by("game", "ord").alias("game")), KEY, "left")
    top = memory.agg(F.max("id")).first()[0] or 0
    return kept.select(
        F.coalesce("f.id", F.col("born") + top + 1).alias("id"), *KEY[:2], "f.source", "w.target", "source_hash", "engine", "f.model", "game", "f.context", "w.status", "f.created_at", "w.updated_at"
    )


def game_links(links: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """Links (game, source_hash, created_at) after the entries' games are added; a link that exists stays, and a rejected entry links too."""
    new = keyed(entries).where("game is not null").select("game", "source_hash", F.lit(now).alias("created_at"))
    rows = links.select("game", "source_hash", "created_at", F.lit(0).alias("n")).unionByName(new.withColumn("n", F.lit(1)))
    return rows.groupBy("game", "source_hash").agg(F.min_by("created_at", F.struct("n", "created_at")).alias("created_at"))


def engines_migrated(memory: DataFrame) -> DataFrame:
    """The memory with the current names of its engines, one row a key: the better status, then the later one, then the row
    that had the current name, then the smaller id. model, context and game of a row that gives way fill what the winner lacks."""
    rows = memory.withColumn("old", (F.col("engine") != normalized_engine("engine"))).withColumn("engine", normalized_engine("engine"))
    order = F.struct((-rank()).alias("r"), F.coalesce("updated_at", F.lit("")).alias("u"), (~F.col("old")).alias("c"), (-F.col("id")).alias("i"))
    fill = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"any_{c}")
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct("id", "source", "target", "status", "created_at", "updated_at"), order).alias("w"), *map(fill, ("model", "game", "context")))
    return best.select("w.id", *KEY[:2], "w.source", "w.target", "source_hash", "engine", F.col("any_model").alias("model"), F.col("any_game").alias("game"), F.col("any_context").alias("context"), "w.status", "w.created_at", "w.updated_at")


def pairs(memory: DataFrame, src_lang: str, tgt_lang: str, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (source, target, min_id) of two languages, to be read in the order of min_id."""
    rows = memory.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang))
    rows = rows.where(F.col("status").isin(*statuses)) if statuses else rows
    return rows.groupBy("source", "target").agg(F.min("id").alias("min_id"))


def classified(memory: DataFrame) -> DataFrame:
    """The memory with what a repair would do: category xtok or engine (the row goes), fixed_case, and final, the
    repaired target."""
    from ..functions.codes import case_restored

    low = F.lower(F.col("engine"))
    xtok = F.col("source").contains(PLACEHOLDER) | F.col("target").contains(PLACEHOLDER)
    gone = F.when(xtok, "xtok").when(low.isin(*TEST_ENGINES), "engine")
    coded = F.col("target").contains("\\")
    rows = memory.withColumn("gone", gone).withColumn("fixed_case", F.when(coded, case_restored("source", "target")).otherwise(F.col("target")))
    return rows.withColumn("final", name_tags_fixed("fixed_case"))


def repair_report(memory: DataFrame) -> DataFrame:
    """One row: how many rows each category and how many protected rows a repair touches. A row can count for both case and name."""
    rows = classified(memory)
    stays = F.col("gone").isNull()
    changed = F.coalesce(F.col("gone").isNotNull() | (F.col("final") != F.col("target")), F.lit(False))
    return rows.agg(
        F.count_if(stays & (F.col("fixed_case") != F.col("target"))).alias("n_case"), F.count_if(stays & (F.col("final") != F.col("fixed_case"))).alias("n_name"),
        F.count_if(F.col("gone") == "xtok").alias("n_xtok"), F.count_if(F.col("gone") == "engine").alias("n_engine"),
        F.count_if(changed & F.col("status").isin("reviewed", "locked")).alias("n_protected"),
    )


def repair_examples(memory: DataFrame, size: int = 3) -> DataFrame:
    """Rows (category, id, before, after): the examples of the smallest ids of each category, as many as size."""
    rows = classified(memory)
    case = (F.col("gone").isNull() & (F.col("fixed_case") != F.col("target")), "case", F.col("fixed_case"))
    name = (F.col("gone").isNull() & (F.col("final") != F.col("fixed_case")), "name", F.col("final"))
    out = [rows.where(w).select(F.lit(c).alias("category"), "id", F.col("target").alias("before"), a.alias("after")).orderBy("id").limit(size) for w, c, a in (case, name, (F.col("gone") == "xtok", "xtok", F.lit("")), (F.col("gone") == "engine", "engine", F.lit("")))]
    return reduce(DataFrame.unionByName, out)


def repaired(memory: DataFrame, now: str) -> DataFrame:
    """The memory after a repair: leaked placeholders and test engines are gone, targets fixed and dated; a second repair changes nothing."""
    rows = classified(memory).where("gone is null")
    changed = F.coalesce(F.col("final") != F.col("target"), F.lit(False))
    return rows.select(*[F.when(changed, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col("final").alias(c) if c == "target" else F.col(c) for c in COLUMNS])


def corrected(memory: DataFrame, entry: DataFrame, now: str, lock: bool = False) -> DataFrame:
    """The memory after a person's corrections (ord, src_lang, tgt_lang, source_text, target_text, game): engine manual, reviewed or locked."""
    return merged(memory, entry.withColumns({"engine": F.lit("manual"), "status": F.lit("locked" if lock else "reviewed"), "allow_identity": F.lit(False)}), now)


def glossary_locked(memory: DataFrame, terms: DataFrame, now: str) -> DataFrame:
    """The memory after whole-segment terms (ord, src_lang, tgt_lang, source_text, target_text) are locked under the engine glossary."""
    return merged(memory, terms.withColumns({"engine": F.lit("glossary"), "status": F.lit("locked"), "game": F.lit(None).cast("string"), "allow_identity": F.lit(False)}), now)
