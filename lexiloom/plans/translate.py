"""The translation of segments as one lazy plan: unique texts, memory, masks, provider, integrity, repairs, new pairs.

    segments -> unique (kind, source) -> memory -> misses -> masked -> unique masked texts -> provider
             -> unmasked and checked -> fixed -> back to every occurrence; fresh pairs -> entries for the memory

Each distinct text is looked up once and each distinct masked text sent once, however often it occurs:
both are explicit aggregates, since the optimizer doesn't share inputs of Python functions.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking, text
from ..operators import estimate, memory, outcome
from ..operators.estimate import Capabilities
from ..operators.memory import Policy


class RateLimited(Exception):
    """The provider wants fewer requests."""


class Unauthorized(Exception):
    """The provider doesn't accept the key: the run ends."""


class Unavailable(Exception):
    """The provider is down."""


class CircuitOpen(Exception):
    """Too many requests have failed one after another."""


class Provider(Protocol):
    """Translates texts in their order, as many as it was given. Instances are sent to the executors."""

    capabilities: Capabilities

    def translate(self, texts: list[str], src_lang: str, tgt_lang: str) -> list[str]: ...


@dataclass
class Wrapping:
    """A deterministic provider for tests and dry runs: every text between two marks."""

    before: str = "PT["
    after: str = "]"
    capabilities: Capabilities = field(default_factory=Capabilities)

    def translate(self, texts: list[str], src_lang: str, tgt_lang: str) -> list[str]:
        return [f"{self.before}{t}{self.after}" for t in texts]


@dataclass(frozen=True)
class Retry:
    """Attempts of a batch, and the pauses between them: doubling up to a limit, with a little chance."""

    attempts: int = 5
    first: float = 0.5
    longest: float = 30.0
    jitter: float = 0.05

    def pause(self, attempt: int) -> float:
        return min(self.longest, self.first * 2**attempt) + random.random() * self.jitter


class Caller:
    """A provider with retries, a circuit breaker and a fallback from batches to single texts. Each task has its own: failures of others aren't seen."""

    def __init__(self, provider: Provider, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep):
        self.provider, self.retry, self.sleep = provider, retry, sleep
        self.failures, self.limited = 0, False

    def state(self, ok: bool) -> str:
        """What became of a batch: ok, limited, open (the circuit) or failed."""
        return "ok" if ok else "limited" if self.limited else "open" if self.failures >= self.retry.attempts else "failed"

    def batch(self, texts: list[str], src: str, tgt: str) -> tuple[list[str], bool]:
        """The translations, or the texts themselves and False when all attempts have failed."""
        for attempt in range(self.retry.attempts):
            if self.limited or self.failures >= self.retry.attempts:
                return texts, False
            try:
                out = self.provider.translate(texts, src, tgt)
            except Unauthorized:
                raise
            except RateLimited:  # more requests would only make it worse: the rest of the task isn't sent
                self.failures += 1
                self.limited = True
                return texts, False
            except Exception:
                self.failures += 1
                if attempt + 1 < self.retry.attempts:
                    self.sleep(self.retry.pause(attempt))
                continue
            self.failures = 0
            if len(out) == len(texts):
                return list(out), True
            if len(texts) == 1:
                return texts, False
            single = [self.batch([t], src, tgt) for t in texts]
            return [t[0] for t, _ in single], all(ok for _, ok in single)
        return texts, False


def _batches(rows: Iterator[tuple[str, str]], limit: Capabilities) -> Iterator[list[str]]:
    """Greedy batches of texts in one language."""
    open_, chars = [], 0
    for t in rows:
        size = len(t) + estimate.DELIMITER_CHARS
        if open_ and ((limit.max_items and len(open_) >= limit.max_items) or chars + size >= limit.max_chars):
            yield open_
            open_, chars = [], 0
        open_.append(t)
        chars += size
    if open_:
        yield open_


def sent(texts: DataFrame, provider: Provider, tgt_lang: str, retry: Retry = Retry()) -> DataFrame:
    """Rows (src_lang, masked, came, state) of distinct texts (src_lang, masked), as many tasks side by side as the provider takes."""
    limit = provider.capabilities

    def run(batches):
        caller = Caller(provider, retry)
        for batch in batches:
            by_language: dict[str, list[str]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_language.setdefault(lang, []).append(t)
            rows = []
            for lang, own in by_language.items():
                for some in _batches(iter(own), limit):
                    out, ok = caller.batch(some, lang, tgt_lang)
                    rows += [(lang, a, b, caller.state(ok)) for a, b in zip(some, out)]
            names = ["src_lang", "masked", "came", "state"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    return texts.select("src_lang", "masked").repartition(limit.concurrency).mapInArrow(run, "src_lang string, masked string, came string, state string")


@dataclass(frozen=True)
class Result:
    """Plans of a run: occurrences with targets, unique translations, entries for the memory, and totals."""

    occurrences: DataFrame
    translations: DataFrame
    entries: DataFrame

    def stats(self) -> DataFrame:
        """One row: total, cached, translated and failed unique texts."""
        fresh = ~F.col("cached")
        return self.translations.agg(
            F.count("*").alias("total"), F.count_if("cached").alias("cached"), F.count_if(fresh & F.col("stored")).alias("translated"), F.count_if(fresh & F.col("failed")).alias("failed")
        )

    def health(self) -> DataFrame:
        """One row: unique texts that were sent, those whose request failed, whether the provider set a limit, whether a circuit opened."""
        is_ = lambda s: F.coalesce(F.bool_or(F.col("state") == s), F.lit(False))
        return self.translations.agg(
            F.count_if(F.col("state").isin("ok", "failed", "limited", "open")).alias("sent"), F.count_if(F.col("state").isin("failed", "limited", "open")).alias("unanswered"),
            is_("limited").alias("rate_limited"), is_("open").alias("circuit_open"),
        )


def translated(
    segments: DataFrame, tm: DataFrame, tgt_lang: str, engine: str, provider: Provider | None, patterns=masking.DEFAULT_PATTERNS,
    policy: Policy = Policy(), game: str = "", retry: Retry = Retry(), post_process: Callable[[DataFrame], DataFrame] | None = None,
    kept: Callable[[DataFrame], DataFrame] | None = None,
) -> Result:
    """Translate segments (file, id, ord, src_lang, kind, source). Without a provider misses stay as they are.

    A text whose translation loses, doubles or invents a placeholder goes back to its source and counts
    as failed; the others aren't touched by it. kept: writes the unique translations and reads them again,
    so that no reply is asked for twice.
    """
    unique = segments.groupBy("src_lang", "kind", "source").agg(F.min("ord").alias("ord"))
    found = memory.lookup(unique, tm, tgt_lang, engine, policy)
    misses = found.where(F.col("hit_target").isNull() | (F.col("hit_target") == "")).drop("hit_target")
    hits = found.where(F.col("hit_target") != "").select("src_lang", "kind", "source", "ord", F.col("hit_target").alias("target"), F.lit(True).alias("cached"), F.lit(False).alias("failed"), F.lit("cached").alias("state"))
    if provider is None:
        fresh = misses.select("src_lang", "kind", "source", "ord", F.col("source").alias("target"), F.lit(False).alias("cached"), F.lit(False).alias("failed"), F.lit("unsent").alias("state"))
    else:
        hidden = masking.masked(misses.where(~text.is_blank("source")), patterns)
        came = sent(hidden.select("src_lang", "masked").distinct(), provider, tgt_lang, retry)
        rows = hidden.join(came, ["src_lang", "masked"])
        rows = post_process(rows) if post_process else rows
        whole = masking.unmask_column("came", "token_map")
        rows = rows.withColumn("target", F.coalesce(whole, F.col("source"))).withColumn("failed", whole.isNull() | (F.col("state") != "ok"))
        rows = rows.withColumn("target", text.typographic_quotes_fixed("target", "source", "kind"))
        blank = misses.where(text.is_blank("source")).select("src_lang", "kind", "source", "ord", F.col("source").alias("target"), F.lit(False).alias("cached"), F.lit(False).alias("failed"), F.lit("unsent").alias("state"))
        fresh = rows.select("src_lang", "kind", "source", "ord", "target", F.lit(False).alias("cached"), "failed", "state").unionByName(blank)
    stored = ~F.col("cached") & (F.col("target") != F.col("source")) & ~F.col("target").contains("__XTOK_")
    all_ = hits.unionByName(fresh).withColumn("stored", stored)
    all_ = kept(all_) if kept else all_
    entries = all_.where("stored").select(
        "ord", "src_lang", F.lit(tgt_lang).alias("tgt_lang"), F.col("source").alias("source_text"), F.col("target").alias("target_text"), F.lit(engine).alias("engine"), F.lit("machine").alias("status"),
        F.lit(game).alias("game"), F.lit(False).alias("allow_identity"),
    )
    occurrences = segments.join(all_.select("src_lang", "kind", "source", "target", "cached"), ["src_lang", "kind", "source"], "left").withColumn("target", F.coalesce(F.nullif("target", F.lit("")), F.col("source")))
    return Result(occurrences, all_, entries)


def outcomes(result: Result, tgt_lang: str) -> DataFrame:
    return outcome.file_outcomes(result.occurrences, tgt_lang)
