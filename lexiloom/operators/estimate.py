"""What a run would cost, before it: segments, those in memory, characters to send, and time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Capabilities:
    """What a provider takes at once: characters and items of a batch (0: any number), and batches side by side."""

    max_chars: int = 5000
    max_items: int = 0
    concurrency: int = 4

    def __post_init__(self):
        if self.max_chars <= 0 or self.concurrency <= 0:
            object.__setattr__(self, "max_chars", self.max_chars if self.max_chars > 0 else 5000)
            object.__setattr__(self, "concurrency", self.concurrency if self.concurrency > 0 else 4)


# Limits of the known providers; milliseconds of a wave of batches; marks between the texts of a batch.
PROVIDERS = {"google": Capabilities(5000, 0, 4), "deepl": Capabilities(10000, 50, 5), "ollama": Capabilities(10000, 1, 10)}
WAVE_MS = 1500
DELIMITER_CHARS = 16


def duration_ms(chars: Column, provider: Capabilities) -> Column:
    """Full waves of full batches."""
    waves = F.ceil(F.ceil(chars / provider.max_chars) / provider.concurrency)
    return F.when(chars > 0, waves * WAVE_MS).otherwise(0).cast("long")


def estimated(segments: DataFrame, by: list[str], provider: Capabilities = Capabilities()) -> DataFrame:
    """segments (source, hit_target, ...) summed by the columns: every occurrence counts."""
    missed = F.col("hit_target").isNull()
    rows = segments.groupBy(*by).agg(
        F.count("*").alias("segments_total"), F.count_if(~missed).alias("segments_cached"), F.coalesce(F.sum(F.when(missed, F.length("source").cast("long"))), F.lit(0)).alias("uncached_chars")
    )
    return rows.withColumn("est_ms", duration_ms(F.col("uncached_chars"), provider))
