"""Batches for a provider: greedy in order, closed when full."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from .estimate import DELIMITER_CHARS, Capabilities


def assigned(texts: DataFrame, provider: Capabilities, shard: list[str], order: str = "ord", text: str = "source") -> DataFrame:
    """texts with batch, its number within the shard: a text opens a new batch if the open one has max_items, or if its
    characters and marks would reach max_chars.

    The sum starts again with each batch, so no window expresses it: each shard is one ordered fold. Choose
    shards of bounded size, such as files; each shard is batched by itself.
    """
    schema = StructType(list(texts.schema.fields)).add("batch", LongType())

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, items, chars, out = 0, 0, 0, []
        for t in pdf[text]:
            size = len(t) + DELIMITER_CHARS
            if items and ((provider.max_items and items >= provider.max_items) or chars + size >= provider.max_chars):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + size
            out.append(batch)
        return pdf.assign(batch=out)

    return texts.groupBy(*shard).applyInPandas(fold, schema)
