"""A corpus pipeline of five stages over the table documents.

Each stage reads all that its predecessor kept: documents that the quality classifier rejects go;
one document of each group of near duplicates stays; documents that hold benchmark items go;
personal data is replaced by its kind; and what is left is encoded, its ids decoded for control.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, decontaminate, jaccard, pii, quality
from lexiloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade reaches the threshold. The model is fitted on the labelled rows of the input."""
    model = quality.model_of(docs, table(spark, sf_dir, "labels"))
    return quality.graded(docs.select(COLUMNS), model, keep=quality.KEEP).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return jaccard.representatives(docs.select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets; n_chars follows the text."""
    return pii.redacted(docs.select(COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) n_chars")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, the digest of the ids and that of the bytes they decode to."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("byte-level BPE", encoding_stage),
]

#: The stages are models, similarity joins and encodings that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
