"""Operator 2: substring dedup by line hashing.

A text is cut into units: its paragraphs (between blank lines), their lines, and within a line its
sentences (after . ! or ? and white space), so that a passage counts wherever in a line it was put.
Units are normalised (lower case, white space collapsed), their digests grouped over the whole
corpus, and only the occurrence with the smallest (key, place) stays. Lines and paragraphs are
removed at any length; sentences within a line of fewer than ``LEAST_WORDS`` words are not: they
repeat by chance. Of units within each other that are all removed, the outermost is the one reported.

The earliest occurrence of a digest is a map-side combined minimum, so a very common line costs one
row a task; only digests that occur again are joined back to their occurrences, by a join whose hot
partitions adaptive execution can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stored

#: Words of the shortest sentence that is removed when repeated.
LEAST_WORDS = 8
#: Ends of sentences: line breaks, or white space after the end of a sentence.
BREAK = r"\n+|(?<=[.!?])[\x20\t]+"
#: Ends of paragraphs: blank lines.
BLANK = r"\n(?:[\x20\t\r]*\n)+"
PARAGRAPH, LINE, SENTENCE = 0, 1, 2
#: Units after which a batch of them is passed on.
BATCH = 50_000


def _parts(text: str, ends: re.Pattern) -> Iterator[tuple[int, str]]:
    """The parts of a text between matches of a pattern, and their places."""
    done = 0
    for gap in ends.finditer(text):
        yield done, text[done : gap.start()]
        done = gap.end()
    yield done, text[done:]


def cut(text: str, least_words: int, whole: bool) -> Iterator[tuple[int, int, str, int, int, int]]:
    """The units of a text: start, end, normalised (lower case, runs of white space as one space, none
    at the edges), kind, and the places where the line and the paragraph around it start."""
    for block_at, block in _parts(text, _BLANK):
        if whole and "\n" in block.strip():
            yield block_at, block_at + len(block), " ".join(block.lower().split()), PARAGRAPH, block_at, block_at
        line_at = block_at
        for line in block.split("\n"):
            sentences = list(_parts(line, _BREAK))
            if whole and (norm := " ".join(line.lower().split())):
                yield line_at, line_at + len(line), norm, LINE, line_at, block_at
            if not whole or len(sentences) > 1:
                for at, sentence in sentences:
                    found = sentence.lower().split()
                    if found and len(found) >= least_words:
                        yield line_at + at, line_at + at + len(sentence), " ".join(found), SENTENCE, line_at, block_at
            line_at += len(line) + 1


_BLANK, _BREAK = re.compile(BLANK), re.compile(BREAK)
_PLACES = "start bigint, end bigint, digest binary, kind int, line bigint, paragraph bigint"
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())


def units(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, whole: bool = False) -> DataFrame:
    """Rows (key, start, end, digest, kind, line, paragraph) of the units, places in code points, end exclusive.

    Sentences have at least so many words. whole: lines and paragraphs of any length beside them; a
    line that is one sentence, or a paragraph that is one line, is one unit. line and paragraph are
    the places where those around a unit start. The digest has 128 bits. Null, empty and blank texts
    have no units.
    """

    def packed(keys: pa.Array, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found), _TYPES)] if found else [pa.array([], kind) for kind in _TYPES]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), *columns], [key, "start", "end", "digest", "kind", "line", "paragraph"])

    def run(batches):
        for batch in batches:
            keys, rows, found = batch.column(0), [], []
            for row, value in enumerate(batch.column(1)):
                for start, end, norm, *rest in cut(value.as_py() or "", least_words, whole):
                    rows.append(row)
                    found.append((start, end, md5(norm.encode()).digest(), *rest))
                    if len(found) >= BATCH:
                        yield packed(keys, rows, found)
                        rows, found = [], []
            yield packed(keys, rows, found)

    parts = df.select(F.col(key), F.col(text))
    schema = StructType([StructField(key, parts.schema[0].dataType), *StructType.fromDDL(_PLACES)])
    return parts.mapInArrow(run, schema)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, whole: bool = False) -> DataFrame:
    """Rows (key, start, end, first_<key>, first_start) of the units to remove, with the occurrence that stays.

    whole: lines and paragraphs of any length too, and no unit within another that is removed.
    Rows of df with the same key are the same document: a unit at the same place of both stays in
    both. A null key comes before all others.
    """
    found = stored(units(df, key, text, least_words, whole))  # read twice: texts are cut and digested once
    place = F.struct(F.col(key).alias("k"), F.col("start").alias("s"))
    again = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    joined = found.join(again, "digest").where(~((F.col(key).eqNullSafe(F.col("first.k"))) & (F.col("start") == F.col("first.s"))))
    joined = joined.select(key, "start", "end", F.col("first.k").alias(f"first_{key}"), F.col("first.s").alias("first_start"), "kind", "line", "paragraph")
    if whole:
        joined = stored(joined)
        for kind, around in ((LINE, "line"), (PARAGRAPH, "paragraph")):
            outer = joined.where(F.col("kind") == kind).select(F.col(key).alias("_key"), F.col("start").alias("_start")).distinct()
            inside = joined.where(F.col("kind") > kind).join(outer, F.col(key).eqNullSafe(F.col("_key")) & (F.col(around) == F.col("_start")), "left_anti")
            joined = joined.where(F.col("kind") <= kind).union(inside)
    return joined.drop("kind", "line", "paragraph")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, whole: bool = False) -> DataFrame:
    """df with the repeated units cut out of its texts, and a column removed with their original places
    (array of structs start, end; null if nothing was cut). Breaks beside a unit stay. Rows with a null
    key are returned as they are. A column named removed is replaced."""
    cut = repeats(df, key, text, least_words, whole).groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    kept = [c for c in df.columns if c.lower() != "removed"]
    joined = df.select(*kept).join(cut, key, "left").select(*kept, "removed")
    at = kept.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(at), batch.column(len(kept))):
                t, done, parts = value.as_py(), 0, []
                for s in spans.as_py() or ():
                    parts.append(t[done : s["start"]])
                    done = s["end"]
                out.append(t if not done else "".join(parts) + t[done:])
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*kept, "removed"])

    return joined.mapInArrow(run, joined.schema)
