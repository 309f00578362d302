"""Names of translated files: valid everywhere, and no two alike in a folder."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ..functions.text import sanitized_name


def _root(name) -> F.Column:
    """What names that can meet have in common: no case, no numbers after _. Other letters than ASCII are left out, as
    engines differ in their case; two of them have a lower case that is ASCII."""
    return F.lower(F.regexp_replace(F.translate(name, "\u212a\u0130", "ki"), r"_[0-9]+|[^\x00-\x7f]", ""))


def allocated(files: DataFrame, folder: str = "folder", order: str = "rel") -> DataFrame:
    """files (rel, folder, stem, ext, translated) with target and collided: <stem>_1, _2, ... where a name is taken, whatever its case.

    Which suffix is free depends on the names before that can meet it, so names of one root in a folder are
    one ordered pass, which keeps the names that are taken. Where an extension begins with a digit, a number may run
    into it: such a folder is one pass.
    """
    schema = StructType(list(files.schema.fields)).add("target", StringType()).add("collided", BooleanType())
    columns, names = files.columns, schema.names
    ready = files.withColumn("_clean", sanitized_name("translated", F.lit(""))).withColumn("_ext", sanitized_name(F.lit("x"), "ext").substr(F.lit(2), F.length("ext") + 8))
    whole = ready.where(F.col("_ext").rlike("^[0-9]")).select(F.col(folder).alias("_folder"), F.lit("").alias("_whole")).distinct()
    ready = ready.join(whole, F.col(folder).eqNullSafe(F.col("_folder")), "left").withColumn("_root", F.coalesce("_whole", _root(F.concat("_clean", "_ext")))).drop("_folder", "_whole")

    def name(batches):
        group, used, following = None, set(), {}
        for batch in batches:
            targets, collided = [], []
            for *own, stem, ext in zip(*(batch.column(c).to_pylist() for c in (folder, "_root", "_clean", "_ext"))):
                if own != group:
                    group, used, following = own, set(), {}
                candidate, n = stem + ext, 0
                if candidate.lower() in used:
                    alike = stem.lower(), ext.lower()
                    n = next(n for n in count(following.get(alike, 1)) if f"{stem}_{n}{ext}".lower() not in used)
                    candidate, following[alike] = f"{stem}_{n}{ext}", n + 1
                used.add(candidate.lower())
                targets.append(candidate)
                collided.append(n > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(targets, pa.string()), pa.array(collided, pa.bool_())], names)

    return ready.repartition(folder, "_root").sortWithinPartitions(folder, "_root", F.asc_nulls_last(order)).mapInArrow(name, schema)


def summary(named: DataFrame) -> DataFrame:
    return named.agg(F.count("*").alias("total"), F.count_if("collided").alias("collisions"))
