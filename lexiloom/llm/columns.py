"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of a block when an array is summed up.
_BLOCK = 128


def running(lengths: Column) -> Column:
    """What stands before each number of an array: sums within blocks of fixed size, so that the work stays near the array's length."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))

    def scan(numbers: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(numbers, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    starts = scan(sums, zero)
    inside = F.zip_with(blocks, starts, lambda b, s: scan(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), s))
    return F.when(F.size(lengths) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))
