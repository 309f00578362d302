r"""Control codes of translated texts: case restored from the source (\f[x] for \F[x] and the like)."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CODE = re.compile(r"(?<!\\)\\([A-Za-z]+)[\t\n\f\r ]*\[")
# Codes that are read in either case.
EITHER_CASE = frozenset({"c", "v", "i", "ce", "m", "n", "p", "g"})


def restored(source: str, target: str) -> str:
    """target with the case of the source's codes, where the source spells a code in one way only."""
    spellings = defaultdict(set)
    for m in _CODE.finditer(source):
        spellings[m[1].lower()].add(m[1])
    one = {low: next(iter(s)) for low, s in spellings.items() if len(s) == 1 and low not in EITHER_CASE}

    def put(m: re.Match) -> str:
        name = one.get(m[1].lower(), m[1])
        return "\\" + name + m[0][1 + len(m[1]) :]

    return _CODE.sub(put, target) if one else target


@F.pandas_udf(StringType())
def case_restored(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or t is None else restored(s, t) for s, t in zip(source, target)], dtype=object)
