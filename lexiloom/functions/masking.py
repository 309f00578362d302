r"""Masking of protected text (codes, tags, variables) behind numbered placeholders, and its inverse.

Two forms. Where one pattern is enough, mask_single is a JVM-side expression. Several patterns in
turn, each over what the ones before have masked, are a fold over the text, done in Arrow batches by
masked().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

# The form of placeholders, and what translators make of them.
PREFIX = "__XTOK_"
PLACEHOLDER = r"__XTOK_[A-Za-z0-9]+__"
MANGLED = r"(?i)__[\t\n\f\r ]*XTOK[_\t\n\f\r ]+([a-z0-9]+)[\t\n\f\r ]*__"

# Protected patterns, in the order in which they are masked.
DEFAULT_PATTERNS = (r"\\[A-Za-z]+\[[^\]]*\]", r"\\[.|!^${}G#+\-]", r"</?[A-Za-z0-9_]+(?:\s+[^>]*)?>")
CSV_PATTERNS = (
    r"\\[A-Za-z]+\s*\[[^\]]*\]", r"\\[A-Za-z]+\s*<[^>]*>", r"%[0-9]*\.?[0-9]*[sdfoxX]", r"\{[a-zA-Z0-9_]+\}",
    r"</?[a-zA-Z][a-zA-Z0-9=_\-#]*(?:\s+[^>]*)?/?>", r"\\n|\\r|\\t",
)
VARIABLE = r"!?(?:[vVsS]|ss|sv)\[\s*\d+\s*\]"
JSON_PATTERNS = (
    r"\\[A-Za-z]+\s*\[[^\]]*\]", r"\\[A-Za-z]+\s*<.*?>", r"(?i:@(?:if|else)[^\n]*)", r"\$\{[^}]*\}",
    r"(?i:\$game(?:Variables|Switches|Party|Actors|Player|Map|System|Screen))(?:\.[a-zA-Z0-9_]+(?:\([^)]*\))?)*", r"(?s:^\s*\(?[a-zA-Z0-9_,\s]*\)?\s*=>.*\Z)",
    ("guarded", VARIABLE, "!"), r"%[0-9]*\.?[0-9]*[sdfoxX]", r"\{[a-zA-Z0-9_]+\}", r"</?[a-zA-Z][a-zA-Z0-9=_\-#]*(?:\s+[^>]*)?/?>",
)
BINARY_PATTERNS = (
    r"(?i:\\[cvs]\s*\[[^\]]*\])", r"(?i:\\(?:cself|self)\s*\[[^\]]*\])", r"(?i:\\font\s*\[[^\]]*\])", r"(?i:\\[wt]\s*\[[^\]]*\])",
    r"(?i:\\(?:[a-qs-z][a-z]{0,4}|r[a-z]{1,4})\s*\[[^\]]*\])", r"(?i:</?[a-z][a-z0-9]*(?:\s+[^>]*)?/?>)", r"(?i:%[0-9]*[sdif])",
)

Finder = Callable[[str], Iterable[tuple[int, int]]]
_WORD_OR_BACKSLASH = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_\\")


class IntegrityError(ValueError):
    """A placeholder is missing, doubled or unknown in a translation."""


def _ascii(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def finder(pattern) -> Finder:
    """A function that finds protected spans: from a pattern, from ("guarded", pattern, lead), or the function itself."""
    if callable(pattern):
        return pattern
    if isinstance(pattern, tuple):
        return guarded(pattern[1], pattern[2])
    compiled = _ascii(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def guarded(pattern: str, lead: str = "", rejected: frozenset[str] = _WORD_OR_BACKSLASH) -> Finder:
    """Matches without a rejected character before them, or before what follows their lead."""
    compiled = _ascii(pattern)

    def find(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while (m := compiled.search(text, at)) is not None:
            guard = m.start() + (len(lead) if lead and m[0].startswith(lead) else 0)
            if guard and text[guard - 1] in rejected:
                at = m.start() + 1
                continue
            yield m.span()
            at = max(m.end(), m.start() + 1)

    return find


def _apart(spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans that aren't empty and begin after the ones before them."""
    done = 0
    for start, end in spans:
        if done <= start < end:
            yield start, end
            done = end


class Masker:
    """Patterns masked one after another. Each cuts the text, with the placeholders so far, into plain and protected
    pieces in turn; the protected ones are then numbered. Numbers whose placeholder the text itself holds are left out.
    A piece that takes in earlier placeholders is one piece; one that is a placeholder stays."""

    def __init__(self, patterns: Iterable = DEFAULT_PATTERNS):
        self.finders = [finder(p) for p in patterns]

    def mask(self, text: str) -> tuple[str, dict[str, str]]:
        names = (name for k in count() if (name := f"{PREFIX}{k}__") not in text)
        shown, held = text, {}
        for find in self.finders:
            spans = [(a, b) for a, b in _apart(find(shown)) if shown[a:b] not in held]
            pieces = [shown[a:b] for a, b in pairwise([0, *chain(*spans), len(shown)])]
            for k, name in zip(range(1, len(pieces), 2), names):
                whole = re.sub(PLACEHOLDER, lambda m: held.pop(m[0], m[0]), pieces[k])
                held[name], pieces[k] = whole, name
            shown = "".join(pieces)
        return shown, held


def unmasked(text: str, found: dict[str, str]) -> str:
    """The translation with its placeholders restored. They may have changed case or spacing, but each has to be there once."""
    pieces = re.split(f"({PLACEHOLDER})", re.sub(MANGLED, lambda m: f"{PREFIX}{m[1].upper()}__", text))
    names = Counter(pieces[1::2])
    for what, wrong in (("unexpected", names.keys() - found.keys()), ("missing", found.keys() - names.keys()), ("doubled", (names - Counter(found.keys())).keys())):
        if wrong:
            raise IntegrityError(f"placeholder {min(wrong)} {what}")
    return "".join(found.get(piece, piece) if k % 2 else piece for k, piece in enumerate(pieces))


def masked(df: DataFrame, patterns=DEFAULT_PATTERNS, text: str = "source") -> DataFrame:
    """df with masked and token_map; a null text has both null."""
    kept = [c for c in df.columns if c not in ("masked", "token_map")]
    at = kept.index(text)

    def run(batches):
        masker = Masker(patterns)
        for batch in batches:
            done = [(None, None) if t.as_py() is None else masker.mask(t.as_py()) for t in batch.column(at)]
            maps = pa.array([None if m is None else list(m.items()) for _, m in done], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t for t, _ in done], pa.string()), maps], [*kept, "masked", "token_map"])

    schema = StructType(list(df.select(*kept).schema.fields)).add("masked", StringType()).add("token_map", MapType(StringType(), StringType()))
    return df.select(*kept).mapInArrow(run, schema)


def mask_single(text, pattern: str) -> Column:
    """struct(masked, token_map) for one pattern, by JVM-side expressions; for texts without literal placeholders."""
    t = F.col(text) if isinstance(text, str) else text
    found, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    names = F.transform(found, lambda _, k: F.concat(F.lit(PREFIX), k.cast("string"), F.lit("__")))
    parts = F.zip_with(gaps, names, lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    return F.struct(F.array_join(parts, "").alias("masked"), F.map_from_arrays(names, found).alias("token_map"))


def normalized_placeholders(text) -> Column:
    """Mangled placeholders as they were: for numbered ones, whose names have no letters."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, MANGLED, f"{PREFIX}$1__")


def is_intact(text, token_map) -> Column:
    """Whether each placeholder of the map is in the translation once, and no other one."""
    names = F.map_keys(F.col(token_map) if isinstance(token_map, str) else token_map)
    seen = F.regexp_extract_all(normalized_placeholders(text), F.lit(PLACEHOLDER), F.lit(0))
    return (F.array_sort(seen) == F.array_sort(names)) | ((F.size(seen) == 0) & (F.size(names) == 0))


def unmask_column(text, token_map) -> Column:
    """The translation restored, by JVM-side expressions; null where it isn't intact."""
    m = F.col(token_map) if isinstance(token_map, str) else token_map
    whole = normalized_placeholders(text)
    names = F.regexp_extract_all(whole, F.lit(PLACEHOLDER), F.lit(0))
    parts = F.zip_with(F.split(whole, PLACEHOLDER, -1), names, lambda g, n: F.concat(g, F.coalesce(F.element_at(m, n), F.lit(""))))
    return F.when(is_intact(text, token_map), F.array_join(parts, ""))
