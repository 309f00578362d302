"""Texts as providers take and return them: batches joined into one request, long texts in pieces, quoted replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, trimmed

# The mark between texts of one request, what comes back for it, the longest piece of a small service.
DELIMITER = "\n<span> </span>\n"
MANGLED = r"[\t\n\f\r ]*<span[^>]*>[\t\n\f\r ]*</span>[\t\n\f\r ]*"
PIECE = 450


def joined(texts) -> Column:
    """An array of texts as one request."""
    return F.array_join(_col(texts), DELIMITER)


def parted(reply, n) -> Column:
    """The n texts of a reply: cut at the mark, else at what is left of it; null if neither gives as many, and each is to be sent alone."""
    exact, loose = (F.split(_col(reply), pattern, -1) for pattern in (rf"\Q{DELIMITER}\E", MANGLED))
    return F.when(F.size(exact) == _col(n), exact).when(F.size(loose) == _col(n), loose)


def pieces(text, size: int = PIECE) -> Column:
    """A text in pieces of so many characters at most, cut at the last line break that fits, which goes; none of the empty text."""
    if size < 2:
        raise ValueError("pieces have two characters or more")
    rule = F.lit(rf"(?s)(.{{1,{size}}})\z|(.{{1,{size - 1}}})\n|(.{{{size}}})")  # the rest, up to a line break, or a full piece
    rest, line, full = (F.regexp_extract_all(_col(text), rule, F.lit(k)) for k in (1, 2, 3))
    either = lambda a, b: F.concat(a, b)  # noqa: E731 (of each match one group isn't empty)
    return F.zip_with(F.zip_with(rest, line, either), full, either)


def unquoted(reply) -> Column:
    """A reply without white space at its ends, and without quotes around the whole of it."""
    clean = trimmed(reply)
    return F.regexp_replace(clean, r'(?s)\A(?:"(.*)"|“(.*)”)\z', "$1$2")
