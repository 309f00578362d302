"""Text columns: normal forms, hashes, and tests of single strings. JVM-side expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Unicode white space, spelled out: \s, trim and \v mean different sets in different engines.
WHITE_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Names of engines that older memories hold, and what they are called now.
ENGINE_ALIASES = {
    "googletraslator": "google",
    "googletranslator": "google",
    "googletranslate": "google",
    "deepltranslator": "deepl",
    "deepltranslate": "deepl",
    "ollamatranslator": "ollama",
    "ollamatranslate": "ollama",
}

# File names that one system reserves, characters that none allows.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{n}" for n in range(1, 10)), *(f"LPT{n}" for n in range(1, 10)))
INVALID_IN_NAMES = r'[/\\<>:"|?*\x00-\x1f]'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_col(text), rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def is_blank(text) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def normalized_source(text) -> Column:
    """Every line with its white space collapsed and its ends trimmed; line breaks stay."""
    blank = WHITE_SPACE.replace(r"\n", "")
    collapsed = F.regexp_replace(_col(text), f"[{blank}]+", " ")
    return F.array_join(F.transform(F.split(collapsed, "\n", -1), lambda line: F.trim(line)), "\n")


def words(text) -> Column:
    """The words of a text, runs of letters, digits and marks, with a space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(_col(text), r"[^\pL\pN\pM]+", " ")), F.lit(" "))


def source_hash(text) -> Column:
    """The key of a memory: SHA-1 of the raw text."""
    return F.sha1(_col(text))


def content_hash(data) -> Column:
    """The identity of a text or file: SHA-256 of its bytes; the empty string for null."""
    return F.coalesce(F.sha2(_col(data), 256), F.lit(""))


def normalized_engine(engine) -> Column:
    """The lower-case current name of an engine."""
    low = F.lower(_col(engine))
    names = F.create_map(*(F.lit(x) for pair in ENGINE_ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(names, low), low)


def is_numeric_or_code(text) -> Column:
    """Digits and . , + - alone, once trimmed; true for the empty text."""
    return F.rlike(trimmed(text), F.lit(r"\A[0-9.,+\-]*\z"))


def name_tags_fixed(text) -> Column:
    r"""\nome[, \namE[ and the like as \NAME[."""
    return F.regexp_replace(_col(text), r"\\(?:nam[eE]|nom[eE])(?:[\t\n\f\r ]*)\[", r"\\\\NAME[")


def ruby_unwrapped(text) -> Column:
    r"""\r[base,reading] as base."""
    return F.regexp_replace(_col(text), r"\\r\[([^,\]]*),[^\]]*\]", "$1")


def typographic_quotes_fixed(target, source, kind) -> Column:
    """ASCII quotes for typographic ones, in scripts whose target differs from its source."""
    target, source = _col(target), _col(source)
    return F.when((_col(kind) == "script") & (target != source), F.translate(target, "“”‘’", "\"\"''")).otherwise(target)


def xml_escaped(text) -> Column:
    """For XML text: the five marks, and tab, line feed and return as references; what XML can't hold as U+FFFD."""
    out = F.regexp_replace(_col(text), r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "\ufffd")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def pointer_escaped(token) -> Column:
    """A token of a JSON Pointer."""
    return F.replace(F.replace(_col(token), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescaped(token) -> Column:
    return F.replace(F.replace(_col(token), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def sanitized_name(stem, extension) -> Column:
    """A file name that every system allows: forbidden characters as _, no spaces or dots at the ends, no reserved stem."""
    clean = F.regexp_replace(F.regexp_replace(_col(stem), INVALID_IN_NAMES, "_"), r"\A[ .]+|[ .]+\z", "")
    clean = F.when(clean == "", F.lit("unnamed")).otherwise(clean)
    upper = F.upper(clean)
    reserved = upper.isin(*RESERVED_NAMES) | F.split_part(upper, F.lit("."), F.lit(1)).isin(*RESERVED_NAMES)
    return F.concat(F.when(reserved, F.concat(F.lit("_"), clean)).otherwise(clean), F.regexp_replace(_col(extension), INVALID_IN_NAMES, "_"))


def sniffed_delimiter(text) -> Column:
    """The most frequent of , ; tab | in the first five lines; the earlier one of equals, a comma for none."""
    head = F.array_join(F.slice(F.split(_col(text), "\n", -1), 1, 5), "\n")
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("order"), F.lit(d).alias("d")) for k, d in enumerate(",;\t|")]
    return F.greatest(*counts)["d"]


def sniffed_line_end(text) -> Column:
    """CRLF where there is one, a lone CR where there is no LF, else LF."""
    t = _col(text)
    return F.when(t.contains("\r\n"), "\r\n").when(t.contains("\r") & ~t.contains("\n"), "\r").otherwise("\n")


def has_cjk(text) -> Column:
    return F.rlike(_col(text), F.lit(r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"))


def glob_of(extensions) -> str:
    """A pattern of file names with one of the extensions, in whatever case: for readers that list names before they read contents."""
    either = lambda c: f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c
    return "*{" + ",".join("".join(map(either, e)) for e in extensions) + "}" if extensions else "*"
