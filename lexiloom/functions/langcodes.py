"""Languages by their codes and names, in columns and in file names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Code, English name and other spellings; where spellings overlap the first entry counts.
LANGUAGES = (
    ("en", "English", ("en", "eng", "en_us", "en-us", "en_gb", "en-gb", "english", "ingles")),
    ("pt", "Portuguese", ("pt", "por", "pt_br", "pt-br", "pt_pt", "pt-pt", "portuguese", "portugues", "brazilian")),
    ("es", "Spanish", ("es", "spa", "es_es", "es-es", "es_419", "es-419", "spanish", "espanol", "castellano")),
    ("fr", "French", ("fr", "fra", "fre", "french", "francais")),
    ("de", "German", ("de", "deu", "ger", "german", "deutsch")),
    ("it", "Italian", ("it", "ita", "italian", "italiano")),
    ("ja", "Japanese", ("ja", "jp", "jpn", "japanese", "japones", "nihongo")),
    ("ko", "Korean", ("ko", "kor", "korean", "coreano", "hangul")),
    ("ru", "Russian", ("ru", "rus", "russian", "russo")),
    ("zh", "Chinese", ("zh", "chi", "zho", "zh_cn", "zh-cn", "zh_tw", "zh-tw", "chinese", "chines", "schinese", "tchinese")),
    ("pl", "Polish", ("pl", "pol", "polish", "polones")),
    ("tr", "Turkish", ("tr", "tur", "turkish", "turco")),
    ("uk", "Ukrainian", ("uk", "ukr", "ukrainian", "ucraniano")),
    ("vi", "Vietnamese", ("vi", "vie", "vietnamese", "vietnamita")),
)

ENGLISH_NAMES = {code: name for code, name, _ in LANGUAGES}
#: Spelling without separators to code.
SPELLINGS: dict[str, str] = {}
for _code, _, _names in LANGUAGES:
    for _name in _names:
        SPELLINGS.setdefault(_name.replace("-", "").replace("_", ""), _code)
#: Latin letters with marks and what stays without them.
_MARKED = {c: b for c in map(chr, range(0xC0, 0x250)) if len(b := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and b != c}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def language_of(text) -> Column:
    """The code of a language code or name (pt_BR, Português, english); the empty string for others."""
    t = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.translate(F.lower(trimmed(t)), "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")
    bare = F.translate(bare, "-_ ", "")
    return F.coalesce(F.element_at(_map(SPELLINGS), bare), F.lit(""))


def english_name(code) -> Column:
    """The English name; an unknown code with a capital."""
    c = F.col(code) if isinstance(code, str) else code
    other = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.coalesce(F.element_at(_map(ENGLISH_NAMES), F.nullif(language_of(c), F.lit(""))), other)


def stem(path) -> Column:
    """The file name without its folder and last extension."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.substring_index(p, "/", -1), r"\.[^.]*\z", "")


def from_filename(path) -> Column:
    """struct(lang, pattern) of a file name: code_exact, name_exact, suffix, suffix_composite or prefix; null without a language."""
    name = stem(path)
    parts = F.split(name, "[-_]", -1)
    n = F.size(parts)
    of = lambda lang, pattern: F.struct(lang.alias("lang"), F.lit(pattern).alias("pattern"))
    whole, last, first = language_of(name), language_of(F.element_at(parts, -1)), language_of(F.element_at(parts, 1))
    two = language_of(F.concat_ws("-", F.get(parts, n - 2), F.get(parts, n - 1)))
    named = F.lower(name).isin(*(x.lower() for x in ENGLISH_NAMES.values()))
    return (
        F.when((whole != "") & named, of(whole, "name_exact"))
        .when(whole != "", of(whole, "code_exact"))
        .when((n >= 2) & (last != ""), of(last, "suffix"))
        .when((n >= 3) & (two != ""), of(two, "suffix_composite"))
        .when((n >= 2) & (first != ""), of(first, "prefix"))
    )


def is_translatable_file(path, src_lang: str) -> Column:
    """In a folder with a file for each language only that of the source language; files without a language too."""
    lang = from_filename(path)["lang"]
    src = SPELLINGS.get(_plain(src_lang), "")
    return F.lit(True) if not src else lang.isNull() | (lang == src)


def _plain(text: str) -> str:
    low = unicodedata.normalize("NFD", text.strip().lower())
    return "".join(c for c in low if unicodedata.category(c) != "Mn" and c not in "-_ ")


def target_filename(path, tgt_lang: str) -> Column:
    """The file name of the translation: the language in it replaced, in its style; appended where there is none."""
    p = F.col(path) if isinstance(path, str) else path
    folder, name = F.regexp_replace(p, r"[^/]*\z", ""), stem(p)
    ext = F.regexp_extract(F.substring_index(p, "/", -1), r"(\.[^.]*)\z", 1)
    target = SPELLINGS.get(_plain(tgt_lang), tgt_lang.lower())
    english = ENGLISH_NAMES.get(target, target[:1].upper() + target[1:].lower())
    pattern = from_filename(p)["pattern"]
    upper = (name == F.upper(name)) & (name != F.lower(name))
    lower = (name == F.lower(name)) & (name != F.upper(name))
    new = (
        F.when(pattern == "name_exact", F.when(lower, english.lower()).when(upper, english.upper()).otherwise(english))
        .when(pattern == "code_exact", F.when(upper, target.upper()).otherwise(target))
        .when(pattern == "suffix", F.concat(F.regexp_replace(name, r"[^-_]*\z", ""), F.lit(target)))
        .when(pattern == "suffix_composite", F.concat(F.regexp_replace(name, r"[^-_]*[-_][^-_]*\z", ""), F.lit(target)))
        .when(pattern == "prefix", F.concat(F.lit(target), F.regexp_replace(name, r"\A[^-_]*", "")))
        .otherwise(F.concat(name, F.lit(f"_{tgt_lang}")))
    )
    return F.concat(folder, new, ext)


# The regions that one service wants with its languages.
REGIONAL = {"ja": "ja-JP", "pt": "pt-BR", "en": "en-GB", "es": "es-ES", "fr": "fr-FR", "de": "de-DE", "it": "it-IT", "ko": "ko-KR", "zh-cn": "zh-CN", "zh": "zh-CN"}


def regional_code(lang: str) -> str:
    """A language with its region, where one is known; else as it is."""
    return REGIONAL.get(lang.lower(), lang)


def provider_code(lang: str, source: bool = False) -> str:
    """A language as the REST provider spells it."""
    code = lang.strip().upper().replace("_", "-")
    if source:
        return "" if code in ("", "AUTO") else code.split("-")[0]
    return {"EN": "EN-US", "PT": "PT-BR"}.get(code, code)
