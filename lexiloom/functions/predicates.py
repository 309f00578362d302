"""Which strings of a document are text that a reader sees: boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Keys whose strings are text by default, keys of menu texts, endings of asset names.
TEXT_KEYS = ("text", "message", "name", "description", "title", "dialogue", "content", "summary", "caption", "label", "desc", "bio", "note", "hint", "help")
MENU_KEYS = ("name", "title", "label", "caption")
ASSET_ENDINGS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg",
    ".ogg", ".mp3", ".wav", ".m4a", ".flac", ".mid",
    ".json", ".js", ".csv", ".dat", ".mps", ".project",
    ".ttf", ".otf", ".woff", ".woff2",
)
# Patterns of codes, scripts, folders, pairs of options.
ESCAPE_CODE = r"\\[A-Za-z]{1,4}\[[^\]]*\]|\\[nrtfvbae0\\]"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
SLASH_PAIR = r"\A\pL+(?:[\t\n\f\r ]*/[\t\n\f\r ]*\pL+)+\z"
ASSET_FOLDER = r"(?i)\A(?:audio|img|image|images|pictures|graphic|graphics|sound|bgm|bgs|se|me|data|movies|system|fonts)[/\\]"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def looks_like_path(text) -> Column:
    """Asset paths, but neither pairs of options (Yes/No) nor prose with a slash."""
    t = F.col(text) if isinstance(text, str) else text
    slashes = _count(t, "/") + _count(t, "\\")
    prose = t.contains(" ") | F.rlike(t, F.lit(CJK))
    return (slashes > 0) & (F.rlike(t, F.lit(ASSET_FOLDER)) | (~prose & ((slashes >= 2) | ~F.rlike(t, F.lit(SLASH_PAIR)))))


def allowed_keys(keys) -> tuple[str, ...] | None:
    """The lower-case keys that an option lists; None for all of them (* or all, or an empty list)."""
    out = []
    for k in keys:
        clean = k.strip().lower()
        if clean in ("*", "all"):
            return None
        out += [clean] if clean else []
    return tuple(out) or None


def is_leaf_text(key, text, keys: tuple[str, ...] | None = TEXT_KEYS) -> Column:
    """Whether a string leaf of a JSON document is text: by its key, and not a path, code, asset, script, URL or number."""
    k, s = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    s = trimmed(s)
    clean = trimmed(F.regexp_replace(s, ESCAPE_CODE, ""))
    low = F.lower(clean)
    asset = F.lit(False)
    for ending in ASSET_ENDINGS:
        asset = asset | low.endswith(ending)
    script = F.rlike(s, F.lit(r"\A\$[A-Za-z_]")) | s.startswith("http://") | s.startswith("https://")
    wanted = F.lit(True) if keys is None else F.lower(k).isin(*keys)
    return F.coalesce((s != "") & wanted & ~looks_like_path(s) & (clean != "") & ~asset & ~looks_like_path(clean) & ~script & ~F.rlike(s, F.lit(r"\A[0-9.,+\-]*\z")), F.lit(False))


def leaf_kind(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.when(F.lower(k).isin(*MENU_KEYS), "menu").otherwise("dialogue")


def is_cell_text(cell) -> Column:
    """Whether a table's cell is text: not blank, no section heading, no number."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.coalesce((trimmed(c) != "") & ~c.startswith("■") & ~F.rlike(trimmed(c), F.lit(r"\A[0-9.,+\-]*\z")), F.lit(False))


def needs_translation(state) -> Column:
    """States of a file that an incremental run takes up again."""
    s = F.col(state) if isinstance(state, str) else state
    return s.isin("original_changed", "new", "partial", "translation_missing")
