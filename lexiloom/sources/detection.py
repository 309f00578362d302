"""Which format a folder holds, which language its texts have, and which folders are left alone."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of formats that callers may ask for, folders that are never touched.
FORMAT_NAMES = {
    "csv": "csv", "json": "json", "generic": "json", "game": "game", "rpgmaker_mv": "game", "rpgmaker_mz": "game", "mv": "game", "mz": "game",
    "ruby": "ruby", "rpgmaker_vxace": "ruby", "rpgmaker_vx": "ruby", "rpgmaker_xp": "ruby", "vxace": "ruby", "xp": "ruby", "lines": "lines", "evtext": "lines", "binary": "binary", "mps": "binary",
}
TRASH = ("/.trash/", "/.trash-", "/.local/share/trash/", "/trash/", "/$recycle.bin/")


@dataclass(frozen=True)
class Detected:
    """What was found: the format, the folder of data, the language guessed, the share of certainty in percent, the number of files."""

    path: str
    name: str
    data: str
    format: str
    language: str
    confidence: int
    files: int


def game_name(path: str) -> str:
    """The name of a game's folder, without the folders of data within it."""
    parts = [p for p in os.path.normpath(path).split(os.sep) if p]
    while len(parts) > 1 and parts[-1].lower() in ("data", "www"):
        parts.pop()
    return os.path.splitext(parts[-1])[0] if parts and os.path.isfile(path) else (parts[-1] if parts else "")


def is_restricted(path: str) -> bool:
    """The root of a file system, and trash."""
    low = os.path.abspath(path).replace("\\", "/").lower() + "/"
    return path in ("/", "\\") or bool(re.fullmatch(r"[A-Za-z]:\\", path)) or any(t in low for t in TRASH)


def _count(folder: str, ending: str) -> int:
    try:
        return sum(e.is_file() and e.name.lower().endswith(ending) for e in os.scandir(folder))
    except OSError:
        return 0


def _guess(folder: str, ending: str) -> tuple[str, int]:
    """Japanese from five letters of its script on, in the first 5000 bytes of each file; a sample in Latin ends the search."""
    cjk = latin = 0
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        if e.is_file() and e.name.lower().endswith(ending):
            with open(e.path, "rb") as file:
                text = file.read(5000).decode("utf-8", "ignore")
            cjk += len(re.findall("[぀-ヿ㐀-䶿一-鿿]", text))
            latin += len(re.findall("[A-Za-z]", text))
            if cjk >= 5 or latin > 50:
                break
    return ("ja", 96) if cjk >= 5 else ("en", 80)


def detected(path: str) -> Detected:
    """The format of a file by its ending, of a folder by its marker files; unknown if there is none."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if is_restricted(path):
        raise PermissionError(f"{path} is left alone")
    name = game_name(path)
    if os.path.isfile(path):
        found = {".csv": ("csv", "en"), ".json": ("json", "en"), ".mps": ("binary", "ja"), ".rvdata2": ("ruby", "ja")}.get(os.path.splitext(path)[1].lower(), ("unknown", ""))
        return Detected(path, name, os.path.dirname(path), *found, 0, int(found[0] != "unknown"))
    at = lambda *p: os.path.join(path, *p)
    for folder in (at("www", "data"), at("data"), path):
        if os.path.exists(os.path.join(folder, "System.json")):
            return Detected(path, name, folder, "game", *_guess(folder, ".json"), _count(folder, ".json"))
    for folder in (at("Data", "MapData"), at("Data", "BasicData"), at("Data"), path):
        marks = any(os.path.exists(os.path.join(folder, m)) for m in ("CommonEvent.dat", "DataBase.dat"))
        if marks or _count(folder, ".mps") or _count(folder, ".wolf"):
            return Detected(path, name, folder, "binary", "ja", 95, sum(_count(folder, e) for e in (".mps", ".dat", ".wolf")))
    for folder in (at("Data"), path):
        for ending in (".rvdata2", ".rxdata"):
            if n := _count(folder, ending):
                return Detected(path, name, folder, "ruby", "ja", 95, n)
    for ending, kind in ((".csv", "csv"), (".json", "json")):
        if n := _count(path, ending):
            return Detected(path, name, path, kind, "en", 0, n)
    return Detected(path, name, path, "unknown", "", 0, 0)


def language_counts(texts: DataFrame, by: str, text: str) -> DataFrame:
    """Rows (by, latin, cjk, guess): letters of all texts; five of Japanese script make a folder Japanese, else English.

    Every text counts, where a sequential scan may stop at the fifth letter: the guess is the same.
    """
    count = lambda cls: F.sum(F.length(F.regexp_replace(text, f"[^{cls}]", "")).cast("long"))
    sums = texts.groupBy(by).agg(count("a-zA-Z").alias("latin"), count(r"\x{3040}-\x{30ff}\x{4e00}-\x{9fff}").alias("cjk"))
    return sums.withColumn("guess", F.when(F.col("cjk") >= 5, "ja").otherwise("en"))
