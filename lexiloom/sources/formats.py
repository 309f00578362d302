"""File formats as sources of segments and sinks of translations.

A format reads a file's bytes into slots (id, text, kind) and writes them with some slots' texts
replaced; everything else in the file stays, byte for byte. Files are read by Spark's binaryFile
source, one row a file: parsing runs in Arrow batches on the executors, and a translation meets its
file in a join on the path.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gametext, langcodes
from ..functions.gametext import Span
from ..functions.masking import BINARY_PATTERNS, CSV_PATTERNS, JSON_PATTERNS
from ..functions.predicates import ASSET_ENDINGS, MENU_KEYS, TEXT_KEYS
from ..functions.text import glob_of
from . import documents

KINDS = ("dialogue", "choice", "script", "menu", "db")


@dataclass(frozen=True)
class Slot:
    """A text of a file: the id within it, the text, its kind."""

    id: str
    text: str
    kind: str


@dataclass(frozen=True)
class Format:
    """How files of one kind are read and written. Options are plain values; the file of the same name with the extension
    sidecar, if there is one, is among them as project. rewrites: whether a file changes under the options even without a target."""

    name: str
    extensions: tuple[str, ...]
    handles: str  # pattern of file names
    read: Callable[[str, bytes, dict], list[Slot]]
    write: Callable[[str, bytes, dict[str, str], dict], bytes]
    patterns: tuple = field(default=(), compare=False)
    sidecar: str = ""
    rewrites: Callable[[str, dict], bool] = lambda name, options: False


# --- tables -------------------------------------------------------------------------------------

# Headers of text columns and of identifiers.
TEXT_HEADERS = ("text", "value", "translation", "content", "message", "msg", "dialogue", "string", "desc", "description", "target")
ID_HEADERS = ("id", "key", "code", "name", "identifier", "tag", "label", "index")


def sniffed(text: str) -> str:
    head = "\n".join(text.split("\n")[:5])
    return max(",;\t|", key=lambda d: (head.count(d), -",;\t|".index(d)))


def _language(header: str) -> str:
    return langcodes.SPELLINGS.get(langcodes._plain(header), "")


def planned_columns(header: list[str], src: str, tgt: str, chosen: Iterable[str] = ()) -> tuple[list[int], int, str]:
    """Source columns, the filled target column or -1, and the header that gets translations ("": the source column itself).

    A table with a column for each language comes first, then chosen columns, then common names of text
    columns, then the column of two that isn't an identifier.
    """
    source, target = _language(src), _language(tgt) or tgt.lower()
    languages = [_language(h) for h in header]
    if source and source in languages:
        at, to = languages.index(source), languages.index(target) if target in languages else -1
        name = header[at]
        styled = target if name.islower() else target.upper() if name.isupper() else langcodes.ENGLISH_NAMES.get(target, target.capitalize())
        return [at], to, header[to] if to >= 0 else styled
    clean = [h.strip().lower() for h in header]
    for names in ([c.strip().lower() for c in chosen], TEXT_HEADERS):
        if found := [k for k, h in enumerate(clean) if h in names]:
            return found, -1, ""
    if len(header) == 2:
        return [0 if clean[1] in ID_HEADERS and clean[0] not in ID_HEADERS else 1], -1, ""
    return [], -1, ""


def _table(data: bytes, options: dict) -> tuple[str, str, str, list[list[str]]]:
    mark, text = documents.text_of(data)
    if not text.strip():
        raise ValueError("an empty table")
    delimiter = options.get("delimiter") or sniffed(text)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    return mark, "\r\n" if "\r\n" in text else "\n", delimiter, rows


def _read_csv(name: str, data: bytes, options: dict) -> list[Slot]:
    _, _, _, rows = _table(data, options)
    sources, target, _ = planned_columns(rows[0], options.get("src", ""), options.get("tgt", ""), options.get("columns", ()))
    out = []
    for r, row in enumerate(rows[1:], 1):
        if 0 <= target < len(row) and row[target].strip():
            continue
        for c in sources:
            cell = row[c] if c < len(row) else ""
            if cell.strip() and not cell.startswith("■") and not re.fullmatch(r"[0-9.,+\-]*", cell.strip()):
                out.append(Slot(f"row:{r}/col:{c}", cell, "db"))
    return out


def _write_csv(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    mark, line, delimiter, rows = _table(data, options)
    _, _, header = planned_columns(rows[0], options.get("src", ""), options.get("tgt", ""), options.get("columns", ()))
    width = len(rows[0])
    if header and header not in rows[0]:
        rows = [[*row, *[""] * (width - len(row)), header if k == 0 else ""] for k, row in enumerate(rows)]
    for id_, target in targets.items():
        r, c = map(int, re.fullmatch(r"row:(\d+)/col:(\d+)", id_).groups())
        c = rows[0].index(header) if header else c
        rows[r].extend([""] * (c + 1 - len(rows[r])))
        rows[r][c] = target
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=delimiter, lineterminator=line).writerows(rows)
    return documents.bytes_of(mark + out.getvalue())


# --- plain JSON -----------------------------------------------------------------------------------

_ESCAPES = re.compile(r"\\[A-Za-z]{1,4}\[[^\]]*\]|\\[nrtfvbae0\\]")
_ASSET = re.compile(r"(?:audio|img|image|images|pictures|graphic|graphics|sound|bgm|bgs|se|me|data|movies|system|fonts)[/\\]", re.I)
_OPTIONS = re.compile(r"[^\W\d_]+(?:\s*/\s*[^\W\d_]+)+\Z")


def _is_path(text: str) -> bool:
    slashes = text.count("/") + text.count("\\")
    if not slashes or _ASSET.match(text):
        return bool(slashes)
    return " " not in text and not re.search("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", text) and (slashes >= 2 or not _OPTIONS.match(text))


def is_leaf_text(key: str, text: str, keys=TEXT_KEYS) -> bool:
    """The row form of predicates.is_leaf_text."""
    s = text.strip()
    clean = _ESCAPES.sub("", s).strip()
    if not clean or (keys is not None and key.lower() not in keys):
        return False
    script = re.match(r"\$[A-Za-z_]|https?://", s)
    return not (_is_path(s) or _is_path(clean) or clean.lower().endswith(ASSET_ENDINGS) or script or re.fullmatch(r"[0-9.,+\-]*", s))


def _read_json(name: str, data: bytes, options: dict) -> list[Slot]:
    keys = options.get("keys", TEXT_KEYS)
    found = documents.leaves(documents.text_of(data)[1])
    return [Slot(x.pointer, x.value, "menu" if x.key.lower() in MENU_KEYS else "dialogue") for x in found if isinstance(x.value, str) and is_leaf_text(x.key, x.value, keys)]


def _write_json(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    mark, text = documents.text_of(data)
    return documents.bytes_of(mark + documents.edited(text, targets))


# --- scripts of lines ----------------------------------------------------------------------------


def _lines(data: bytes) -> tuple[str, list[str]]:
    """The encoding, and the lines with their ends."""
    try:
        text, encoding = data.decode("cp932"), "cp932"
    except UnicodeDecodeError:
        text, encoding = data.decode("utf-8", "replace"), "utf-8"
    return encoding, re.findall(r"[^\n]*\n|[^\n]+", text)


def script_line(original: str, target: str, default_end: str) -> str:
    """A translated line: one line, in the original's indent, end and label colon."""
    new = " ".join(target.split())
    if new == original.strip():
        return original
    end = "\r\n" if original.endswith("\r\n") else "\n" if original.endswith("\n") else default_end
    if original.rstrip("\r\n \t").endswith("："):
        new = new.removesuffix(":").removesuffix("：") + "："
    return original[: len(original) - len(original.lstrip(" \t"))] + new + end


def _read_lines(name: str, data: bytes, options: dict) -> list[Slot]:
    return [Slot(f"line:{k}", line.strip(), "dialogue") for k, line in enumerate(_lines(data)[1]) if line.strip() and not line.strip().startswith("/")]


def _write_lines(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    encoding, lines = _lines(data)
    end = "\r\n" if any(line.endswith("\r\n") for line in lines) else "\n"
    out = [script_line(line, targets[f"line:{k}"], end) if f"line:{k}" in targets else line for k, line in enumerate(lines)]
    return "".join(out).encode(encoding, "replace")


# --- game documents: leaves chosen by rules on their pointers --------------------------------------

# For each opcode, the parameters that are text: pattern of the pointer below parameters, id, kind, splitter.
_OPCODES = {
    (401, 405): [(r"0", "", "dialogue", gametext.message_spans)],
    (101,): [(r"4", "/speaker", "dialogue", gametext.message_spans), (r"([1-9]\d*)", "/param:{0}", "dialogue", gametext.message_spans)],
    (320, 324, 325): [(r"1", "", "dialogue", gametext.message_spans)],
    (102,): [(r"0/(\d+)", "/choice:{0}", "choice", gametext.choice_spans)],
    (402,): [(r"1", "", "choice", gametext.choice_spans)],
    (355, 655): [(r"0", "", "script", gametext.script_spans)],
    (356,): [(r"0", "", "script", gametext.plugin_command_spans)],
    (357,): [(r"3/([^/]+)", "/{0}", "script", None)],
    (122,): [(r"4", "", "script", gametext.variable_spans)],
    (205,): [(r"1/list/(\d+)/parameters/0", "/step:{0}", "script", gametext.script_spans)],
    (505,): [(r"0/parameters/0", "", "script", gametext.script_spans)],
}
OPCODES = {code: [(re.compile(p + r"\Z"), *rest) for p, *rest in rules] for codes, rules in _OPCODES.items() for code in codes}
# For each kind of file, where its commands are, and which other leaves are text: pattern, id, kind.
_K = r"([^/]+)"
COMMANDS = {
    "map": (rf"/events/{_K}/pages/(\d+)/list/(\d+)", "event:{0}/page:{1}/cmd:{2}"),
    "common": (rf"/{_K}/list/(\d+)", "commonevent:{0}/cmd:{1}"),
    "troops": (rf"/{_K}/pages/(\d+)/list/(\d+)", "troop:{0}/page:{1}/cmd:{2}"),
}
LEAVES = {
    "map": [(r"/displayName", "map:displayName", "menu")],
    "actors": [(rf"/{_K}/(name|nickname|note)", "item:{0}/field:{1}", "db"), (rf"/{_K}/(profile)", "item:{0}/field:{1}", "dialogue")],
    "records": [(rf"/{_K}/(name|description|note)", "item:{0}/field:{1}", "db"), (rf"/{_K}/(message[1-4])", "item:{0}/field:{1}", "dialogue")],
    "infos": [(rf"/{_K}/(name)", "item:{0}/field:{1}", "db")],
    "system": [
        (r"/(gameTitle|currencyUnit)", "{0}", "menu"), (r"/(elements|skillTypes|weaponTypes|armorTypes|equipTypes)/(\d+)", "{0}/{1}", "menu"),
        (r"/terms/(basic|commands|params)/(\d+)", "terms/{0}/{1}", "menu"), (rf"/terms/messages/{_K}", "terms/messages/{0}", "menu"),
    ],
}
FILES = (
    (r"map\d+\.json", "map"), (r"commonevents\.json", "common"), (r"troops\.json", "troops"), (r"actors\.json", "actors"),
    (r"(?:classes|skills|items|weapons|armors|enemies|states)\.json", "records"), (r"mapinfos\.json", "infos"), (r"system\.json", "system"), (r"plugins\.js", "plugins"),
)


def file_kind(name: str) -> str | None:
    return next((kind for pattern, kind in FILES if re.fullmatch(pattern, name, re.I)), None)


def _pieces(kind: str, text: str):
    """(id, pointer, span, kind of text) of all texts of a game document."""
    found = list(documents.leaves(text))
    value = {x.pointer: x.value for x in found}
    rules = [(re.compile(p + r"\Z"), id_, k) for p, id_, k in LEAVES.get(kind, ())]
    place, command_id = COMMANDS.get(kind, (None, ""))
    place = place and re.compile(place + r"/parameters/(.+)\Z")
    for x in found:
        if not isinstance(x.value, str):
            continue
        m = place and place.match(x.pointer)
        if m:
            *at, rest = m.groups()
            below = x.pointer[: -len(rest) - 1]
            for rule, suffix, text_kind, split in OPCODES.get(value.get(below.removesuffix("/parameters") + "/code"), ()):
                if not (r := rule.match(rest)):
                    continue
                groups = [documents.unescaped(g) for g in r.groups()]
                code = value.get(below.removesuffix("/parameters") + "/code")
                step = f"{below}/1/list/{groups[0]}/code" if code == 205 else f"{below}/0/code"
                if (code == 122 and value.get(f"{below}/3") != 4) or (code in (205, 505) and value.get(step) != 45):
                    break
                spans = split(x.value) if split else [Span(0, len(x.value), x.value)] * gametext.is_argument_text(groups[0], x.value)
                spans = list(spans)
                base = command_id.format(*map(documents.unescaped, at)) + suffix.format(*groups)
                for n, s in enumerate(spans):
                    yield (f"{base}/{n}" if len(spans) > 1 else base), x.pointer, s, text_kind
                break
            continue
        for rule, id_, text_kind in rules:
            if not (r := rule.match(x.pointer)):
                continue
            groups = [documents.unescaped(g) for g in r.groups()]
            record = kind in ("actors", "records", "infos")
            if record and not value.get(f"/{r[1]}/name"):
                break
            if record and groups[1] == "note":
                spans = gametext.note_spans(x.value)
            else:
                spans = [] if gametext.is_code(x.value) else [Span(0, len(x.value), x.value)]
            for n, s in enumerate(spans):
                yield (f"{id_.format(*groups)}/{n}" if len(spans) > 1 else id_.format(*groups)), x.pointer, s, text_kind
            break


def _read_game(name: str, data: bytes, options: dict) -> list[Slot]:
    kind = file_kind(name)
    if kind == "plugins":
        return [Slot(id_, text, "menu") for id_, _, text in _plugin_texts(data)]
    return [Slot(id_, s.source, k) for id_, _, s, k in _pieces(kind, documents.text_of(data)[1]) if gametext.has_text(s.source)]


def _write_game(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    if file_kind(name) == "plugins":
        return _write_plugins(data, targets)
    mark, text = documents.text_of(data)
    edits: dict[str, list[tuple[Span, str]]] = {}
    for id_, pointer, span, _ in _pieces(file_kind(name), text):
        if id_ in targets and targets[id_] != span.source:
            edits.setdefault(pointer, []).append((span, targets[id_]))
    value = {x.pointer: x.value for x in documents.leaves(text)}
    new = {}
    for pointer, parts in edits.items():
        v = value[pointer]
        for span, target in sorted(parts, key=lambda p: -p[0].start):
            v = v[: span.start] + span.encoded(target) + v[span.end :]
        new[pointer] = v
    return documents.bytes_of(mark + documents.edited(text, new))


# --- scripts of plugin settings: JSON within JSON strings --------------------------------------------

# Settings that are never text.
IGNORED_SETTINGS = frozenset({
    "script", "filterscript", "datascript", "mappingscript", "itemdrawscript", "isenablescript", "decisionscript", "filename", "image", "imagename", "bgm", "se",
    "variableid", "switchid", "defaultvalue", "hiddenflag", "addposition", "paddingtop",
})


def is_setting_text(key: str, text: str) -> bool:
    if not text.strip() or key.lower() in IGNORED_SETTINGS or gametext.is_code(text, parameter=True):
        return False
    if gametext.CJK.search(text):
        return True
    return not set(text) & set("{};()$=<>") and (" " in text or (len(text) > 2 and text[0].isupper() and text.isalpha()))


def _array(text: str) -> tuple[int, int]:
    start, end = text.find("["), text.rfind("]") + 1
    if start < 0 or end <= start or "plugins" not in text[:start].lower():
        raise ValueError("no array of plugins")
    return start, end


def _nested(text: str):
    t = text.strip()
    if t[:1] + t[-1:] not in ("{}", "[]"):
        return None
    try:
        return t if isinstance(json.loads(t), (dict, list)) else None
    except ValueError:
        return None


def _setting_texts(doc: str, path: str, key: str, chain: tuple[str, ...]):
    """(path, pointers, text) of the texts in a document of settings, those in nested documents too."""
    for x in documents.leaves(doc):
        names = [documents.unescaped(t) for t in x.pointer.split("/")[1:]]
        own = next((n for n in reversed(names) if not n.isdigit()), key)
        if not isinstance(x.value, str) or any(n.lower() in IGNORED_SETTINGS for n in names):
            continue
        where = "/".join([path, *names]) if path else "/".join(names)
        if inner := _nested(x.value):
            yield from _setting_texts(inner, where, own, (*chain, x.pointer))
        elif is_setting_text(own, x.value):
            yield where, (*chain, x.pointer), x.value


def _plugin_texts(data: bytes):
    text = documents.text_of(data)[1]
    start, end = _array(text)
    for index, plugin in enumerate(json.loads(text[start:end])):
        if not isinstance(plugin, dict) or plugin.get("status") is not True or not isinstance(plugin.get("parameters"), dict):
            continue
        name = plugin.get("name") if isinstance(plugin.get("name"), str) and plugin.get("name") else str(index)
        root = f"/{index}/parameters"
        found = [(w, (root + c[0], *c[1:]), t) for w, c, t in _setting_texts(json.dumps(plugin["parameters"], ensure_ascii=False), "", "", ())]
        for where, chain, value in sorted(found, key=lambda f: [(int(p), "") if p.isdigit() else (-1, p) for p in f[0].split("/")]):
            yield f"plugin:{index}:{name}/param:{where}", chain, value


def _chained(doc: str, edits: list[tuple[tuple[str, ...], str]]) -> str:
    """The document with texts replaced; those in nested documents first, in the document within."""
    direct = {c[0]: t for c, t in edits if len(c) == 1}
    nested: dict[str, list] = {}
    for c, t in edits:
        if len(c) > 1:
            nested.setdefault(c[0], []).append((c[1:], t))
    value = {x.pointer: x.value for x in documents.leaves(doc)} if nested else {}
    return documents.edited(doc, direct | {p: _chained(value[p], inner) for p, inner in nested.items() if p in value})


def _write_plugins(data: bytes, targets: dict[str, str]) -> bytes:
    mark, text = documents.text_of(data)
    start, end = _array(text)
    edits = [(chain, targets[id_]) for id_, chain, value in _plugin_texts(data) if targets.get(id_, value) != value]
    return documents.bytes_of(mark + text[:start] + _chained(text[start:end], edits) + text[end:]) if edits else data


# --- the registry, and Spark ------------------------------------------------------------------------

FORMATS = {
    "csv": Format("csv", (".csv",), r"(?i).*\.csv", _read_csv, _write_csv, CSV_PATTERNS),
    "json": Format("json", (".json",), r"(?i).*\.json", _read_json, _write_json, JSON_PATTERNS),
    "lines": Format("lines", (".txt",), r"(?i).*\.txt", _read_lines, _write_lines, BINARY_PATTERNS),
    "game": Format("game", (".json", ".js"), "(?i)(?:" + "|".join(p for p, _ in FILES) + ")", _read_game, _write_game, gametext.GAME_PATTERNS),
}


def files(spark: SparkSession, root: str, kind: Format) -> DataFrame:
    """Rows (path, name, content) of a tree's files that a format handles, outside of hidden folders; project, if the format
    has sidecars, is the content of the file's. Files with other extensions aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob_of(kind.extensions)).load(root)
    name = F.substring_index("path", "/", -1)
    hidden = F.rlike(F.substr("path", F.lit(len(root) + 1)), F.lit(r"/\.[^/]+/"))
    rows = found.where(~hidden & F.rlike(name, F.lit(rf"\A(?:{kind.handles})\z"))).select("path", name.alias("name"), "content")
    if not kind.sidecar:
        return rows
    beside = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{kind.sidecar}").load(root)
    stem = F.regexp_replace("path", r"\.[^./]*\z", "")
    return rows.withColumn("_stem", stem).join(beside.select(stem.alias("_stem"), F.col("content").alias("project")), "_stem", "left").drop("_stem")


def _with_options(batch: pa.RecordBatch, options: dict) -> Iterator[dict]:
    """The options of each file of a batch."""
    if "project" not in batch.schema.names:
        yield from itertools.repeat(options, batch.num_rows)
        return
    for project in batch.column("project").to_pylist():
        yield options | {"project": project} if project else options


_SLOTS = "path string, id string, ord bigint, source string, kind string, error string"


def extracted(found: DataFrame, kind: Format, options: dict | None = None) -> DataFrame:
    """Segments (path, id, ord, source, kind, error) of files; ids are <name>#<id in the file>. A file that can't be read is one row with its error."""
    options = options or {}
    read = kind.read

    def run(batches):
        for batch in batches:
            rows = []
            for path, name, content, own in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content")), _with_options(batch, options)):
                try:
                    rows += [(path, f"{name}#{s.id}", k, s.text, s.kind, None) for k, s in enumerate(s for s in read(name, content, own) if s.text)]
                except (ValueError, csv.Error, RecursionError, IndexError, KeyError) as error:
                    rows.append((path, None, None, None, None, str(error)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "id", "ord", "source", "kind", "error"])

    return found.mapInArrow(run, _SLOTS)


def injected(found: DataFrame, segments: DataFrame, kind: Format, options: dict | None = None) -> DataFrame:
    """Files (path, content) with the targets of segments (path, id, target) put in; a file without one stays as it is, unless the options change it."""
    options = options or {}
    write, rewrites = kind.write, kind.rewrites
    targets = segments.where("target is not null and target <> ''").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "target"))).alias("targets"))
    joined = found.join(targets, "path", "left")

    def run(batches):
        for batch in batches:
            out = []
            for name, content, pairs, given in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "targets")), _with_options(batch, options)):
                prefix = f"{name}#"
                own = {k.removeprefix(prefix): v for k, v in pairs or () if k.startswith(prefix)}
                out.append(write(name, content, own, given) if own or rewrites(name, given) else content)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return joined.mapInArrow(run, "path string, content binary")
