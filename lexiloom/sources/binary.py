"""Binary game files (maps, common events, databases, headers) as text slots, and edits in place.

A cursor walks a file once and notes where each string lies: its length, bytes and terminator. A
translation replaces that stretch and nothing else. Compressed maps are unpacked first and written as a
block of literals; old encrypted databases are written in the clear.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import BINARY_PATTERNS
from .formats import FORMATS, Format, Slot, _read_lines, _write_lines

# Beginnings of files and blocks, the marks of protected ones, limits of field codes, command codes.
MAP = bytes(10) + b"WOLFM\0"
COMMON, COMMON_UTF8 = b"\0W\0\0OL\0FC\0", b"\0W\0\0OLUFC\0"
DATABASE, DATABASE_NEXT = b"W\0\0OL", b"FM\0"
HEADER = b"W\0\0OL\0FM"
UTF8_CODE, STRINGS_FROM, NUMBERS_FROM, LONGEST = 85, 0x07D0, 0x03E8, 1_000_000
MESSAGE, CHOICES, SET_STRING, PICTURE, CALL, DATABASE_COMMAND, CALL_BY_NAME = 101, 102, 122, 150, 210, 250, 300
DATABASE_FILES = ("database.dat", "cdatabase.dat", "sysdatabase.dat")
IGNORED_TEXTS = ("readme.txt", "license.txt", "patch-config.txt", "patch-config.example.txt", "game_errorlog.txt")
# Endings of media, folders of resources.
MEDIA = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".ogg", ".wav", ".mp3", ".mid", ".midi", ".flac", ".aac", ".txt", ".csv", ".dat", ".mps", ".wolf", ".project")
FOLDERS = ("data", "system", "graphic", "picture", "sound", "bgm", "bgs", "se", "mapdata", "basicdata", "chara", "chipset")
# Letters and marks that the old fonts lack, and what stands for them.
PLAIN = {
    "áàãâä": "a", "ÁÀÃÂÄ": "A", "éèêë": "e", "ÉÈÊË": "E", "íìîï": "i", "ÍÌÎÏ": "I", "óòõôö": "o", "ÓÒÕÔÖ": "O", "úùûü": "u", "ÚÙÛÜ": "U",
    "ç": "c", "Ç": "C", "ñ": "n", "Ñ": "N", "…": "...", "–—": "-", "“”«»": '"', "‘’": "'", "º": "o", "ª": "a",
}
_PLAIN = {ord(c): to for letters, to in PLAIN.items() for c in letters}
_MISREAD = set("ﾃ窶縲ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿ")


def western(text: str) -> str:
    """Without accents and typographic marks; text that was UTF-8 read in the other encoding is read again first."""
    if _MISREAD & set(text):
        try:
            text = text.encode("cp932").decode("utf-8")
        except UnicodeError:
            pass
    return text.translate(_PLAIN)


_CODE = re.compile(r"\\[A-Za-z]+(?:\[[^\]]*\])?|\\[^A-Za-z]")
_INNER = r"(?:(?:\\[A-Za-z]+\[[^\]]*\])|[^,\]])+"
_RUBY = re.compile(rf"\\r\s*\[\s*({_INNER})\s*,\s*(?:(?:\\[A-Za-z]+\[[^\]]*\])|[^\]])+\s*\]", re.I | re.A)


def without_readings(text: str) -> str:
    r"""\r[base,reading] as base."""
    return _RUBY.sub(r"\1", text)


def is_text(text: str) -> bool:
    """Whether a string is visible: it has letters, and isn't a path, command, formula or identifier."""
    bare, low = text.strip(), text.strip().lower()
    if not any(c.isalpha() for c in _CODE.sub("", text)) or any(line.strip().lower().endswith(MEDIA) for line in text.split("\n")):
        return False
    if (bare.startswith("<<") and ">>" in bare) or low in ("true", "false", "null", "nil", "none") or low.startswith(tuple(f + s for f in FOLDERS for s in "/\\")):
        return False
    if re.fullmatch(r"[^\W\d_]+(?:\s*/\s*[^\W\d_]+)+", bare):
        return True
    short = len(bare.encode()) <= 24 and " " not in bare and not re.search("[぀-ヿ㐀-䶿一-鿿]", bare)
    named = re.fullmatch(r"[A-Za-z0-9]*_[A-Za-z0-9_]*|[A-Za-z0-9_\-.]*[/\\]+[A-Za-z0-9_\-./\\]*", bare)
    mixed = re.fullmatch(r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]+", bare)
    return not (short and (named or mixed))


@dataclass
class Stretch:
    """A string of a file: its text, and the bytes from its length to its terminator."""

    text: str
    start: int
    end: int


class Cursor:
    """A place in a file."""

    def __init__(self, data: bytes, utf8: bool = False):
        self.data, self.at, self.utf8 = data, 0, utf8

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def numbers(self, n: int) -> list[int]:
        return list(struct.unpack(f"<{n}I", self.take(4 * n)))

    def need(self, *expected: bytes) -> bytes:
        for e in expected:
            if self.data.startswith(e, self.at):
                return self.take(len(e))
        raise ValueError(f"{expected[0]!r} isn't at {self.at}")

    def text(self) -> Stretch:
        start = self.at
        size = self.number()
        if size > LONGEST:
            raise ValueError("a string is too long")
        raw = self.take(size)
        if raw and raw[-1]:
            raise ValueError("a string doesn't end")
        return Stretch(decoded(raw[:-1], self.utf8), start, self.at)

    def texts(self, n: int | None = None) -> list[Stretch]:
        return [self.text() for _ in range(self.number() if n is None else n)]


def decoded(raw: bytes, utf8: bool) -> str:
    for encoding in (("utf-8", "cp932") if utf8 else ("cp932",)):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def encoded(text: str, utf8: bool) -> bytes:
    raw = text.encode("utf-8") if utf8 else western(text).encode("cp932", "replace")
    return struct.pack("<I", len(raw) + 1) + raw + b"\0"


@dataclass
class Command:
    """An event command: its code, numbers and strings."""

    code: int
    numbers: list[int]
    texts: list[Stretch]

    def visible(self) -> list[int]:
        """The places of the strings that players see."""
        n = len(self.texts)
        if self.code in (MESSAGE, SET_STRING) or (self.code == PICTURE and self.numbers and self.numbers[0] >> 4 & 7 == 2):
            return [0][:n]
        return list(range(n)) if self.code in (CHOICES, CALL) else list(range(1, n)) if self.code == CALL_BY_NAME else []

    def kind(self) -> str:
        return {CHOICES: "choice", PICTURE: "menu"}.get(self.code, "dialogue")


def _route(c: Cursor) -> None:
    for _ in range(c.number()):
        c.byte()
        c.numbers(c.byte())
        c.need(b"\x01\0")


def _commands(c: Cursor) -> list[Command]:
    out = []
    for _ in range(c.number()):
        n = max(0, c.byte() - 1)
        code, numbers = c.number(), c.numbers(n)
        c.byte()
        out.append(Command(code, numbers, c.texts(c.byte())))
        end = c.byte()
        if end == 1:
            c.take(6)
            _route(c)
        elif end:
            raise ValueError("a command doesn't end")
    return out


def _page(c: Cursor) -> list[Command]:
    c.number()
    c.text()
    c.take(4 + 37 + 4 + 2)
    _route(c)
    commands = _commands(c)
    more = c.number() > 3
    c.take(3 + more)
    c.need(b"\x7a")
    return commands


def unpacked(block: bytes, size: int) -> bytes:
    """An LZ4 block; a reference to nothing ends it, literals that are missing are an error."""
    out, at = bytearray(), 0

    def length(n: int) -> int:
        nonlocal at
        more = n == 15
        while more and at < len(block):
            n, more, at = n + block[at], block[at] == 255, at + 1
        return n

    while at < len(block):
        token = block[at]
        at += 1
        n = length(token >> 4)
        if at + n > len(block):
            raise ValueError("a packed block ends early")
        out += block[at : at + n]
        at += n
        if at >= len(block):
            break
        if at + 2 > len(block):
            raise ValueError("a packed block ends early")
        back = block[at] | block[at + 1] << 8
        at += 2
        if not 0 < back <= len(out):
            break
        for _ in range(length(token & 15) + 4):
            out.append(out[-back])
    return bytes(out[:size] if size > 0 else out)


def literal_block(data: bytes) -> bytes:
    """An LZ4 block of literals alone."""
    n = len(data)
    if n < 15:
        return bytes([n << 4]) + data
    full, rest = divmod(n - 15, 255)
    return b"\xf0" + b"\xff" * full + bytes([rest]) + data


def _is_packed(data: bytes) -> bool:
    return data.startswith(MAP) and len(data) >= 33 and int.from_bytes(data[20:24], "little") >= 0x65 and 33 + int.from_bytes(data[29:33], "little") <= len(data)


def map_commands(data: bytes):
    """(event, page, commands) of a map that isn't packed, and whether it is UTF-8."""
    c = Cursor(data)
    c.need(MAP)
    kind = c.number()
    c.utf8 = kind == UTF8_CODE
    c.take(5)
    c.text()
    _, width, height, _ = c.numbers(4)
    if kind and c.data[c.at : c.at + 4] == b"\xff" * 4:
        c.take(4)
    else:
        c.take(width * height * 12)
    out = []
    while c.at < len(data) and (mark := c.byte()) != 0x66:
        if mark != 0x6F:
            raise ValueError("a map doesn't end")
        c.need(b"\x39\x30\0\0")
        event = c.number()
        c.text()
        c.take(8)
        pages = c.number()
        c.need(bytes(4))
        n = 0
        while (mark := c.byte()) == 0x79:
            out.append((event, n, _page(c)))
            n += 1
        if mark != 0x70 or n != pages:
            raise ValueError("an event doesn't end")
    return out, c.utf8


def common_commands(data: bytes):
    """(event, commands) of common events, and whether they are UTF-8."""
    if data.startswith(COMMON_UTF8) and data[10:11] == b"\xcc":
        raise ValueError("common events are protected")
    c = Cursor(data, data.startswith(COMMON_UTF8))
    c.need(COMMON, COMMON_UTF8)
    c.byte()
    out, ten = [], b"\x0a\0\0\0"
    for _ in range(c.number()):
        c.need(b"\x8e")
        event = c.number()
        c.take(11)
        c.text()
        out.append((event, _commands(c)))
        c.texts(2)
        c.need(b"\x8f")
        newer = c.need(ten, b"\x0b\0\0\0") != ten
        c.texts(10)
        c.take(5 * newer)
        c.need(ten)
        c.take(10)
        c.need(ten)
        for _ in range(10):
            c.texts()
        c.need(ten)
        for _ in range(10):
            c.numbers(c.number())
        c.take(0x1D)
        c.texts(100)
        c.need(b"\x91")
        c.text()
        if c.need(b"\x91", b"\x92") == b"\x92":
            c.text()
            c.number()
            c.need(b"\x92")
    c.byte()
    return out, c.utf8


def decrypted(data: bytes) -> bytes:
    """An old database in the clear: three passes of a C library's random numbers."""
    if len(data) < 10:
        raise ValueError("not a database")
    out = bytearray(data)
    for seed, step in ((data[0], 1), (data[3], 2), (data[9], 5)):
        for k in range(0, len(out), step):
            seed = (seed * 0x343FD + 0x269EC3) & 0x7FFFFFFF
            out[k] ^= seed >> 16 >> 12 & 0xFF
    return bytes(out)


def schema_names(project: bytes, utf8: bool) -> list[tuple[str, list[str]]]:
    """(type, names of its records) of a schema file beside a database."""
    c, out = Cursor(project, utf8), []
    for _ in range(c.number()):
        name = c.text().text
        fields, records = c.texts(), [r.text for r in c.texts()]
        c.text()
        c.take(c.number())
        c.texts(min(len(fields), c.number()))
        for _ in range(min(len(fields), c.number())):
            c.texts()
        for _ in range(min(len(fields), c.number())):
            c.numbers(c.number())
        c.numbers(min(len(fields), c.number()))
        out.append((name, records))
    return out


def plain_database(data: bytes) -> bytes:
    if data.startswith(b"\0" + DATABASE + b"UFM\0") and data[10:11] in (b"\xc4", b"\xcc"):
        raise ValueError("the database is protected")
    return data if data.startswith((DATABASE, b"\0" + DATABASE)) else decrypted(data)


def database_texts(data: bytes, project: bytes | None = None):
    """(type, record, place, string, type's name, record's name) of a database in the clear, and whether it is UTF-8."""
    c = Cursor(data)
    c.need(DATABASE, b"\0" + DATABASE)
    c.utf8 = c.byte() == UTF8_CODE
    c.need(DATABASE_NEXT)
    c.byte()
    count = c.number()
    names = schema_names(project, c.utf8) if project else []
    out = []
    for t in range(len(names) or count):
        c.need(b"\xfe\xff\xff\xff")
        c.number()
        codes = c.numbers(c.number())
        ints, strings = sum(NUMBERS_FROM <= x < STRINGS_FROM for x in codes), sum(x >= STRINGS_FROM for x in codes)
        type_name, records = names[t] if names else (f"Type_{t}", [])
        for d in range(c.number()):
            c.numbers(ints)
            record = records[d] if d < len(records) else f"Data_{d}"
            out += [(t, d, s, text, type_name, record) for s, text in enumerate(c.texts(strings))]
    c.byte()
    return out, c.utf8


def header_texts(data: bytes):
    """The title, the font, the place of the file's size, and whether it is UTF-8; nothing for old headers."""
    c = Cursor(data)
    c.need(HEADER, b"\0" + HEADER)
    c.utf8 = c.byte() == UTF8_CODE
    c.take(c.number())
    n = c.number()
    title = c.text() if n >= 1 else None
    if n >= 2:
        c.text()
    if n >= 3:
        c.take(c.number())
    font = c.text() if n >= 4 else None
    c.texts(3 * (n >= 7) + (n >= 8) + max(0, n - 8))
    return title, font, c.at, c.utf8


def _slots(name: str, data: bytes, options: dict):
    """(id, string, kind) of a file's texts, the bytes that are edited, and whether they are UTF-8."""
    low = name.lower()
    if low.endswith(".mps"):
        if _is_packed(data):
            size, packed = struct.unpack("<2I", data[25:33])
            data = data[:25] + unpacked(data[33 : 33 + packed], size)
        events, utf8 = map_commands(data)
        places = [(f"ev:{e}/p:{p}/cmd:{k}", c) for e, p, commands in events for k, c in enumerate(commands)]
    elif low == "commonevent.dat":
        events, utf8 = common_commands(data)
        places = [(f"ce:{e}/cmd:{k}", c) for e, commands in events for k, c in enumerate(commands)]
    elif low in DATABASE_FILES:
        data = plain_database(data)
        rows, utf8 = database_texts(data, options.get("project"))
        looked_up = options.get("lookup_types")
        return [(f"type:{t}/datum:{d}/str:{s}", x, "db") for t, d, s, x, kind, record in rows if not (x.text == record and (looked_up is None or kind in looked_up))], data, utf8
    else:
        try:
            title, _, _, utf8 = header_texts(data)
        except ValueError:
            return [], data, False
        return [("game/title", title, "menu")] if title and not options.get("preserve_title") else [], data, utf8
    return [(f"{at}/str:{s}", c.texts[s], c.kind()) for at, c in places for s in c.visible()], data, utf8


def read(name: str, data: bytes, options: dict) -> list[Slot]:
    if name.lower().endswith(".txt"):
        return [] if name.lower() in IGNORED_TEXTS else _read_lines(name, data, options)
    return [Slot(id_, without_readings(x.text), kind) for id_, x, kind in _slots(name, data, options)[0] if is_text(x.text)]


def write(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    if name.lower().endswith(".txt"):
        return _write_lines(name, data, targets, options)
    slots, plain, utf8 = _slots(name, data, options)
    edits = {x.start: (x.end, encoded(targets[id_], utf8)) for id_, x, _ in slots if targets.get(id_, x.text) != x.text}
    header = name.lower() == "game.dat"
    if header and options.get("font"):
        font = header_texts(plain)[1]
        edits |= {font.start: (font.end, encoded(options["font"], utf8))} if font else {}
    if not edits:
        return data
    parts, done = [], 0
    for start, (end, new) in sorted(edits.items()):
        parts += [plain[done:start], new]
        done = end
    out = b"".join(parts) + plain[done:]
    if header and len(out) - (at := header_texts(out)[2]) >= 4:  # what follows the strings begins with the size of the file
        out = out[:at] + struct.pack("<I", len(out)) + out[at + 4 :]
    if name.lower().endswith(".mps") and _is_packed(data):
        block = literal_block(out[25:])
        out = out[:25] + struct.pack("<2I", len(out) - 25, len(block)) + block
    return out


def lookup_types(name: str, data: bytes) -> list[str]:
    """Types whose records a file's events look up by literal names."""
    if name.lower() == "commonevent.dat":
        commands = [c for _, cs in common_commands(data)[0] for c in cs]
    else:
        commands = [c for _, _, cs in map_commands(_slots(name, data, {})[1])[0] for c in cs]
    return sorted({c.texts[1].text for c in commands if c.code == DATABASE_COMMAND and len(c.texts) >= 3 and c.texts[1].text and c.texts[2].text})


def looked_up(found: DataFrame) -> list[str] | None:
    """Types that any event of the files (name, content) looks up by names; None, so that all names are kept, if an
    event file can't be read or there is none. Few: as many as a game's tables."""
    events = found.where(F.lower("name").endswith(".mps") | (F.lower("name") == "commonevent.dat"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(t, True) for t in lookup_types(name, content)] or [(None, True)]
                except ValueError:
                    rows.append((None, False))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["type", "ok"])

    rows = events.select("name", "content").mapInArrow(run, "type string, ok boolean").distinct().collect()
    return sorted(r.type for r in rows if r.type) if rows and all(r.ok for r in rows) else None


FORMATS["binary"] = Format(
    "binary", (".mps", ".dat", ".txt"), r"(?i)(?:.*\.mps|commonevent\.dat|game\.dat|(?:c|sys)?database\.dat|.*\.txt)", read, write, BINARY_PATTERNS,
    ".project", lambda name, options: name.lower() == "game.dat" and bool(options.get("font")),
)
