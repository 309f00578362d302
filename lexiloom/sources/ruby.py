"""Serialised Ruby graphs (Marshal 4.8) as text slots, and edits in place.

The stream is parsed once into nodes that know where their strings lie. A translation replaces the
bytes of its string and its length; object and symbol tables, links, instance variables and encodings
are what they were, so nothing needs to be written anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import gametext
from ..functions.gametext import Span
from .formats import FORMATS, OPCODES, Format, Slot

# Classes and attributes whose strings are shown to players.
RECORD_CLASSES = frozenset({"RPG::Actor", "RPG::Class", "RPG::Item", "RPG::Weapon", "RPG::Armor", "RPG::Skill", "RPG::State", "RPG::Enemy"})
RECORD_ATTRIBUTES = ("@name", "@nickname", "@description", "@profile", "@message1", "@message2", "@message3", "@message4", "@note")
CLASS_ATTRIBUTES = {
    "RPG::MapInfo": ("@name",),
    "RPG::Map": ("@display_name",),
    "RPG::System": ("@game_title", "@currency_unit", "@elements", "@skill_types", "@weapon_types", "@armor_types"),
}
TERM_CLASSES = frozenset({"RPG::System::Terms", "RPG::System::Words"})
LONG_ATTRIBUTES = frozenset({"@description", "@profile", "@note"})


@dataclass
class Text:
    """A string: its value, and where its length and bytes are."""

    value: str
    start: int
    end: int


@dataclass
class Thing:
    """An object of a class with attributes."""

    name: str
    attributes: dict = field(default_factory=dict)


def number_bytes(n: int) -> bytes:
    """An integer in the stream's variable form."""
    if n == 0:
        return b"\0"
    if -124 < n < 123:
        return bytes([(n + 5 if n > 0 else n - 5) & 0xFF])
    size = next(k for k in range(1, 5) if -(1 << 8 * k) <= n < 1 << 8 * k)
    return bytes([size if n > 0 else 256 - size]) + (n & ((1 << 8 * size) - 1)).to_bytes(size, "little")


class Stream:
    """A reader of the fifteen kinds of values; links and symbols by their tables."""

    def __init__(self, data: bytes):
        if data[:2] != b"\x04\x08":
            raise ValueError("not a Marshal 4.8 stream")
        self.data, self.at = data, 2
        self.objects: list = []
        self.symbols: list[str] = []

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the stream ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        c = int.from_bytes(self.take(1), signed=True)
        if c == 0:
            return 0
        if abs(c) > 4:
            return c - 5 if c > 0 else c + 5
        value = int.from_bytes(self.take(abs(c)), "little")
        return value if c > 0 else value - (1 << 8 * -c)

    def keep(self, value):
        self.objects.append(value)
        return value

    def pairs(self) -> list[tuple]:
        return [(self.value(), self.value()) for _ in range(self.number())]

    def value(self):
        tag = self.take(1)
        if tag in b"0TF":
            return {b"0": None, b"T": True, b"F": False}[tag]
        if tag == b"i":
            return self.number()
        if tag == b":":
            self.symbols.append(self.take(self.number()).decode("utf-8", "surrogateescape"))
            return self.symbols[-1]
        if tag in b";@":
            table, k = (self.symbols if tag == b";" else self.objects), self.number()
            if not 0 <= k < len(table):
                raise ValueError("a link to nothing")
            return table[k]
        if tag == b"f":
            return self.keep(self.take(self.number()))
        if tag == b'"':
            start = self.at
            raw = self.take(self.number())
            return self.keep(Text(raw.decode("utf-8", "surrogateescape"), start, self.at))
        if tag == b"I":
            inner = self.value()
            more = self.pairs()
            if isinstance(inner, Thing):
                inner.attributes.update(more)
            return inner
        if tag == b"[":
            out = self.keep([])
            out.extend(self.value() for _ in range(self.number()))
            return out
        if tag == b"{":
            out = self.keep({})
            for k, v in self.pairs():
                out[k.value if isinstance(k, Text) else k if isinstance(k, (str, int, type(None))) else id(k)] = v
            return out
        if tag == b"o":
            out = Thing(str(self.value()))
            self.keep(out)
            out.attributes.update(self.pairs())
            return out
        if tag == b"u":
            self.value()
            return self.keep(self.take(self.number()))
        raise ValueError(f"an unknown kind of value: {tag!r}")


def _spans(attribute: str, text: str) -> list[Span]:
    if attribute == "@note":
        return gametext.note_spans(text)
    return [] if gametext.is_code(text) else [Span(0, len(text), text)]


def _command(thing: Thing, path: str):
    """The texts of an event command, by the rules of its opcode."""
    code, parameters = thing.attributes.get("@code"), thing.attributes.get("@parameters")
    if not isinstance(parameters, list) or code in (205, 357, 505) or (code == 122 and (len(parameters) < 5 or parameters[3] != 4)):
        return
    for rule, _, kind, split in OPCODES.get(code, ()):
        for k, p in enumerate(parameters):
            if isinstance(p, Text) and rule.match(str(k)):
                yield f"{path}/p:{k}", p, split(p.value), kind
            for n, choice in enumerate(p if isinstance(p, list) else ()):
                if isinstance(choice, Text) and rule.match(f"{k}/{n}"):
                    yield f"{path}/choice:{n}", choice, split(choice.value), kind


def _texts(node, path: str = "", open_: tuple[int, ...] = ()):
    """(id, string, spans, kind) of all texts of a graph; attributes and keys in sorted order, and cycles left at their start."""
    if id(node) in open_:
        return
    inside = (*open_, id(node))
    if isinstance(node, Thing):
        own = node.attributes
        if node.name == "RPG::EventCommand":
            seen = set()
            for id_, text, spans, kind in _command(node, path):
                if id_ not in seen:
                    seen.add(id_)
                    yield id_, text, spans, kind
        else:
            names = CLASS_ATTRIBUTES.get(node.name, sorted(own) if node.name in TERM_CLASSES else ())
            if node.name in RECORD_CLASSES and isinstance(own.get("@name"), Text) and own["@name"].value:
                names = RECORD_ATTRIBUTES
            for a in names:
                value, kind = own.get(a), "db" if a in LONG_ATTRIBUTES else "menu"
                for id_, t in [(f"{path}/{a}", value)] if isinstance(value, Text) else [(f"{path}/{a}/{k}", v) for k, v in enumerate(value if isinstance(value, list) else ())]:
                    if isinstance(t, Text):
                        yield id_, t, _spans(a, t.value), kind
        for k in sorted(own, key=str):
            yield from _texts(own[k], f"{path}/{k}", inside)
    elif isinstance(node, list):
        for k, v in enumerate(node):
            yield from _texts(v, f"{path}/{k}", inside)
    elif isinstance(node, dict):
        for k in sorted(node, key=str):
            yield from _texts(node[k], f"{path}/{k}", inside)


def _pieces(data: bytes):
    for id_, text, spans, kind in _texts(Stream(data).value()):
        for n, s in enumerate(spans):
            if s.source.strip():
                yield (f"{id_}/{n}" if len(spans) > 1 else id_), text, s, kind


def read(name: str, data: bytes, options: dict) -> list[Slot]:
    return [Slot(id_, s.source, kind) for id_, _, s, kind in _pieces(data)]


def write(name: str, data: bytes, targets: dict[str, str], options: dict) -> bytes:
    edits: dict[tuple[int, int], tuple[str, dict[int, tuple[Span, str]]]] = {}
    for id_, text, span, _ in _pieces(data):
        if targets.get(id_, span.source) != span.source:
            edits.setdefault((text.start, text.end), (text.value, {}))[1].setdefault(span.start, (span, targets[id_]))
    out, done = [], 0
    for (start, end), (value, parts) in sorted(edits.items()):
        for _, (span, target) in sorted(parts.items(), reverse=True):
            value = value[: span.start] + span.encoded(target) + value[span.end :]
        raw = value.encode("utf-8", "surrogateescape")
        out += [data[done:start], number_bytes(len(raw)), raw]
        done = end
    return b"".join(out) + data[done:]


FORMATS["ruby"] = Format("ruby", (".rvdata2", ".rvdata", ".rxdata"), r"(?i).*\.(?:rvdata2?|rxdata)", read, write, gametext.GAME_PATTERNS)
