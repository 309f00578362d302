"""JSON documents as leaves with their places, and edits that leave every other byte alone."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^ \t\r\n{}\[\],:"]+)', re.S)


@dataclass(frozen=True)
class Leaf:
    """A value that isn't a container: its JSON Pointer, the nearest member name, the value, and its place in the text."""

    pointer: str
    key: str
    value: object
    start: int
    end: int


def text_of(data: bytes) -> tuple[str, str]:
    """The byte-order mark and the text; bytes that aren't UTF-8 survive a round trip."""
    text = data.decode("utf-8", "surrogateescape")
    return ("\ufeff", text[1:]) if text.startswith("\ufeff") else ("", text)


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def escaped(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def unescaped(token: str) -> str:
    return token.replace("~1", "/").replace("~0", "~")


def leaves(text: str) -> Iterator[Leaf]:
    """All leaves of a document in its order. Raises ValueError if it isn't JSON."""
    json.loads(text)
    stack: list[list] = []  # [pointer, key, is object, index or member name, awaiting a name]
    for m in _TOKEN.finditer(text):
        token = m[1]
        if token in ",:":
            if token == "," and stack:
                stack[-1][4] = stack[-1][2]
            continue
        if token in "}]":
            stack.pop()
            continue
        if stack and stack[-1][4]:
            stack[-1][3], stack[-1][4] = json.loads(token), False
            continue
        pointer, key = "", ""
        if stack:
            top = stack[-1]
            pointer, key = f"{top[0]}/{escaped(top[3]) if top[2] else top[3]}", top[3] if top[2] else top[1]
            if not top[2]:
                top[3] += 1
        if token in "{[":
            stack.append([pointer, key, token == "{", 0, token == "{"])
        else:
            yield Leaf(pointer, key, json.loads(token), m.start(1), m.end(1))


def edited(text: str, values: dict[str, str]) -> str:
    """The text with the strings at some pointers replaced; pointers of no string are ignored, and all else stays as it is."""
    parts, done = [], 0
    for leaf in leaves(text):
        value = values.get(leaf.pointer)
        if value is not None and isinstance(leaf.value, str) and value != leaf.value:
            parts += [text[done : leaf.start], json.dumps(value, ensure_ascii=False)]
            done = leaf.end
    return "".join(parts) + text[done:]
