"""Operator 8: byte-level BPE encoding and decoding by monoid tree reduction.

A merge-rank encoding is valid exactly if every two neighbouring tokens are what their joint bytes
encode to. So encodings form a monoid: two encoded halves are joined by looking at the boundary
alone. If the two tokens there are compatible, the concatenation is final; otherwise a window of
one more token on either side is encoded again until its outer tokens are compatible with what
stands outside, which proves that nothing outside can change. Halves are encoded recursively, and
decoding concatenates the bytes of the tokens up the same tree.

Each match of the split pattern is encoded separately, a match that is itself a token is that token,
and special tokens don't exist: what the tiktoken library's encode_ordinary returns.

Map-only: a row is encoded where it is read, nothing is shuffled. Memory: a long text is encoded in
bounded blocks of matches, and the caches of encoded words are bounded, two generations of
``CACHE`` entries a Python worker, kept for its next task until it works for an operator on words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .kernel import KEPT

#: Entries of one generation of a worker's cache of words.
CACHE = 300_000
#: Characters of the longest word that is cached.
CACHED_CHARS = 64
#: Bytes of the longest half whose encoding is cached.
LEAF_BYTES = 8
#: Characters of a text that are encoded at once.
BLOCK = 1 << 20

#: A space whose neighbours on both sides could join it in one white-space match.
_JOINT_SPACE = re.compile(r"[\s\x1c-\x1f\x85]\x20(?!\S)")


#: Marks that the pattern splits from letters before them.
_MARKS = {".", ","}


#: Above every rank.
_NEVER = 1 << 60


class Cache:
    """A bounded map in two generations: when the young one is full it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """An encoder and decoder for a table of merge ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.pairs, self.leaves, self.words = Cache(CACHE // 2), Cache(CACHE // 2), Cache(CACHE)

    @classmethod
    def of(cls, rank_file: bytes, pattern: str) -> Codec:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}, pattern)

    def _merge(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The parts of some bytes after their merges, the lowest rank first and the leftmost of equals; ends early at down_to parts."""
        get, parts = self.ranks.get, [piece[k : k + 1] for k in range(len(piece))]
        ranks = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while len(parts) > down_to:
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], _NEVER)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], _NEVER)
        return parts

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a few bytes."""
        return tuple([self.ranks[p] for p in self._merge(piece)])

    def halves_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte."""
        if token not in self.made_of:
            data = self.bytes_of[token]
            parts = [data] if len(data) == 1 else self._merge(data, 2)
            self.made_of[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]])
        return self.made_of[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side.

        Walks the merges at the boundary from the last to the first: any token across it, made
        before the merges that would take its parts away, breaks the pair.
        """
        ranks, bytes_of, limit = self.ranks, self.bytes_of, len(self.ranks) + len(self.bytes_of)
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                return False
            down_left, down_right = self.halves_of(left), self.halves_of(right)
            if down_left is not None and (left > right or down_right is None):
                limit, left = left, down_left[1]
            elif down_right is not None:
                limit, right = right + 1, down_right[0]
            else:
                return True

    def boundary(self, left: int, right: int) -> tuple[int, ...] | None:
        """What two neighbouring tokens become together; None if they stay."""
        key = left << 32 | right
        known = self.pairs.young.get(key, 0)
        if known == 0:
            known = self.pairs.old.get(key, 0)
            if known == 0:
                known = None if self.compatible(left, right) else self.merged(self.bytes_of[left] + self.bytes_of[right])
            self.pairs.put(key, known)
        return known

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left + right
        tokens = self.boundary(left[-1], right[0])
        if tokens is None:
            return left + right
        a, b = 1, 1
        while True:
            more_left = a < len(left) and self.boundary(left[-a - 1], tokens[0]) is not None
            more_right = b < len(right) and self.boundary(tokens[-1], right[b]) is not None
            if not more_left and not more_right:
                return left[: len(left) - a] + tokens + right[b:]
            a, b = min(len(left), a + more_left * a), min(len(right), b + more_right * b)
            tokens = self.merged(b"".join([self.bytes_of[t] for t in left[len(left) - a :] + right[:b]]))

    def reduced(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a byte string from those of its halves."""
        n = len(piece)
        if n > LEAF_BYTES:
            half = n // 2
            while half > 1 and piece[half] & 0xC0 == 0x80:  # not within a character
                half -= 1
            return self.joined(self.reduced(piece[:half]), self.reduced(piece[half:]))
        known = self.leaves.young.get(piece)
        if known is None:
            known = self.leaves.find(piece)
        if known is None:
            known = self.merged(piece) if n <= 3 else self.joined(self.reduced(piece[: n // 2]), self.reduced(piece[n // 2 :]))
            self.leaves.put(piece, known)
        return known

    def encoded(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern separately."""
        ids: list[int] = []
        for piece in self.split.findall(text):
            piece = piece.encode()
            rank = self.ranks.get(piece)
            if rank is None:
                ids.extend(self.reduced(piece))
            else:
                ids.append(rank)
        return ids

    def decoded(self, ids: list[int] | tuple[int, ...]) -> bytes:
        """The bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= 64:
            return b"".join([self.bytes_of[i] for i in ids])
        return self.decoded(ids[: len(ids) // 2]) + self.decoded(ids[len(ids) // 2 :])

    def word(self, word: str) -> tuple[int, str, bytes]:
        """Number of tokens, ids as text and decoded bytes of a word with the space before it."""
        found = self.words.young.get(word) or self.words.find(word)
        if found is None:
            if word.isalpha():  # letters alone: one match
                piece = b" " + word.encode()
                rank = self.ranks.get(piece)
                ids = self.reduced(piece) if rank is None else (rank,)
            elif word[-1:] in _MARKS and word[:-1].isalpha():  # and a match of its own for the mark
                (n, text, data), mark = self.word(word[:-1]), self.ranks[word[-1:].encode()]
                return self.put_word(word, (n + 1, f"{text},{mark}", data + self.bytes_of[mark]))
            else:
                ids = self.encoded(" " + word)
            found = self.put_word(word, (len(ids), ",".join(map(str, ids)), self.decoded(ids)))
        return found

    def put_word(self, word: str, found: tuple[int, str, bytes]) -> tuple[int, str, bytes]:
        if len(word) <= CACHED_CHARS:
            self.words.put(word, found)
        return found

    def blocks(self, text: str) -> Iterator[tuple[int, str, bytes]]:
        """Number of tokens, ids as text and decoded bytes, for one block of a text after another.

        Between words that are one space apart the pattern always splits before the space, so such
        words are encoded each on their own, from the cache; a text with other white space around
        spaces goes through the pattern as a whole.
        """
        if _JOINT_SPACE.search(text):
            ids: list[int] = []
            for match in self.split.finditer(text):
                piece = match[0].encode()
                rank = self.ranks.get(piece)
                if rank is None:
                    ids.extend(self.reduced(piece))
                else:
                    ids.append(rank)
                if len(ids) >= BLOCK // 4:
                    yield len(ids), ",".join(map(str, ids)), self.decoded(ids)
                    ids = []
            if ids:
                yield len(ids), ",".join(map(str, ids)), self.decoded(ids)
            return
        start, end = 0, len(text)
        while start < end:
            stop = end if end - start <= BLOCK else text.find(" ", start + BLOCK)
            stop = end if stop < 0 else stop
            first, *words = text[start:stop].split(" ")
            get = self.words.young.get
            parts = [get(w) for w in words]
            if None in parts:
                parts = [p or self.word(w) for p, w in zip(parts, words)]
            if first:
                ids = self.encoded(first)
                parts.insert(0, (len(ids), ",".join(map(str, ids)), self.decoded(ids)))
            if parts:
                yield sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
            start = stop

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the comma-joined ids and SHA-256 of the bytes they decode to."""
        n, ids_sum, bytes_sum = 0, hashlib.sha256(), hashlib.sha256()
        for count, ids, data in self.blocks(text):
            ids_sum.update(("," if n else "").encode() + ids.encode())
            bytes_sum.update(data)
            n += count
        return n, ids_sum.hexdigest(), bytes_sum.hexdigest()


def codec_for(rank_file: bytes, pattern: str) -> Codec:
    """This process's codec for a rank file, with its caches."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Codec.of(rank_file, pattern)
    return KEPT[key]


def _clean(df: DataFrame, column: str) -> list[str]:
    """The columns of df but those of that name, whatever their case: Spark's names don't tell cases apart."""
    return [c for c in df.columns if c.lower() != column.lower()]


def _ranks(df: DataFrame, rank_path: str):
    with open(rank_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: its size doesn't depend on the data


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with a column of token ids; a null or empty text has none. A column of that name is replaced.

    The ids of one text are one row's array, so a text's tokens have to fit in a task's memory.
    """
    ranks = _ranks(df, rank_path)

    def run(batches):
        codec = codec_for(ranks.value, pattern)
        for batch in batches:
            out = pa.array([codec.encoded(t.as_py() or "") for t in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], [*kept, ids])

    kept = _clean(df, ids)
    return df.select(*kept).mapInArrow(run, StructType(df.select(*kept).schema.fields).add(ids, ArrayType(IntegerType())))


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for (bytes: ids may end within a character); null ids give null."""
    ranks = _ranks(df, rank_path)

    def run(batches):
        codec = codec_for(ranks.value, pattern)
        for batch in batches:
            out = pa.array([None if t.as_py() is None else codec.decoded(t.as_py()) for t in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], [*kept, data])

    kept = _clean(df, data)
    return df.select(*kept).mapInArrow(run, StructType(df.select(*kept).schema.fields).add(data, "binary"))


def digests(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256), one for each row of df, repeated keys included.

    A null or empty text has no token and the digests of the empty string.
    """
    ranks = _ranks(df, rank_path)

    def run(batches):
        codec = codec_for(ranks.value, pattern)
        for batch in batches:
            found = [codec.digests(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = StructType(df.select(key).schema.fields).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return df.select(key, text).mapInArrow(run, schema)
