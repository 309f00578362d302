"""Operator 10: language-model scoring by a probabilistic suffix tree.

Symbols are words, lower-cased, and the end of a text. A state of the tree is a context of up to DEPTH
words that stand before a symbol, wherever lines or sentences end. A state lists the symbols that
follow it at least OCCURRENCES times in training, c of its N times, with the probability (c - DISCOUNT) / N; what is
left of 1, its ``rest``, is spread over all symbols as its parent does: the longest shorter suffix that is
in the tree, in the end the root. A context is retained if its list diverges from its parent's
distribution: the log-likelihood that it gains over its training occurrences must exceed half a
logarithm of N for each listed symbol. Each token is scored by the longest retained suffix of what stands before it.
The root gives a word its share of the training tokens, smoothed by its spelling with the weight of all words seen
once; spelling is a Markov model of two bytes of context. All probabilities of a state sum to 1.

The tree is never gathered: it stays dealt by context hash, in buckets. Texts are cut into batches of words once;
level by level, a batch sends its distinct (context, symbol) pairs with their counts and their
probabilities by the levels above to the contexts' buckets, packed as one row a (batch, bucket), and gets back the
counts and the rests of retained contexts, one row again. A context that occurs once gets no deeper ones,
one that occurs as often as without its first word isn't sent, and symbols that are rare after a shorter
context already are sent as one. So what is counted grows with the corpus, and levels get smaller.

Contexts of more than HOT occurrences (or 1 / 2 ** SHARE of all tokens, if that is more) are dealt to
several buckets by symbol, and only their sums, at most 2 ** SHARE rows, are shipped to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import freed, stored

#: Words of the longest context.
DEPTH = 3
#: Least occurrences of a symbol after a context to be listed, and what is taken off each.
OCCURRENCES, DISCOUNT = 2, 0.5
#: Occurrences of a context that one bucket takes; if more, logarithm of the share of all tokens that one takes.
HOT, SHARE = 1 << 20, 18
#: Tokens of a batch (or one longer text), and pairs of a bucket, about.
BATCH, BUCKET = 800_000, 1_000_000
#: Weight of the shorter context in the spelling model.
PARENT = 2.0
#: Documents whose crc32(key) mod FOLDS is HELD are not learned from.
FOLDS, HELD = 7, 2
#: The separator: before a word as context, after it as a symbol; no word contains it.
SPACE = 0x20
#: Steps of a power of two in which probabilities are sent.
_STEPS = 32
#: Bits of a hash that aren't sent at each level, the last for deeper ones: none of a word's, whose counts are exact. A
#: context's bucket depends on all of them, and a bucket has some million contexts.
_CUT = (0, 16, 24)
_END, _ONE, _TWO = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _places(a: np.ndarray):
    """The first bytes of all numbers, the second ones, and so on; by shifts, as copies with a step are slower."""
    size = a.dtype.itemsize
    whole = a.view(f"u{size}")
    used = (int(whole.max()).bit_length() + 7) // 8 if len(a) else 0
    yield from ((whole >> whole.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(used))
    yield bytes(len(a) * (size - used))


def _whole(places: np.ndarray, kind) -> np.ndarray:
    """The numbers of such bytes, in rows by place."""
    size = np.dtype(kind).itemsize
    out = places[0].astype(f"u{size}")
    for k in range(1, size):
        if places[k].any():
            out |= places[k].astype(out.dtype) << out.dtype.type(8 * k)
    return out.view(kind)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed: the bytes of like place together."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    body = b"".join(part for a in arrays for part in _places(np.ascontiguousarray(a)))
    return head + pa.compress(body, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at = [0, *np.cumsum([n * np.dtype(k).itemsize for n, k in zip(sizes.tolist(), kinds)]).tolist()]
    body = np.frombuffer(pa.decompress(data[8 * (len(kinds) + 1) :], at[-1], "zstd", asbytes=True) if at[-1] else b"", np.uint8)
    return [_whole(body[i:j].reshape(np.dtype(k).itemsize, -1), k) for i, j, k in zip(at[:-1], at[1:], kinds)]


# Spelling

def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of some words one after another, and their offsets."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8), offsets


def _triples(spelled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three bytes for each symbol of the words' spelling, two before it and itself; words end with SPACE."""
    begin = np.concatenate([[0], np.cumsum(sizes + 3)])
    text = np.full(begin[-1], SPACE, dtype=np.uint8)
    word = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(spelled)) + 3 * word + 2
    text[at] = spelled
    symbol = np.ones(len(text), dtype=bool)
    symbol[begin[:-1]] = symbol[begin[:-1] + 1] = False
    at = np.flatnonzero(symbol)
    return np.stack([text[at - 2], text[at - 1], text[at]])


class Spelling:
    """log10 probabilities of the bytes of words by the two before them; bytes that no training word has share one symbol."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        bytes_ = np.stack([keys >> 16, keys >> 8 & 255, keys & 255]).astype(np.int64)
        known = np.unique(np.append(bytes_, SPACE))
        self.code = np.zeros(256, np.int64)
        self.code[known] = np.arange(1, len(known) + 1)
        n = len(known) + 1
        table = np.zeros((n, n, n))
        np.add.at(table, tuple(self.code[bytes_]), counts)
        p = np.full(n, 1.0 / n)
        for axes in ((0, 1), (0,), ()):  # smoothed by shorter contexts
            c = table.sum(axis=axes)
            p = (c + PARENT * p) / (c.sum(axis=-1, keepdims=True) + PARENT)
        self.logs = np.log10(p)
        self.logs[..., 0] -= np.log10(256)
        self.logs = self.logs.astype(np.float32)
        self.codes = self.code * n * n, self.code * n, self.code

    def words(self, spelled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probabilities of words, at least -300."""
        out = np.zeros(len(sizes))
        ends = np.cumsum(sizes)
        for lo in range(0, len(sizes), 50_000):
            hi = min(lo + 50_000, len(sizes))
            triples = _triples(spelled[ends[lo] - sizes[lo] : ends[hi - 1]], sizes[lo:hi])
            logs = self.logs.reshape(-1)[sum(code[t] for code, t in zip(self.codes, triples))]
            out[lo:hi] = np.add.reduceat(logs, np.cumsum(sizes[lo:hi] + 1) - sizes[lo:hi] - 1, dtype=np.float64)
        return np.maximum(out, -300.0)

    def listed(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same of words with a SPACE after each, and the places of those."""
        out, starts = np.zeros(len(ends)), np.append(0, ends + 1)
        for lo in range(0, len(ends), 50_000):
            hi = min(lo + 50_000, len(ends))
            own = np.concatenate([np.full(2, SPACE, np.uint8), text[starts[lo] : starts[hi]]])
            begin = starts[lo:hi] - starts[lo]
            first = own[:-2].copy()
            first[begin] = SPACE
            logs = self.logs.reshape(-1)[sum(code[t] for code, t in zip(self.codes, (first, own[1:-1], own[2:])))]
            out[lo:hi] = np.add.reduceat(logs, begin, dtype=np.float64)
        return np.maximum(out, -300.0)


def _counted(spelled: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct triples of some words, and how many times each stands there."""
    t = _triples(spelled, sizes)
    return np.unique(t[0].astype(np.int32) << 16 | t[1].astype(np.int32) << 8 | t[2], return_counts=True)


# Batches

def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts hashes, where each different one begins in it, and the first place of each."""
    bits = np.uint64(len(hashes).bit_length())
    both = np.sort(hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64))  # several times as fast as argsort
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = hashes[order]
    if ((ranked[1:] != ranked[:-1]) != ((both[1:] ^ both[:-1]) >> bits > 0)).any():  # hashes that differ in their last bits alone
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, start, order[start]


_BATCH = "batch bigint, train binary, docs binary, tokens binary, spelled binary, letters bigint, triples binary"
_NAMES = [c.split()[0] for c in _BATCH.split(", ")]


def batches_of(df: DataFrame, kind: str) -> DataFrame:
    """Rows (batch, keys, ...) of about BATCH tokens from rows (key, text, train).

    train: a flag for each text; docs: their numbers of words; spelled: the batch's different words, frequent ones
    first, with a SPACE after each; tokens: their numbers in that order; triples: what the spelling model
    counts, each word of a training text once.
    """

    def row(number, waiting):
        keys = pa.concat_arrays([w[0] for w in waiting])
        train, docs, hashes, data, sizes = (np.concatenate([w[k] for w in waiting]) for k in range(1, 6))
        ranked, start, first = _grouped(hashes)
        types, n = hashes[first], np.diff(np.append(start, len(hashes)))
        tokens = np.empty(len(hashes), np.int64)
        tokens[ranked] = np.repeat(np.arange(len(types)), n)
        order = np.argsort((64 - np.log2(n).astype(np.int64)).astype(np.uint8), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, tokens = first[order], place[tokens]
        ends = np.cumsum(sizes)
        spelled, offsets = _spelled(data, (ends - sizes)[first], ends[first])
        learned = np.bincount(tokens, weights=np.repeat(train, docs), minlength=len(types)) > 0
        some, places = _spelled(spelled, offsets[:-1][learned], offsets[1:][learned])
        triples = _counted(some, np.diff(places))
        values = [(TaskContext.get().partitionId() << 32) + number, train.tobytes(), packed(docs), packed(tokens.astype(np.int32)), pa.compress(np.insert(spelled, offsets[1:], SPACE).tobytes(), "zstd", asbytes=True), len(spelled) + len(types), packed(triples[0].astype(np.int32), triples[1].astype(np.int64))]
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([*(pa.array([v]) for v in values), lists], [*_NAMES, "keys"])

    def run(batches):
        number, waiting, size = 0, [], 0
        for batch in batches:
            data, offsets = kernel.flat(batch.column(1))
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for at_row, at, hashes, starts, ends in kernel.words(batch.column(1), places=True):
                n = len(at) - 1
                base = np.repeat(offsets[at_row : at_row + n], np.diff(at))
                # a piece's different words alone keep their bytes
                keep = np.zeros(len(hashes), dtype=bool)
                keep[_grouped(hashes)[2]] = True
                spelled, _ = _spelled(data, (starts + base)[keep], (ends + base)[keep])
                sizes = np.where(keep, ends - starts, 0).astype(np.int64)
                waiting.append((batch.column(0).slice(at_row, n), flags[at_row : at_row + n], np.diff(at).astype(np.int64), hashes, spelled, sizes))
                size += len(hashes) + n
                if size >= BATCH:
                    yield row(number, waiting)
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield row(number, waiting)

    return df.select("key", "text", "train").mapInArrow(run, f"{_BATCH}, keys array<{kind}>")


# Levels

def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, the place of each number among them, and a place where each stands."""
    bits = max(1, len(codes).bit_length())
    if len(codes) and int(codes.max()) < 1 << (62 - bits):  # numbers and places in one: sorts several times as fast
        both = np.sort(codes << bits | np.arange(len(codes)))
        codes, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=bool)
    back = np.empty(len(codes), np.int64)
    back[order] = np.cumsum(new) - 1
    return codes[new], back, order[new]


def _sorted(codes: np.ndarray) -> np.ndarray:
    """The order that sorts the numbers, and equal ones by place."""
    bits = max(1, len(codes).bit_length())
    if len(codes) and int(codes.max()) < 1 << (62 - bits):
        return np.sort(codes << bits | np.arange(len(codes))) & ((1 << bits) - 1)
    return np.argsort(codes, kind="stable")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((kernel.mix(hashes) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Level:
    """The distinct (context, symbol) pairs of a batch at one depth, in the order in which they are dealt."""

    def __init__(self, contexts, context, symbols, n, buckets, limit, cut):
        """contexts: their hashes and occurrences n; of each pair: context (a number in contexts, in their order), hash of the symbol.
        limit: a context of more occurrences goes to several buckets. cut: bits of contexts that aren't sent."""
        self.cut = np.uint64(cut)
        self.n = np.where(n > limit, n, 0)  # a context in one bucket gets all its occurrences
        bits = np.uint64(len(contexts).bit_length())  # sorted hashes are smaller; their last bits don't matter
        by = (np.sort(contexts >> bits << bits | np.arange(len(contexts), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        bucket = _bucket(contexts, buckets)
        if self.n.any():
            place = np.empty(len(contexts), np.int64)
            place[by] = np.arange(len(contexts))
            bucket = bucket[context]
            hot = np.flatnonzero(self.n[context])
            own = contexts[context[hot]]
            part = kernel.mix(symbols[hot] * _TWO) % (1 + self.n[context[hot]] // int(limit)).astype(np.uint64)
            bucket[hot] = _bucket(own + part * _ONE, buckets)
            self.order = _sorted(bucket * len(contexts) + place[context])
            self.at = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        else:  # contexts move whole, and their pairs follow one another
            by = by[np.argsort(bucket[by].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
            pairs = np.bincount(context, minlength=len(contexts))
            size = pairs[by]
            ends = np.concatenate([[0], np.cumsum(size)])
            self.order = np.repeat((np.cumsum(pairs) - pairs)[by] - ends[:-1], size) + np.arange(len(context))
            self.at = ends[np.searchsorted(bucket[by], np.arange(buckets + 1))]
        self.contexts, self.context = contexts, context[self.order]

    def runs(self, i: int, j: int) -> np.ndarray:
        own = self.context[i:j]
        return np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))

    def rows(self, symbol, counts, q):
        """(bucket, packed pairs) of the buckets that get any. Of each pair: what is sent of its symbol, training count, probability."""
        symbol, counts, q = symbol[self.order], counts[self.order].astype(np.int32), q[self.order]
        for b in np.flatnonzero(np.diff(self.at)).tolist():
            i, j = self.at[b], self.at[b + 1]
            runs = self.runs(i, j)
            own = self.context[i:j][runs]
            yield b, packed(self.contexts[own] >> self.cut, np.diff(np.append(runs, j - i)).astype(np.int32), self.n[own].astype(np.int64), symbol[i:j], counts[i:j], q[i:j])

    def answered(self, replies: dict[int, bytes], sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, in the order before dealing, its count, and the rest of its context, -1 if that is not retained."""
        contexts, context = self.contexts, self.context
        counts, rest = np.zeros(len(self.order), np.int64), np.full(len(self.order), -1.0)
        for b in np.flatnonzero(np.diff(self.at)).tolist():
            i, j = self.at[b], self.at[b + 1]
            runs = self.runs(i, j)
            c, r = unpacked(replies[b], np.int64, np.float32)
            hot = np.flatnonzero(r < -1.5)
            if len(hot):  # contexts in several buckets
                at = np.searchsorted(sums[0], contexts[context[i:j][runs[hot]]] >> self.cut)
                r = r.copy()
                r[hot] = sums[1][at]
            counts[self.order[i:j]] = c
            rest[self.order[i:j]] = np.repeat(r, np.diff(np.append(runs, j - i)))
        return counts, rest


def retained(n, c, discounted, symbols, gain):
    """The rest of contexts from sums over their listed symbols, -1 if they don't diverge: n occurrences, c of listed symbols,
    their discounted sum, their number, and the gain in nats of their probabilities over the parent's."""
    rest = 1 - discounted / np.maximum(n, 1)
    total = gain + (n - c) * np.log(np.maximum(rest, 1e-12))
    return np.where((symbols > 0) & (total > 0.5 * symbols * np.log(np.maximum(n, 2))), rest, -1.0)


def meet(table: pa.Table, limit: float) -> pa.Table:
    """A bucket's rows (batch, bucket, pairs) answered: rows (batch, bucket, reply); and rows of sums, (context, n, c,
    discounted, symbols, gain) of contexts in several buckets, and with a null context the numbers (n, c, symbols) of
    training occurrences, of pairs that have any and of those that have one."""
    kinds = (np.uint64, np.int32, np.int64, np.uint32, np.int32, np.uint16)
    rows = [unpacked(x, *kinds) for x in table["pairs"].to_pylist()]
    runs, sizes = np.concatenate([r[1] for r in rows]), [len(r[3]) for r in rows]
    names, own = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    own = np.repeat(own, runs)
    context, n = names[own], np.repeat(np.concatenate([r[2] for r in rows]), runs)
    symbol, count, q = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5))
    order = np.argsort(own.astype(np.uint64) << np.uint64(32) | symbol)
    context, symbol, n, q = context[order], symbol[order], n[order], q[order]
    new = np.concatenate([[True], context[1:] != context[:-1]])
    first = np.flatnonzero(new | np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    c = np.add.reduceat(count[order].astype(np.int64), first)
    start = np.flatnonzero(new[first])  # of contexts, among pairs
    listed = (c >= OCCURRENCES) & (symbol[first] > 0)
    of_pair = np.cumsum(new[first]) - 1
    n_own = n[first][start]
    n_own = np.where(n_own > 0, n_own, np.add.reduceat(c, start))
    n_pair = np.maximum(n_own[of_pair], 1)
    taken = np.where(listed, c - DISCOUNT, 0.0)
    gain = np.where(listed, c * (np.log(np.maximum(taken, DISCOUNT) / n_pair) + q[first] * (np.log(2) / _STEPS)), 0.0)
    c_own, t_own, k_own, g_own = (np.add.reduceat(x, start) for x in (np.where(listed, c, 0), taken, listed.astype(np.int64), gain))
    hot = n_own > limit
    rest = np.where(hot, -2.0, retained(n_own, c_own, t_own, k_own, g_own)).astype(np.float32)
    back, rest_back = np.empty(len(order), np.int64), np.empty(len(order), np.float32)
    length = np.diff(np.append(first, len(order)))
    back[order], rest_back[order] = np.repeat(c, length), np.repeat(rest[of_pair], length)
    replies, at = [], 0
    for r, size in zip(rows, sizes):
        begin = np.cumsum(r[1]) - r[1]
        replies.append(packed(back[at : at + size], rest_back[at : at + size][begin]))
        at += size
    sums = int(hot.sum())
    column = lambda head, tail, kind: pa.array([*head, *tail], kind)
    gone = [None] * (sums + 1)
    return pa.table({
        "batch": column(table["batch"].to_pylist(), gone, pa.int64()), "bucket": column(table["bucket"].to_pylist(), gone, pa.int64()), "reply": column(replies, gone, pa.binary()),
        "context": column([None] * len(rows), [*context[first][start][hot].view(np.int64).tolist(), None], pa.int64()),
        "n": column([None] * len(rows), [*n_own[hot].tolist(), int(c.sum())], pa.int64()), "c": column([None] * len(rows), [*c_own[hot].tolist(), int((c > 0).sum())], pa.int64()),
        "discounted": column([None] * len(rows), [*t_own[hot].tolist(), 0.0], pa.float64()), "symbols": column([None] * len(rows), [*k_own[hot].tolist(), int((c == 1).sum())], pa.int64()),
        "gain": column([None] * len(rows), [*g_own[hot].tolist(), 0.0], pa.float64()),
    })


_REPLY = "batch bigint, bucket bigint, reply binary, context bigint, n bigint, c bigint, discounted double, symbols bigint, gain double"


class Corpus:
    """What is known of the whole corpus, level by level: numbers of small size that tasks get."""

    def __init__(self, buckets: int):
        self.depth = DEPTH
        self.buckets = [buckets]  # of each level
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []  # contexts in several buckets of each level, and their rests
        self.ends = self.total = self.distinct = 0
        self.unseen, self.limit = 1.0, float(HOT)
        self.spelling: Spelling | None = None


class Batch:
    """A batch of texts, as far as the levels are known."""

    def __init__(self, row: dict, corpus: Corpus, replies: dict[int, dict[int, bytes]]):
        self.corpus = corpus
        self.train = np.frombuffer(row["train"], bool)
        (docs,) = unpacked(row["docs"], np.int64)
        (tokens,) = unpacked(row["tokens"], np.int32)
        text = pa.decompress(row["spelled"], row["letters"], "zstd", asbytes=True) if row["letters"] else b""
        spelled = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(spelled == SPACE)
        types = np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _, _ in kernel.words(pa.array([text.decode("utf-8", "surrogatepass")])))])
        self.types = np.append(types, _END)  # the end of a text is the last type
        self.doc = np.repeat(np.arange(len(docs)), docs + 1)
        last = np.cumsum(docs + 1) - 1
        self.begin = last - docs
        self.tokens = np.insert(tokens.astype(np.int64), last - np.arange(len(docs)), len(types))
        self.learned = np.repeat(self.train, docs + 1)
        self.level = 0
        every = np.arange(len(types))
        self.dealt = Level(types, every, types, np.zeros(len(types), np.int64), corpus.buckets[0], np.inf, _CUT[0])
        if 0 in replies:
            self._root(replies[0], spelled, ends)
        for level in range(1, len(replies)):
            self._grown(replies[level], corpus.sums[level])

    def _root(self, replies, spelled, ends):
        c = self.corpus
        counts, _ = self.dealt.answered(replies, c.sums[0])
        self.counts = np.append(counts, c.ends)
        logs = np.append(c.spelling.listed(spelled, ends), c.spelling.words(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        self.p = np.maximum((self.counts + c.unseen * 10.0**logs) / (c.total + c.unseen), 1e-300)[self.tokens]
        self.first = self.counts[self.tokens]
        # the last gram, which never occurs, stands where there is none
        self.gram, self.gram_hash, self.seen = self.tokens, kernel.mix(self.types * _ONE), np.append(self.counts, 0)
        self.before = np.full(len(self.tokens), -1)  # how often the context of the level above occurs
        if self.corpus.depth:
            self._next()

    def _next(self):
        """The pairs of the next level. A context that occurs as often as the one without its first word has the
        same symbols: it can't diverge from it, and its counts are known."""
        self.level += 1
        size = len(self.types) + 1
        often = self.seen[self.gram]
        n = np.concatenate([[0], often[:-1]])
        n[self.begin] = 0
        enough, same = n >= OCCURRENCES, n == self.before
        self.some = np.flatnonzero(enough & ~same)
        self.same = np.flatnonzero(enough & same)
        self.same = self.same[self.gram[self.same] < len(self.seen) - 1]
        self.same_gram = self.gram[self.same]
        self.before = n
        symbol = np.where(often[self.some] >= OCCURRENCES, self.tokens[self.some] + 1, 0)  # 0: too rare to be listed
        codes, self.back, self.at = _distinct(self.gram[self.some - 1] * size + symbol)
        self.context, self.symbol = codes // size, codes % size
        self.hashes = np.where(self.symbol > 0, self.types[self.symbol - 1], np.uint64(0))
        new = np.concatenate([[True], self.context[1:] != self.context[:-1]]) if len(codes) else np.zeros(0, dtype=bool)
        names, buckets = self.context[new], self.corpus.buckets
        self.dealt = Level(self.gram_hash[names], np.cumsum(new) - 1, self.hashes, self.seen[names], buckets[min(self.level, len(buckets) - 1)], self.corpus.limit, _CUT[min(self.level, len(_CUT) - 1)])

    def rows(self):
        """(bucket, packed pairs) of the last level."""
        if self.level == 0:
            n = len(self.types) - 1
            nothing = np.zeros(n, np.int64)
            counts = np.bincount(self.tokens[self.learned], minlength=n + 1)[:n]
            return self.dealt.rows(nothing.astype(np.uint32), counts, nothing.astype(np.uint16))
        counts = np.bincount(self.back, weights=self.learned[self.some], minlength=len(self.symbol))
        q = np.where(self.symbol > 0, np.clip(np.round(-np.log2(self.p[self.some[self.at]]) * _STEPS), 0, 65535), 0).astype(np.uint16)
        bits = np.uint64(32 if self.level == 1 else 40)  # a context of several words has few symbols
        short = np.where(self.symbol > 0, np.maximum((self.hashes >> bits).astype(np.uint32), 1), 0).astype(np.uint32)
        return self.dealt.rows(short, counts, q)

    def _grown(self, replies, sums):
        counts, rest = self.dealt.answered(replies, sums)
        counts = np.where(self.symbol > 0, counts, 0)
        listed = np.where(counts >= OCCURRENCES, (counts - DISCOUNT) / np.maximum(self.seen[self.context], 1), 0.0)
        held = np.flatnonzero((rest >= 0)[self.back])
        pair, place = self.back[held], self.some[held]
        self.p[place] = rest[pair] * self.p[place] + listed[pair]
        if self.level == self.corpus.depth:
            return
        pair_hash = kernel.mix(self.gram_hash[self.context] * _ONE + self.hashes)
        held = np.zeros(len(self.seen), dtype=bool)
        held[self.same_gram] = True
        old, none = np.flatnonzero(held), len(counts) + np.count_nonzero(held)
        self.gram = np.full(len(self.tokens), none)
        self.gram[self.some] = np.where(self.symbol > 0, np.arange(len(counts)), none)[self.back]
        self.gram[self.same] = len(counts) - 1 + np.cumsum(held)[self.same_gram]
        self.gram_hash, self.seen = np.concatenate([pair_hash, self.gram_hash[old]]), np.concatenate([counts, self.seen[old], [0]])
        self._next()

    def scores(self):
        """Numbers of tokens, of known ones, base scores and scores of the texts."""
        c, docs = self.corpus, len(self.train)
        n = np.bincount(self.doc, minlength=docs)
        base = np.bincount(self.doc, weights=np.log10(self.first + 1.0), minlength=docs) - n * np.log10(c.total + c.distinct + 1)
        return n, np.bincount(self.doc, weights=self.first > 0, minlength=docs).astype(np.int64), base, np.bincount(self.doc, weights=np.log10(self.p), minlength=docs)


def _replies(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, reply in zip(*(table[c].to_pylist() for c in ("level", "bucket", "reply"))):
        out.setdefault(level, {})[bucket] = reply
    return out


_PAIRS = "batch bigint, bucket bigint, pairs binary"


def _dealt(number: int, batch: Batch) -> pa.Table:
    rows = list(batch.rows())
    return pa.table({"batch": pa.array([number] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int64()), "pairs": pa.array([x for _, x in rows], pa.binary())})


def _meeting(limit: float):
    return lambda table: meet(table, limit)


def _further(shared):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return _dealt(row["batch"], Batch(row, shared.value, _replies(right)))

    return run


def grown(batches: DataFrame, tokens: int) -> tuple[Corpus, DataFrame]:
    """The tree over batches of so many tokens: what tasks get, and the replies (batch, bucket, reply, level) of all levels."""
    spark = batches.sparkSession
    corpus = Corpus(int(max(12, tokens // (4 * BUCKET))))

    def triples(rows):
        for batch in rows:
            for x in batch.column(0).to_pylist():
                key, n = unpacked(x, np.int32, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = batches.select("triples").mapInArrow(triples, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** 3 rows
    corpus.spelling = Spelling(found["key"].to_numpy(), found["n"].to_numpy())
    ends = batches.select("train").mapInArrow(lambda rows: (pa.RecordBatch.from_arrays([pa.array([sum(x.count(1) for x in b.column(0).to_pylist())])], ["n"]) for b in rows), "n bigint").agg(F.sum("n")).first()[0]
    corpus.ends = int(ends or 0)
    shared, answered, kept = spark.sparkContext.broadcast(corpus), None, []
    slim = batches.drop("keys", "triples")
    for level in range(DEPTH + 1):
        if level == 0:

            def first(rows):
                for b in rows:
                    for row in b.to_pylist():
                        yield from _dealt(row["batch"], Batch(row, shared.value, {})).to_batches()

            pairs = slim.mapInArrow(first, _PAIRS)
        else:

            pairs = slim.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(_further(shared), _PAIRS)
        found = stored(pairs.groupBy("bucket").applyInArrow(_meeting(corpus.limit if level else float("inf")), _REPLY))
        kept.append(found)
        if level == 0:
            total, distinct, once = found.where("batch is null").agg(F.sum("n"), F.sum("c"), F.sum("symbols")).first()
            corpus.total, corpus.distinct = int(total or 0) + corpus.ends, int(distinct or 0) + (corpus.ends > 0)
            corpus.unseen, corpus.limit = float(max(once or 0, 1)), float(max(HOT, corpus.total >> SHARE))
            corpus.sums.append((np.zeros(0, np.uint64), np.zeros(0)))
        else:
            parts = found.where("batch is null and context is not null").groupBy("context").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in ("c", "discounted", "symbols", "gain")))
            t = parts.toArrow()  # at most 2 ** SHARE rows
            names, values = t["context"].to_numpy().view(np.uint64), [t[c].to_numpy() for c in ("n", "c", "discounted", "symbols", "gain")]
            order = np.argsort(names)
            corpus.sums.append((names[order], retained(*values)[order]))
        corpus.buckets.append(int(max(12, tokens // BUCKET)))
        reply = found.where("batch is not null").select("batch", "bucket", "reply", F.lit(level).alias("level"))
        answered = reply if answered is None else answered.union(reply)
        shared = spark.sparkContext.broadcast(corpus)
        del pairs
        freed(spark)
    return corpus, answered


def scored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of df.

    A null or empty text is its end alone. A null key counts as the empty string when folds are
    dealt; keys are of any type that can be a string. Rows that repeat a key count as often as they
    stand there. Without training texts N and V are 0, and no token is known.
    """
    kind = df.schema[key].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~held).alias("train"))
    batches = stored(batches_of(rows, kind))

    def sizes(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(unpacked(x, np.int32)[0]) for x in batch.column(0).to_pylist())])], ["n"])

    tokens = int(batches.select("tokens").mapInArrow(sizes, "n bigint").agg(F.sum("n")).first()[0] or 0)
    corpus, answered = grown(batches, tokens)
    shared = df.sparkSession.sparkContext.broadcast(corpus)
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left["keys"].combine_chunks().flatten()
        batch = Batch(left.drop_columns(["keys"]).to_pylist()[0], shared.value, _replies(right))
        n, known, base, score = batch.scores()
        return pa.table([keys, pa.array(~batch.train), pa.array(n), pa.array(known), pa.array(np.full(len(n), shared.value.total)), pa.array(base), pa.array(score)], names=names)

    return batches.drop("triples").groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(scores, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
