"""Array kernels over Arrow string columns: words, word hashes, shingles.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; the separators are all
ASCII, so working on UTF-8 bytes and on code points gives the same words. Hashes are 64-bit.
Null texts count as empty. Temporary arrays stay within a few dozen times ``PIECE`` bytes,
whatever the length of a text: texts are cut at separators and only 8 bytes a word are kept.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that separate words: white space, or every ASCII byte but letters and digits.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_LOWER += 1
#: Odd multipliers of the places of a shingle.
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)

#: What an operator keeps in a Python worker from one task to the next, such as a codec and its caches. Workers
#: outlive stages, and an executor's have to fit beside its heap: who reads words here lets go of it.
KEPT: dict = {}

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE + 1)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def released() -> None:
    """Let go of what is KEPT, and give the memory back to the system where the C library can."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _piece(data: np.ndarray, breaks: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends of some bytes; breaks: places where a word ends in any case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _grow(n + 1)
    word = ~separator[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[breaks] = True
    cut[0] = cut[n] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * _powers[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverses[starts]), starts, ends


def words(column: pa.Array, places: bool = False, separator: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about PIECE bytes: the first row, offsets of the rows into the word arrays,
    word hashes, and starts and ends in bytes of the row (empty unless places). separator: SPACES or MARKS."""
    released()
    data, ends = flat(column)
    row, rows = 0, len(ends) - 1
    none = np.zeros(0, np.int64)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, side="right")) - 1)
        lo, hi = int(ends[row]), int(ends[last])
        if hi - lo <= 2 * PIECE:
            hashes, starts, stops = _piece(data[lo:hi], ends[row : last + 1] - lo, separator)
            at = np.searchsorted(starts, ends[row : last + 1] - lo)
            if places:
                base = np.repeat(ends[row:last] - lo, np.diff(at))
                starts, stops = starts - base, stops - base
        else:
            parts, cut = [], lo
            while cut < hi:
                stop = min(cut + PIECE, hi)
                if stop < hi:
                    gaps = np.flatnonzero(separator[data[cut:stop]])
                    while not len(gaps) and stop < hi:
                        wider = min(stop + PIECE, hi)
                        gaps = np.flatnonzero(separator[data[stop:wider]]) + (stop - cut)
                        stop = wider
                    stop = cut + int(gaps[-1]) + 1 if len(gaps) and stop < hi else stop
                h, s, e = _piece(data[cut:stop], none, separator)
                parts.append((h, s + (cut - lo), e + (cut - lo)))
                cut = stop
            hashes, starts, stops = (np.concatenate(x) for x in zip(*parts))
            at = np.array([0, len(hashes)])
        yield row, at, hashes, (starts if places else none), (stops if places else none)
        row = last


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted; with fewer words than size the whole sequence is one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mix(total + np.uint64(width)))
