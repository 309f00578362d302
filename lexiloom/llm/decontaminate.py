"""Operator 4: benchmark decontamination by greedy string tiling.

Seeds are the runs of ``TILE`` words of a benchmark item. A document that shares a seed with an item
is tiled against it: running Karp-Rabin hashes of its words are joined with the sorted seeds, shared
seeds that follow each other in both are one match, and the longest matches of unmarked words are
marked again and again until none of TILE words is left.
The share of the item's words that tiles cover doesn't depend on their order, so that a passage
whose sentences were moved is caught too.

Scale: one map-only pass over the documents. The benchmark is shipped to the tasks, in blocks of at
most ``BLOCK_WORDS`` words: its size is checked, and a larger one takes a pass for each block.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel

#: Words of the shortest tile, and the least share of an item's words that tiles must cover.
TILE, COVERAGE = 5, 0.5
#: Words of the benchmark that are shipped to tasks at once.
BLOCK_WORDS = 2_000_000


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the words from each place on, running over the text."""
    n = len(hashes) - size + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        total += hashes[k : k + n] * kernel._PLACE[k]
    return kernel.mix(total)


#: Shared seeds that are held at once.
AT_ONCE = 1 << 20


class Benchmark:
    """Items as word hashes, and their sorted seeds. Items shorter than a tile are one seed; items without words match nothing."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = {i: h for i, h in items if len(h)}
        self.seeds = {}
        for size in sorted({min(TILE, len(h)) for h in self.items.values()}):
            runs = {i: _runs(h, size) for i, h in self.items.items() if min(TILE, len(h)) == size}
            keys = np.concatenate(list(runs.values()))
            item = np.repeat(np.array(list(runs), np.int64), [len(r) for r in runs.values()])
            place = np.concatenate([np.arange(len(r)) for r in runs.values()])
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(1 << 20, dtype=bool)
            marks[keys >> np.uint64(44)] = True
            self.seeds[size] = keys[order], item[order], place[order], marks

    def matches(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each item that shares a seed with a text: (start in text, start in item, words) of the matches that can't be made longer."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for size, (keys, items, places, marks) in self.seeds.items():
            runs = _runs(hashes, size)
            at = np.flatnonzero(marks[runs >> np.uint64(44)])
            low, high = np.searchsorted(keys, runs[at], side="left"), np.searchsorted(keys, runs[at], side="right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            ends, waiting, begin = np.cumsum(n), {}, 0
            while begin < len(at):  # parts of the text; a match that reaches the end of one may go on in the next
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + AT_ONCE, side="right")))
                part = slice(begin, stop)
                seed = np.repeat(low[part] - (ends[part] - n[part] - ends[begin] + n[begin]), n[part]) + np.arange(ends[stop - 1] - ends[begin] + n[begin])
                text, item = np.repeat(at[part], n[part]), items[seed]
                shift = text - places[seed]
                order = np.lexsort((text, shift, item))
                text, item, shift = text[order], item[order], shift[order]
                first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (text[1:] != text[:-1] + 1)]))
                last = np.append(first[1:], len(text)) - 1
                open_, waiting = waiting, {}
                for i, d, a, b in zip(item[first].tolist(), shift[first].tolist(), text[first].tolist(), text[last].tolist()):
                    before = open_.pop((i, d), None)
                    if before is not None and before[1] + 1 == a:
                        a = before[0]
                    elif before is not None:
                        found[i].append((before[0], before[0] - d, before[1] - before[0] + size))
                    if b == at[stop - 1]:
                        waiting[i, d] = a, b
                    else:
                        found[i].append((a, a - d, b - a + size))
                for (i, d), (a, b) in open_.items():
                    found[i].append((a, a - d, b - a + size))
                begin = stop
            for (i, d), (a, b) in waiting.items():
                found[i].append((a, a - d, b - a + size))
        return found


def _free(marked: np.ndarray, start: int, n: int) -> np.ndarray:
    return ~marked[start : start + n]


def tiles(text: int, item: int, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling of so many words: (start in text, start in item, words) of non-overlapping matches, the longest first,
    of equal ones the first in the text. matches: all that can't be made longer, of TILE words at least (or all of a shorter item)."""
    least = min(TILE, item)
    marked_text, marked_item, made, left = np.zeros(text, dtype=bool), np.zeros(item, dtype=bool), [], item
    waiting = [(-n, a, b) for a, b, n in matches]
    heapq.heapify(waiting)
    while waiting and left >= least:
        n, a, b = heapq.heappop(waiting)
        free = _free(marked_text, a, -n) & _free(marked_item, b, -n)
        if free.all():
            made.append((a, b, -n))
            marked_text[a : a - n] = marked_item[b : b - n] = True
            left += n
        else:  # the pieces between marked words wait for their turn
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if j - i >= least:
                    heapq.heappush(waiting, (i - j, a + i, b + i))
    return made


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The benchmark's items as word hashes, in blocks of at most BLOCK_WORDS words (or one longer item), each with its id, which may be null or shared; rows without a text are left out."""
    def run(batches):
        for batch in batches:
            rows = [h[at[k] : at[k + 1]].view(np.int64) for _, at, h, _, _ in kernel.words(batch.column(1)) for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"])

    block, size = [], 0
    kind = benchmark.schema[item].dataType.simpleString()
    for row in benchmark.select(item, text).dropna(subset=[text]).mapInArrow(run, f"item {kind}, words array<bigint>").toLocalIterator(prefetchPartitions=False):
        if block and size + len(row.words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.item, np.array(row.words, dtype=np.int64).view(np.uint64)))
        size += len(row.words)
    yield block


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows (key, item, n_tiles, n_covered, n_words, coverage) of the documents that hold at least that share of an item.

    Every row of df counts by itself; null or empty texts and items leak nothing. Every row of
    benchmark is an item by itself, whether its id is null or that of others.
    """
    key_kind, item_kind = df.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    names = [key, item, "n_tiles", "n_covered", "n_words", "coverage"]

    def passed(block):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            ids = [i for i, _ in shared.value]
            known = Benchmark([(n, h) for n, (_, h) in enumerate(shared.value)])
            for batch in batches:
                at_row, rows = [], []
                for row, at, hashes, _, _ in kernel.words(batch.column(1)):
                    for k in range(len(at) - 1):
                        words = hashes[at[k] : at[k + 1]]
                        for i, matches in known.matches(words).items():
                            total = len(known.items[i])
                            made = tiles(len(words), total, matches)
                            covered = sum(n for _, _, n in made)
                            if covered >= coverage * total:
                                at_row.append(row + k)
                                rows.append((ids[i], len(made), covered, total, covered / total))
                keys = batch.column(0).take(pa.array(at_row, pa.int64()))
                item_arrow = pa.array([r[0] for r in rows], item_type)
                rest = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([keys, item_arrow, *rest, pa.array([r[4] for r in rows], pa.float64())], names)

        return df.select(key, text).mapInArrow(run, f"`{key}` {key_kind}, `{item}` {item_kind}, n_tiles bigint, n_covered bigint, n_words bigint, coverage double")

    return reduce(DataFrame.unionAll, map(passed, _blocks(benchmark, item, item_text)))


def decontaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """df without the documents that leak an item; rows with a null key stay."""
    return df.join(leaks(df, benchmark, key).select(F.col(key)).distinct(), key, "left_anti").select(df.columns)
