"""Operator 5: n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set is its distinct word shingles, as 64-bit hashes. Two sets link when their Jaccard
similarity reaches THRESHOLD. Equal sets are one class from the start, known by a 64-bit digest of
the set. The rest goes in two steps:

1. Near copies. Each class is dealt to a tile by each of BANDS minima of its set under different
   orders; in a tile it is compared with the tile's smallest class alone. Large groups of near
   copies so become one component without a pair within them being listed.
2. All other links. By the prefix principle, two sets that link share a shingle among the first
   |A| - ceil(t |A|) + 1 of each, in any common order. The order is by how many prefixes hold a
   shingle, in powers of two, and then by hash. Only shingles that prefixes of several components share
   make tiles, and of tiles with the same members one stays. Tiles are (shingle, size band): a band
   ends where a set could no longer link with the band's smallest, so that a set meets its own band
   and is a guest in the one below. Classes of one component don't meet. No link is lost: any order
   gives the principle, and every pair that is skipped lies in one component already.

Candidates are pruned by size, then by bitmaps: each element flips one bit of a bitmap that has at
least BITS_EACH bits for each, so that bits that differ are no more than the elements outside the
intersection: |A and B| <= (|A| + |B| - popcount(b_A xor b_B)) / 2. A larger bitmap is folded to the smaller's
size. A pair that passes counts in the largest of its tiles only. Members of such pairs get their
sorted arrays, whose intersection decides; a tile gives at most as many edges as it has members, since
pairs that are already connected are skipped.

Nothing is gathered that grows with a group. A tile of more than MOST members or WEIGHT shingles is
dealt out as pairs of blocks. A batch sends at most two components for a shingle to the search for
shared shingles. The list of frequent shingles is broadcast up to HOT entries, the most frequent first;
it only orders shingles. The list of shared shingles is broadcast up to LISTED entries, beyond which
prefixes are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import components, dropped, stored

#: Words of a shingle; similarity as a fraction.
SIZE, TOP, BOTTOM = 5, 3, 4
#: Minima that deal a set to tiles in step 1.
BANDS = 6
#: Prefix occurrences that make a shingle frequent, and most entries of the broadcast list of such.
FREQUENT, HOT = 3, 1 << 22
#: Most entries of the broadcast list of shingles that several components share.
LISTED = 1 << 22
#: Bits of a bitmap for each element of the set, before rounding up to a power of two; least bits.
BITS_EACH, LEAST_BITS = 4, 64
#: Members of a block of a tile, and shingles of its sets, about.
MOST, WEIGHT = 4096, 1 << 21

_LONGS = pa.list_(pa.int64())


def _bands() -> np.ndarray:
    """The smallest size of each band: sizes of a link are of one band or of neighbouring ones."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(BOTTOM * least[-1] // TOP + 1)
    return np.array(least)


_LEAST = _bands()


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEAST, n, side="right") - 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough: TOP / BOTTOM of the union, by exact intersection."""
    if not len(a) or not len(b) or TOP * max(len(a), len(b)) > BOTTOM * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return BOTTOM * both >= TOP * (len(a) + len(b) - both)


def bitmap(sets: np.ndarray) -> np.ndarray:
    """The hashed bitmap of a set, as words of 64 bits: each element flips its bit."""
    size = max(LEAST_BITS, 1 << int(BITS_EACH * len(sets) - 1).bit_length())
    at = ((sets >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1 == 1, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps in rows brought to fewer words, a power of two."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def prefix_length(n: int) -> int:
    return n - -(-TOP * n // BOTTOM) + 1


def _sets(column: pa.Array):
    """The sorted shingle set of each text."""
    for _, at, hashes, _, _ in kernel.words(column):
        for k in range(len(at) - 1):
            yield kernel.shingles(hashes[at[k] : at[k + 1]], SIZE)


def _digest(s: np.ndarray) -> int:
    return int(kernel.mix(kernel.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


_TURNS = np.array([pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1 for k in range(BANDS)], dtype=np.uint64)


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, n, id, minima, bits): the size, digest, band minima and bitmap of each row's set; minima and bits of empty sets are empty."""

    def run(batches):
        for batch in batches:
            n, ids, minima, bits = [], [], [], []
            for s in _sets(batch.column(1)):
                n.append(len(s))
                ids.append(_digest(s))
                minima.append(np.array([(s * t).min() for t in _TURNS], dtype=np.uint64).view(np.int64) if len(s) else [])
                bits.append(bitmap(s).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(minima, _LONGS), pa.array(bits, _LONGS)], ["key", "n", "id", "minima", "bits"])

    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n bigint, id bigint, minima array<bigint>, bits array<bigint>")


#: Most bits of the filter that keeps sets nobody asked for from being shuffled.
_FILTER = 1 << 27


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column key, with two bits a key, as words of 64 bits; sized by the number of keys, up to _FILTER."""
    size = min(_FILTER, 1 << max(12, (16 * keys.count()).bit_length()))
    slots = keys.select(F.explode(F.array(F.xxhash64("key"), F.xxhash64("key", F.lit(1)))).alias("h")).select(F.pmod("h", F.lit(size)).alias("s"))
    words = slots.select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()  # at most _FILTER / 64 rows
    table = np.zeros(size // 64, dtype=np.uint64)
    table[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return table


def _packed(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """Rows (id, set) of the wanted classes (id, key): packed sorted sets, one row each. Rows of other keys are dropped where they are read, as far as the filter knows them."""
    table = _filter_of(wanted.select("key").distinct())
    shared, size = df.sparkSession.sparkContext.broadcast(table), len(table) * 64

    def run(batches):
        table = shared.value
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for k in (1, 2):
                s = batch.column(k).to_numpy().astype(np.uint64)
                keep &= (table[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
            sets = list(_sets(batch.column(0).filter(pa.array(keep))))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    slots = [F.pmod(F.xxhash64("key"), F.lit(size)).alias("s1"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(size)).alias("s2")]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null").select("text", *slots)
    found = rows.mapInArrow(run, "id bigint, set binary").join(wanted.select("id"), "id", "left_semi")
    return found.groupBy("id").agg(F.first("set").alias("set"))


def verified(df: DataFrame, key: str, text: str, pairs: DataFrame, ones: DataFrame) -> DataFrame:
    """Of distinct pairs (src, dst) of classes, those that link: by their bitmaps if of one size, then by their sets."""
    bits = ones.select("id", "n", "bits")
    near = pairs.join(bits.toDF("src", "n1", "bits1"), "src").join(bits.toDF("dst", "n2", "bits2"), "dst")
    differing = F.when(F.size("bits1") == F.size("bits2"), F.aggregate(F.zip_with("bits1", "bits2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)).otherwise(0)
    # |A and B| >= TOP / (TOP + BOTTOM) (|A| + |B|), and |A and B| <= (|A| + |B| - differing) / 2
    near = near.where((BOTTOM + TOP) * (F.col("n1") + F.col("n2") - differing) >= 2 * TOP * (F.col("n1") + F.col("n2")))
    near = stored(near.select("src", "dst"))
    wanted = ones.select("id", "key").join(near.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    sets = _packed(df, key, text, wanted)
    both = near.join(sets.toDF("src", "set1"), "src").join(sets.toDF("dst", "set2"), "dst")

    def run(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    found = stored(both.select("src", "dst", "set1", "set2").mapInArrow(run, "src bigint, dst bigint"))
    dropped(near)
    return found


def near_copies(ones: DataFrame) -> DataFrame:
    """Step 1: distinct pairs (src, dst) of a class and the smallest class of one of its tiles, where sizes allow a link."""
    tiles = ones.select("id", "n", F.posexplode("minima").alias("band", "value"))
    hubs = tiles.groupBy("band", "value").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("band", "value", "hub")
    pairs = tiles.join(hubs, ["band", "value"]).where("hub.id <> id")
    fit = TOP * F.greatest("n", "hub.n") <= BOTTOM * F.least("n", "hub.n")
    return pairs.where(fit).select(F.col("id").alias("src"), F.col("hub.id").alias("dst")).distinct()


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def frequent(df: DataFrame, text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that FREQUENT prefixes hold, a third more than a prefix counted, and their levels, the binary
    logarithms of how many do: sorted, at most HOT, the lowest levels left out beyond that."""

    def deal(batches):
        for batch in batches:
            heads = [s[: prefix_length(len(s)) * 4 // 3 + 2] for s in _sets(batch.column(0))]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *heads]), return_counts=True)
            at = np.searchsorted(_buckets(keys, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            cut = [slice(at[b], at[b + 1]) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([keys[c].tobytes() for c in cut], pa.binary()), pa.array([n[c].astype(np.int32).tobytes() for c in cut], pa.binary())], ["bucket", "keys", "counts"])

    def count(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        keys, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, weights=np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32), minlength=len(keys)).astype(np.int64)
        keys, n = keys[n >= FREQUENT], n[n >= FREQUENT]
        return pa.table({"key": keys.view(np.int64), "n": n})

    counted = stored(df.select(text).mapInArrow(deal, "bucket bigint, keys binary, counts binary").groupBy("bucket").applyInArrow(count, "key bigint, n bigint"))
    level = F.floor(F.log2("n")).cast("int")
    least, total = 64, 0
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 64 rows
        total += row["count"]
        if total > HOT:
            break
        least = row["level"]
    found = counted.where(level >= least).select("key", level.alias("level")).toArrow()  # at most HOT rows
    keys, levels = found["key"].to_numpy().view(np.uint64), found["level"].to_numpy().astype(np.uint8)
    order = np.argsort(keys)
    dropped(counted)
    return keys[order], levels[order]


def prefixes(df: DataFrame, key: str, text: str, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (id, prefix), one for each class: the packed first shingles, rare ones by hash and then frequent ones by level and hash."""
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot, levels = shared.value
        for batch in batches:
            ids, out = [], []
            for s in _sets(batch.column(0)):
                if not len(s):
                    continue
                ids.append(_digest(s))
                size = prefix_length(len(s))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[np.argsort(np.where(hot[at] == s, levels[at], 0), kind="stable")]
                out.append(s[:size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "prefix"])

    return df.where(F.col(key).isNotNull()).select(text).mapInArrow(run, "id bigint, prefix binary").groupBy("id").agg(F.first("prefix").alias("prefix"))


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of packed rows one after another, and the row of each."""
    lists = [np.frombuffer(p.as_py(), np.uint64) for p in column]
    return np.concatenate([np.zeros(0, np.uint64), *lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _extremes(shingles: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle its smallest component and, if it has several, its largest: sorted by shingle."""
    order = np.lexsort((comps, shingles))
    shingles, comps = shingles[order], comps[order]
    change = shingles[1:] != shingles[:-1]
    first, last = np.concatenate([[True], change]), np.concatenate([change, [True]])
    again = last & ~first  # not alone
    if len(again):
        start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again &= comps != comps[start]
    keep = first | again
    return shingles[keep], comps[keep]


def shared_shingles(heads: DataFrame, buckets: int) -> DataFrame:
    """Rows (shingles), packed: those in prefixes of several components, from rows (id, comp, n, prefix)."""

    def deal(batches):
        for batch in batches:
            shingles, row = _opened(batch.column(1))
            if not len(shingles):
                continue
            shingles, comps = _extremes(shingles, batch.column(0).to_numpy()[row])
            order = np.lexsort((comps, bucket := _buckets(shingles, buckets)))
            shingles, comps, bucket = shingles[order], comps[order], bucket[order]
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(at)):
                own, counts = np.unique(comps[at[b] : at[b + 1]], return_counts=True)
                out.append((b, own.tobytes(), counts.astype(np.int32).tobytes(), shingles[at[b] : at[b + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), *[pa.binary()] * 3))], ["bucket", "comps", "counts", "shingles"])

    def meet(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batch by batch, so that a shingle waits with two components at most."""
        shingles, comps = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting = []
        def joined():
            return (np.concatenate(x) for x in zip((shingles, comps), *waiting))
        for batch in batches:
            for c, n, s in zip(*(batch.column(k).to_pylist() for k in ("comps", "counts", "shingles"))):
                waiting.append((np.frombuffer(s, np.uint64), np.repeat(np.frombuffer(c, np.int64), np.frombuffer(n, np.int32))))
            if sum(len(s) for s, _ in waiting) > max(1 << 19, len(shingles)):
                shingles, comps = _extremes(*joined())
                waiting = []
        shingles, comps = _extremes(*joined())
        some = np.unique(shingles[1:][shingles[1:] == shingles[:-1]])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()])], ["shingles"])

    dealt = heads.select("comp", "prefix").mapInArrow(deal, "bucket bigint, comps binary, counts binary, shingles binary")
    return dealt.groupBy("bucket").applyInArrow(_iterated(meet), "shingles binary")


def _iterated(function):
    """The function with the annotations by which applyInArrow knows that it streams batches."""
    function.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return function


def memberships(heads: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (h, id, comp, n, band): the shared shingles of each class's prefix."""
    listed = shared.select((F.octet_length("shingles") / 8).cast("long").alias("c")).agg(F.sum("c")).first()[0] or 0
    if listed <= LISTED:
        found = shared.toArrow()["shingles"].to_pylist()
        known = heads.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(found), np.uint64)))
    else:
        known = None

    def run(batches):
        for batch in batches:
            shingles, row = _opened(batch.column(3))
            if known is not None:
                at = np.minimum(np.searchsorted(known.value, shingles), max(len(known.value) - 1, 0))
                some = known.value[at] == shingles if len(known.value) else np.zeros(len(shingles), dtype=bool)
                shingles, row = shingles[some], row[some]
            ids, comps, n = (batch.column(k).to_numpy()[row] for k in range(3))
            for lo in range(0, max(len(row), 1), 1 << 20):
                part = slice(lo, lo + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (shingles.view(np.int64), ids, comps, n, band_of(n).astype(np.int32))], ["h", "id", "comp", "n", "band"])

    rows = heads.select("id", "comp", "n", "prefix").mapInArrow(run, "h bigint, id bigint, comp bigint, n bigint, band int")
    if known is not None:
        return rows

    def opened(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_opened(batch.column(0))[0].view(np.int64))], ["h"])

    return rows.join(shared.mapInArrow(opened, "h bigint"), "h")


def distinct_tiles(rows: DataFrame) -> DataFrame:
    """Of rows (h, id, ...) those of one shingle for each set of members, with a column code: larger for tiles with more members."""
    of = rows.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = of.groupBy("m", "x", "y").agg(F.min("h").alias("h"))
    code = F.shiftleft(F.least("m", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.shiftrightunsigned("h", 21))
    return rows.join(one.select("h", code.alias("code")), "h")


def tiles(rows: DataFrame) -> DataFrame:
    """Rows (task, side, same, own, id, comp, n, code): the members of each pair of blocks of each tile where several components meet."""
    both = rows.withColumn("own", F.lit(True)).union(rows.withColumns({"band": F.col("band") - 1, "own": F.lit(False)}))
    blocks = F.ceil(F.greatest(F.count("*") / MOST, F.sum("n") / WEIGHT)).cast("int")
    met = both.groupBy("h", "band").agg(F.count_if("own").alias("owned"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("g"))
    placed = both.join(met.where("owned > 0 and lo < hi").select("h", "band", "g"), ["h", "band"])
    placed = placed.withColumn("x", F.pmod(F.xxhash64("id", F.lit(2)), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    i, j = F.least("x", "j"), F.greatest("x", "j")
    return placed.select(F.xxhash64("h", "band", i, j).alias("task"), (F.col("x") != i).alias("side"), (i == j).alias("same"), "own", "id", "comp", "n", "code")


#: Members of the largest task that is compared together with others of its size; pairs that are compared at once.
_SMALL, _AT_ONCE = 64, 1 << 20


def _pairs(task: np.ndarray, side: np.ndarray, same: np.ndarray, own: np.ndarray, comp: np.ndarray, n: np.ndarray):
    """Candidate pairs (a, b) of rows sorted by task, as arrays: those of tasks of equal size together, those of large ones in blocks."""

    def fitting(a, b):
        ok = (comp[a] != comp[b]) & (own[a] | own[b]) & (same[a] | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        ok = TOP * np.maximum(n[a], n[b]) <= BOTTOM * np.minimum(n[a], n[b])
        return a[ok], b[ok]

    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(task))
    count = ends - starts
    for m in np.unique(count[count <= _SMALL]).tolist():
        at = starts[count == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, _AT_ONCE // max(len(i), 1))
        for lo in range(0, len(at), step):
            own_at = at[lo : lo + step, None]
            yield fitting((own_at + i).ravel(), (own_at + j).ravel())
    for start, end in zip(starts[count > _SMALL].tolist(), ends[count > _SMALL].tolist()):
        members = np.arange(start, end)
        names, back, size = np.unique(comp[start:end], return_inverse=True, return_counts=True)
        main = back == np.argmax(size)  # the members of the largest component don't meet each other
        few, rest = members[~main], members[main]
        step = max(1, _AT_ONCE // max(len(members), 1))
        for lo in range(0, len(few), step):
            some = few[lo : lo + step]
            yield fitting(np.repeat(some, len(rest)), np.tile(rest, len(some)))
            left = few[lo:]
            a, b = np.repeat(some, len(left)), np.tile(left, len(some))
            yield fitting(a[a < b], b[a < b])


def _passing(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Which pairs aren't ruled out by their bitmaps."""
    size = np.array([len(x) for x in bits], dtype=np.int64)
    least = np.minimum(size[a], size[b])
    ok = np.zeros(len(a), dtype=bool)
    for words in np.unique(least).tolist():
        at = np.flatnonzero(least == words)
        used, back = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        step = max(1, (1 << 21) // words)
        rows = np.empty((len(used), words), dtype=np.uint64)
        for k, u in enumerate(used.tolist()):
            rows[k] = folded(bits[u], words)
        left, right = back[: len(at)], back[len(at) :]
        for lo in range(0, len(at), step):
            x, y = left[lo : lo + step], right[lo : lo + step]
            differing = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)
            both = n[used[x]] + n[used[y]]
            ok[at[lo : lo + step]] = (BOTTOM + TOP) * (both - differing) >= 2 * TOP * both
    return ok


def _counting_here(a: np.ndarray, b: np.ndarray, task: np.ndarray, code: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """Which pairs have no larger tile in common than that of their task; codes: the sorted tiles of each row."""
    order = np.argsort(task[a], kind="stable")
    own = task[a][order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    ok = np.ones(len(a), dtype=bool)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
        at = order[start:end]
        used, back = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        larger = [codes[u][np.searchsorted(codes[u], code[u], side="right") :] for u in used.tolist()]
        names, place = np.unique(np.concatenate(larger), return_inverse=True)
        holds = np.zeros((len(used), -(-max(len(names), 1) // 64) * 64), dtype=bool)
        holds[np.repeat(np.arange(len(used)), [len(x) for x in larger]), place] = True
        holds = np.packbits(holds, axis=1).view(np.uint64)
        step = max(1, (1 << 20) // holds.shape[1])
        for lo in range(0, len(at), step):
            x, y = back[: len(at)][lo : lo + step], back[len(at) :][lo : lo + step]
            ok[at[lo : lo + step]] = ~(holds[x] & holds[y]).any(axis=1)
    return ok


_MEMBER = "task bigint, side boolean, same boolean, own boolean, id bigint, comp bigint, n bigint"
_FIELDS = [c.split()[0] for c in _MEMBER.split(", ")]


def _members(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.take(pa.array(np.argsort(table["task"].to_numpy(), kind="stable"))).combine_chunks()
    return table, [table[c].to_numpy() for c in ("task", "side", "same", "own", "comp", "n")]


def _lists(column) -> list[np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return [flat[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def surviving(table: pa.Table) -> pa.Table:
    """The members (task, ..., n, code, bits, codes) of pairs that count in their task and that their bitmaps don't rule out; without code and lists."""
    table, fields = _members(table)
    bits, codes, code = [x.view(np.uint64) for x in _lists(table["bits"])], _lists(table["codes"]), table["code"].to_numpy()
    keep = np.zeros(len(table), dtype=bool)
    for a, b in _pairs(*fields):
        if len(a):
            ok = _passing(a, b, fields[-1], bits)
            a, b = a[ok], b[ok]
        if len(a):
            ok = _counting_here(a, b, fields[0], code, codes)
            keep[a[ok]] = keep[b[ok]] = True
    return table.select(_FIELDS).filter(pa.array(keep))


def edges_of(table: pa.Table) -> pa.Table:
    """The edges (src, dst) that connect the members (task, ..., n, set) by links: no more than members."""
    table, fields = _members(table)
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    bits, ids = [bitmap(s) for s in sets], table["id"].to_numpy()
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    out, task, comp = [], fields[0], fields[4]
    for a, b in _pairs(*fields):
        ok = _passing(a, b, fields[-1], bits) if len(a) else np.zeros(0, dtype=bool)
        for x, y in zip(a[ok].tolist(), b[ok].tolist()):
            p, q = root((int(task[x]), int(comp[x]))), root((int(task[y]), int(comp[y])))
            if p != q and linked(sets[x], sets[y]):
                up[p] = q
                out.append((int(ids[x]), int(ids[y])))
    return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})


def _dealt(rows: DataFrame, each: int) -> DataFrame:
    """Rows with a column bucket: whole tasks, as many together as hold about so many shingles or 1 / 64 as many members."""
    w, m = rows.agg(F.sum("n"), F.count("*")).first()
    return rows.withColumn("bucket", F.pmod("task", F.lit(int(max(12, (w or 0) // each, m // (each // 64))))))


def other_links(df: DataFrame, key: str, text: str, heads: DataFrame, ones: DataFrame, buckets: int) -> DataFrame:
    """Step 2: edges (src, dst) that connect components wherever a link does, from rows (id, comp, n, prefix)."""
    shared = stored(shared_shingles(heads, buckets))
    members = stored(distinct_tiles(stored(memberships(heads, shared))))
    placed = stored(tiles(members))
    known = ones.select("id", "bits").join(members.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes")), "id")  # as many as its prefix has
    kept = stored(_dealt(placed, 1 << 22).join(known, "id").groupBy("bucket").applyInArrow(surviving, _MEMBER))
    wanted = ones.select("id", "key").join(kept.select("id").distinct(), "id", "left_semi")
    found = stored(_dealt(kept, 1 << 21).join(_packed(df, key, text, wanted), "id").groupBy("bucket").applyInArrow(edges_of, "src bigint, dst bigint"))
    for x in (shared, members, placed, kept):
        dropped(x)
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id), one for each row of df.

    component_id is the smallest key that links reach, the row's own included; keys are of any type
    that has an order. Rows without words or text have n_shingles 0 and link with nothing. Each row has
    its own set: rows that repeat a key with other texts are in several components, and name each of
    them. A null key is no component's name and carries over what its text links to, or null.
    """
    signs = stored(signed(df, key, text))
    ones = stored(signs.where("n > 0 and key is not null").groupBy("id").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("bits").alias("bits")))
    edges = verified(df, key, text, near_copies(ones), ones)
    first = stored(components(edges))
    total = ones.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(12, total // 1_000_000))
    heads = prefixes(df, key, text, frequent(df, text, buckets)).join(ones.select("id", "n"), "id").join(first.toDF("id", "comp"), "id", "left")
    heads = stored(heads.select("id", F.coalesce("comp", "id").alias("comp"), "n", "prefix"))
    more = other_links(df, key, text, heads, ones, buckets)
    found = stored(components(edges.union(more)))
    named = ones.select("id", "key").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("comp"))
    least = named.join(named.groupBy("comp").agg(F.min("key").alias("least")), "comp").select("id", "least")
    for x in (edges, first, heads, more):
        dropped(x)
    out = signs.select("key", "n", "id").join(least, "id", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each component, that with the smallest key; rows that repeat it once. Null keys stay."""
    keep = near_duplicates(df, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = df.join(keep, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(df.where(F.col(key).isNull())).select(df.columns)
