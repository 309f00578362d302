"""Operator 6: embedding near-dedup by collision-counting projections.

Every distinct vector of a label, brought to length one, is projected on LINES random directions. Two
vectors collide on a line if their projections are at most WINDOW apart: a window centred on
the query, in the sorted order of the line. Pairs that collide on at least COUNT lines are verified
by their cosine in double precision. For unit vectors with cosine 0.98 the difference of two
projections is normal with deviation sqrt(2 - 2 * 0.98) = 0.2, so that WINDOW is 2.5 deviations and
a pair misses a line with probability 0.0124; more than LINES - COUNT misses are rarer than 1e-5.

PIVOTS lines, more than a pair may miss, bring pairs together: a pair that can pass collides on one of
them at least, and is counted on the first of those. Each of them is sorted, label by label, by counting the vectors of
narrow cells of the line, and cut into blocks of about BLOCK neighbours; blocks that are within a window of each
other meet in a task, which counts the collisions of their pairs on all lines. A cell with more
vectors than a block is dealt to several blocks.

Equal vectors are one class from the start, whatever their number. A task returns the links of each
of its classes as a number, and the edges that connect those which link, no more than it has classes: pairs
aren't listed. Work within a label still grows with the square of its number of different vectors,
times the share of them that a window holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, dropped, stored

#: Least cosine of a link.
COSINE = 0.98
#: Random directions, the collisions that a pair needs, and the lines that bring pairs together: one more than a pair may miss.
LINES, COUNT, PIVOTS = 25, 21, 5
#: Half the width of a query-centred window, for projections of unit vectors on directions with normal entries.
WINDOW = 0.5
#: Width of the cells by which a line is sorted, and vectors of a block, about.
CELL, BLOCK = 1 / 64, 1024
SEED = 20


def unit_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (key, label, size, unit, lines) of the vectors that can link: not null, without null or non-finite
    components, not zero, with a label. lines: the projections."""
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull())

    def run(batches):
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            holes = np.asarray(flat.is_null())
            flat = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                at = (ends[own] - size)[:, None] + np.arange(size)
                x = flat[at]
                good = np.isfinite(x).all(axis=1) & x.any(axis=1) & ~holes[at].any(axis=1)
                own, x = own[good], x[good]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                if size not in directions:
                    directions[size] = np.random.default_rng([SEED, size]).standard_normal((LINES, size))
                lines = np.stack([(x * d).sum(axis=1) for d in directions[size]], axis=1).astype(np.float32)  # a row's sums don't depend on its batch
                some = batch.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(len(own), size, np.int32)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(lines), pa.list_(pa.float32()))], ["key", "label", "size", "unit", "lines"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    return rows.select(F.col(key), F.col(label), F.col(vector).cast("array<double>")).mapInArrow(run, f"key {kinds[key]}, label {kinds[label]}, size int, unit array<double>, lines array<float>")


def _meetings(ones: DataFrame) -> DataFrame:
    """Rows (task, line, same, side, id, copies, unit, lines): the classes of two blocks of a line that are within a window of each other."""
    pivots = F.posexplode(F.slice("lines", 1, PIVOTS)).alias("line", "p")
    placed = ones.select("id", "label", "size", pivots).withColumn("cell", F.floor(F.col("p") / CELL).cast("int"))
    cells = placed.groupBy("label", "size", "line", "cell").agg(F.count("*").alias("n"))
    along = W.partitionBy("label", "size", "line").orderBy("cell")  # one row for each cell of a line, a few hundred
    cells = cells.withColumn("block", F.floor((F.sum("n").over(along) - F.col("n")) / BLOCK)).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = stored(cells)
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).groupBy("label", "size", "line", "block", "part").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    blocks = stored(blocks.withColumn("name", F.xxhash64("label", "size", "line", "block", "part")))
    a, b = (blocks.select("label", "size", "line", *(F.col(c).alias(f"{c}{k}") for c in ("name", "low", "high"))) for k in (1, 2))
    reach = int(WINDOW / CELL) + 1
    near = (F.col("name1") <= F.col("name2")) & (F.col("low2") - F.col("high1") <= reach) & (F.col("low1") - F.col("high2") <= reach)
    pairs = a.join(b, ["label", "size", "line"]).where(near).withColumn("task", F.xxhash64("name1", "name2"))
    same = F.col("name1") == F.col("name2")
    sides = pairs.select("task", same.alias("same"), F.explode(F.when(same, F.array(F.struct(F.col("name1").alias("name"), F.lit(False).alias("side")))).otherwise(F.array(F.struct(F.col("name1").alias("name"), F.lit(False).alias("side")), F.struct(F.col("name2").alias("name"), F.lit(True).alias("side"))))).alias("s")).select("task", "same", "s.*")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    named = placed.join(cells, ["label", "size", "line", "cell"]).select("id", "line", F.xxhash64("label", "size", "line", "block", part).alias("name"))
    return named.join(sides, "name").drop("name").join(ones.select("id", "copies", "unit", "lines"), "id")


def counted(table: pa.Table) -> pa.Table:
    """Of the tasks in a table: rows (id, n) with the numbers of vectors that classes link with, and rows (src, dst) of edges that connect those that link."""
    task = table["task"].to_numpy()
    table = table.take(pa.array(np.argsort(task, kind="stable"))).combine_chunks()
    task, ids, copies, side = (table[c].to_numpy() for c in ("task", "id", "copies", "side"))
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    out_id, out_n, edges = [], [], []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(task)]):
        part = table.slice(start, end - start)
        lines, unit = (np.stack(part[c].to_numpy()) for c in ("lines", "unit"))
        line, left = part["line"][0].as_py(), np.flatnonzero(~side[start:end])
        right = left if part["same"][0].as_py() else np.flatnonzero(side[start:end])
        n, group = np.zeros(end - start, np.int64), np.arange(end - start)
        right = right[np.argsort(lines[right, line], kind="stable")]  # windows of the pivot line
        low = np.searchsorted(lines[right, line], lines[left, line] - np.float32(WINDOW), side="left")
        high = np.searchsorted(lines[right, line], lines[left, line] + np.float32(WINDOW), side="right")
        order = np.argsort(lines[left, line], kind="stable")
        for k in range(0, len(order), 128):
            rows = left[order[k : k + 128]]
            others = right[low[order[k : k + 128]].min() : high[order[k : k + 128]].max()]
            hits = np.zeros((len(rows), len(others)), np.int8)
            first = np.ones(hits.shape, dtype=bool)
            for x in range(LINES):
                close = np.abs(lines[rows, x][:, None] - lines[others, x][None, :]) <= WINDOW
                hits += close
                if x <= line:  # counted on the first pivot line on which they collide
                    first &= close if x == line else ~close
            i, j = np.nonzero(first & (hits >= COUNT))
            i, j = rows[i], others[j]
            if left is not None and part["same"][0].as_py():
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), 1 << 14):
                a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                ok = (unit[a] * unit[b]).sum(axis=1) >= COSINE
                a, b = a[ok], b[ok]
                np.add.at(n, a, copies[start + b])
                np.add.at(n, b, copies[start + a])
                while (apart := group[a] != group[b]).any():  # as often as groups become one
                    a, b = a[apart], b[apart]
                    group[group == group[a[0]]] = group[b[0]]
                    edges.append((int(ids[start + a[0]]), int(ids[start + b[0]])))
        some = np.flatnonzero(n)
        out_id += ids[start + some].tolist()
        out_n += n[some].tolist()
    none = [None] * len(edges)
    return pa.table({"id": pa.array(out_id + none, pa.int64()), "n": pa.array(out_n + none, pa.int64()), "src": pa.array([None] * len(out_id) + [x for x, _ in edges], pa.int64()), "dst": pa.array([None] * len(out_id) + [y for _, y in edges], pa.int64())})


def links(ones: DataFrame) -> DataFrame:
    """Rows (id, n), parts of the numbers of vectors that a class links with, and rows (src, dst) of edges that connect the classes (id, label, size, copies, unit, lines) whose cosine is high enough."""
    buckets = int(max(12, ones.count() * PIVOTS // 4096))
    dealt = _meetings(ones).withColumn("bucket", F.pmod("task", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(counted, "id bigint, n bigint, src bigint, dst bigint")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of df.

    n_links counts the other vectors of the label that link directly, equal ones included. A vector that
    can't link has none and is its own component. Rows that repeat a key count each, but not as
    links of each other's key, and are named by the smallest of their components; a null key links with
    nothing. Keys are of any type that has an order.
    """
    vectors = stored(unit_vectors(df, key, vector, label).withColumn("id", F.xxhash64("label", F.md5(F.array_join(F.transform("unit", lambda x: x.cast("string")), ",")))))
    ones = stored(vectors.groupBy("id").agg(F.min("key").alias("key"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("label", "size", "unit", "lines"))))
    found = stored(links(ones))
    n = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    stars = components(found.where("id is null").select("src", "dst"))
    known = ones.select("id", "key", "copies").join(n, "id", "left").join(stars.toDF("id", "component"), "id", "left")
    known = known.select("id", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    named = known.join(known.groupBy("component").agg(F.min("key").alias("least")), "component").select("id", "n", "least")
    members = vectors.select("key", "id").distinct().join(named, "id").groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    members = stored(members)
    for x in (vectors, ones, found):
        dropped(x)
    out = df.select(F.col(key).alias("key")).join(members, "key", "left")
    component = F.coalesce("least", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
