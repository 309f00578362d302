"""Operator 9: personal data by fixed shapes, widened by bootstrapped contextual extraction.

The base shapes (e-mail, IP address, card and phone number) are seeds. The words around a seed make
its lexical patterns. Every other token that looks like an identifier (it holds a digit or an at
sign) is an instance that occurs under patterns too, so that patterns and instances form a graph.
Spark scores it round by round. A pattern counts once SUPPORT different accepted instances occur
under it; its confidence is their summed confidence over the number of all its instances, smoothed. An
instance's confidence is the largest of its patterns'; from ``THRESHOLD`` on it is accepted and supports patterns
itself in the next round, so that a pattern without any seed comes in through discovered instances. Seeds
are accepted from the start, with 1. Accepted instances become spans of kind "context". Base spans always stay.

Scale: texts are scanned once where they are read, in time linear in their length. Only
identifier-like tokens leave the scan, as hashes with their places; the graph's edges are grouped with
map-side sums, so that a frequent pattern or instance is a number, not a list, wherever it meets. The
discovered spans, few, are joined back by key and a digest of the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

# The shapes of the base kinds, in the order in which spans list them.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Rounds of scoring, smoothing of a pattern's mean, and the least confidence of a discovered instance.
ROUNDS, PRIOR, THRESHOLD = 3, 4.0, 0.6
#: Different accepted instances that a pattern needs: a pattern of one is a quotation, not a context.
SUPPORT = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL, _CARD, _PHONE = (re.compile(p) for p in (EMAIL, CARD, PHONE))
# the same matches as those of IP, which begin where a run of digits does; a run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_SPACES = " \t\n\x0b\x0c\r"
_GAP = re.compile(r"[\x20\x09-\x0D]")
#: Words with a digit or an at sign: looked for where a word begins.
_LIKE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from their at signs: what stands before one may only reach back to the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches by kind as listed, then start; failing matches are dropped and not retried."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, is seed, word before, word after) of the seeds and of the identifier-like tokens that no base span
    touches. Words are lower-cased; '' where the text or a neighbouring instance ends before one."""
    found = sorted((a, b, True) for _, a, b in base)
    taken, k = list(found), 0
    for m in _LIKE.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        token = m[0].rstrip(".,;:!?")
        if sum(c.isdigit() for c in token) >= 4 or "@" in token.strip("@"):
            found.append((start, start + len(token), False))
    found.sort()
    out, done = [], 0
    for k, (start, end, seed) in enumerate(found):
        piece = text[done:start].rstrip(_SPACES)
        before = piece[max(piece.rfind(c) for c in _SPACES) + 1 :]
        done = max(done, end)
        piece = text[end : found[k + 1][0] if k + 1 < len(found) else len(text)].lstrip(_SPACES)
        gap = _GAP.search(piece)
        out.append((start, end, seed, before.lower(), (piece[: gap.start()] if gap else piece).lower()))
    return out


def _scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each text: its key, a digest (mark), counts and base spans, and its instances with their patterns and whether they are seeds."""
    schema = f"key {df.select(key).schema[0].dataType.simpleString()}, mark bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, found {_FOUND}"
    names = ["key", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]

    def run(batches):
        for batch in batches:
            counts, bases, found = [], [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                spans = base_spans(t)
                kinds = [k for k, _, _ in spans]
                counts.append([kinds.count(k) for k in KINDS])
                bases.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                found.append([{"instance": _hash(t[a:b]), "lefts": _hash("<" + left), "rights": _hash(">" + right), "seed": seed, "start": a, "end": b} for a, b, seed, left, right in _instances(t, spans)])
            columns = [batch.column(0), batch.column(2), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(bases, pa.string()), pa.array(found, _FOUND_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(key), F.col(text), _mark(text)).mapInArrow(run, schema)


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def accepted(edges: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Rows (instance, c) of the accepted instances, seeds included, from distinct edges (pattern, instance, seed)."""
    seeds = edges.where("seed").select("instance").distinct().withColumn("c", F.lit(1.0))
    known = seeds
    for _ in range(rounds):
        pattern = (
            edges.join(known, "instance", "left")
            .groupBy("pattern")
            .agg(F.sum("c").alias("good"), F.count("c").alias("support"), F.count("*").alias("n"))
            .where(F.col("support") >= support)
            .select("pattern", (F.col("good") / (F.col("n") + PRIOR)).alias("p"))
            .where(F.col("p") >= threshold)
        )
        new = edges.join(pattern, "pattern").groupBy("instance").agg(F.max("p").alias("c"))
        last, known = known, stored(seeds.union(new.join(seeds, "instance", "left_anti")))
        if last is not seeds:
            dropped(last)
    return known


def discovered(scanned: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Rows (key, mark, start, end) of the accepted instances that aren't seeds.

    A pattern is the word before or the word after an instance.
    """
    at = scanned.select("key", "mark", F.explode("found").alias("f")).select("key", "mark", "f.*")
    edges = stored(at.select("instance", "seed", F.explode(F.array("lefts", "rights")).alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    good = accepted(edges, rounds, threshold, support).select("instance")
    found = stored(at.where(~F.col("seed")).join(good, "instance", "left_semi").select("key", "mark", "start", "end").distinct())
    dropped(edges)
    return found


def _by_text(found: DataFrame, name: str, spans) -> DataFrame:
    """Spans (key, mark, start, end) as one column for each text, beside its key _k and mark _m."""
    return found.groupBy(F.col("key").alias("_k"), F.col("mark").alias("_m")).agg(F.count("*").alias("n_context"), spans(F.array_sort(F.collect_list(F.struct("start", "end")))).alias(name))


_FOUND = "array<struct<instance:bigint,lefts:bigint,rights:bigint,seed:boolean,start:bigint,end:bigint>>"
_FOUND_ARROW = pa.list_(pa.struct([("instance", pa.int64()), ("lefts", pa.int64()), ("rights", pa.int64()), ("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base_sha256, n_context, base, spans), one for each row of df.

    base and spans list kind:start:end, in code points and end exclusive: the base spans by kind as
    listed, then start, and after them in spans the discovered ones by start. A null or empty text
    has none, and base_sha256 is then the digest of the empty string. Keys may be null or repeat: spans
    belong to a key and a text.
    """
    scanned = stored(_scan(df, key, text))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.lit("context:"), s["start"], F.lit(":"), s["end"])), ",")
    new = _by_text(discovered(scanned), "more", listed)
    return scanned.join(new, F.col("key").eqNullSafe(F.col("_k")) & (F.col("mark") == F.col("_m")), "left").select(
        F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"), "base",
        F.concat_ws(",", F.nullif("base", F.lit("")), "more").alias("spans"),
    )


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by the kind in angle brackets.

    Only the few discovered spans are joined to the texts; base spans are found again where they are
    replaced. Spans that overlap become one, named by the first. Null texts stay null. Keys may be
    null or repeat.
    """
    scanned = stored(_scan(df, key, text))
    new = _by_text(discovered(scanned), "spans", lambda spans: spans).select(F.col("_k"), F.col("_m"), F.col("spans").alias("_s"))
    dropped(scanned)
    names = df.columns
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))  # no name clashes with those of the join
    at = f"c{names.index(text)}"
    joined = plain.join(new, F.col(f"c{names.index(key)}").eqNullSafe(F.col("_k")) & (_mark(at) == F.col("_m")), "left").select(*plain.columns, "_s")
    return _cut(joined, at, "_s").toDF(*names)


def _cut(df: DataFrame, text: str, more: str) -> DataFrame:
    """Replace the base spans of the texts and those of the column more, which is dropped."""
    kept = [c for c in df.columns if c != more]
    at, last = kept.index(text), df.columns.index(more)

    def run(batches):
        for batch in batches:
            out = []
            for value, found in zip(batch.column(at), batch.column(last)):
                t, parts, done = value.as_py(), [], 0
                spans = [(a, b, k) for k, a, b in base_spans(t or "")] + [(s["start"], s["end"], "context") for s in found.as_py() or ()]
                for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
                    if a >= done:
                        parts += [t[done:a], f"<{kind}>"]
                    done = max(done, b)
                out.append(t if not spans else "".join(parts) + t[done:])
            columns = [batch.column(k) for k in range(len(kept) + 1) if k != last]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, kept)

    return df.mapInArrow(run, df.select(*kept).schema)
