"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On each level runs of one symbol become one symbol, two rounds of deterministic coin
tossing (the lowest bit in which a symbol differs from the one before, with its value) give every symbol a label below
16, and blocks start where labels have a local minimum. A block's name is a hash of its symbols and is a symbol of the
next level. Labels depend on a few symbols around only, so equal substrings get equal names inside, whatever stands
before them.

A fingerprint sketches the names of levels 2 and 3 (about 10 and 35 characters): 64 bins by the upper bits of a name,
of each bin the smallest name's 16-bit hash. The likeness of two is the share of equal bins among those that either
fills, an estimate of the Jaccard similarity of the two sets of names.

Edge cases: a null or empty text has no names, and two such are alike (1.0); a short text has at least one name per
level; a null doc_id comes last in descending order; rows that share a doc_id follow each other by a hash of their
texts; a single document is its own next; an empty table gives an empty table; only doc_id and text are read, so other
columns cannot clash.

Scale: one shuffle of the texts, by ranges of (doc_id, hash of the text) that hold about `range_rows` rows, whatever ids
there are; their bounds come from a sample of at most `16 * MOST_RANGES` rows. A range is read in order as a stream, so
no group is held; only its first document is sent a second time, to the range before it. Texts are parsed many at a
time, as one vector, up to a bounded number of characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, partitions

BINS, LEVELS, CHARS = 64, (2, 3), 400_000
RANGE_ROWS, MOST_RANGES = 512, 65_536
_U = np.uint64
_EMPTY = 0xFFFFFFFF
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the blocks of the sequences x, which doc tells apart, and the document of each block."""
    new = np.empty(len(x), bool)
    new[0] = True
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if len(at) < len(x):
        length = np.diff(at, append=len(x)).astype(_U)
        doc = doc[at]
        x = np.where(length > 1, _mix(x[at] + length * _U(0x9E3779B97F4A7C15)), x[at])
    first = np.empty(len(x), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    # Round 1: 64-bit symbols to labels below 128; a first symbol has no neighbour and takes its own lowest bits.
    label = np.empty(len(x), np.uint8)
    differ = x[1:] ^ x[:-1]
    k = np.bitwise_count((differ & (~differ + _U(1))) - _U(1))
    label[1:] = (k << 1) | ((x[1:] >> (k & 63).astype(_U)) & _U(1)).astype(np.uint8)
    label[first] = (x[first] & _U(127)).astype(np.uint8)
    # Round 2: to labels below 16.
    tossed = np.empty(len(x), np.uint8)
    d8 = label[1:] ^ label[:-1]
    k = np.minimum(np.bitwise_count((d8 & (~d8 + np.uint8(1))) - np.uint8(1)), 7)
    tossed[1:] = (k << 1) | ((label[1:] >> k) & 1)
    tossed[first] = label[first] & 15
    start = np.empty(len(x), bool)
    start[0] = True
    start[1:] = tossed[1:] < tossed[:-1]
    # A document's last symbol has none after it: what comes next belongs to another.
    start[1:-1] &= (tossed[1:-1] <= tossed[2:]) | first[2:]
    start |= first
    at = np.flatnonzero(start)
    inside = np.arange(len(x)) - np.repeat(at, np.diff(at, append=len(x)))
    named = _mix(x + inside.astype(_U) * _U(0xD1B54A32D192ED03))
    return _mix(np.add.reduceat(named, at)), doc[at]


def _sketch(texts: list[str]) -> np.ndarray:
    """BINS smallest names of each text, _EMPTY where a bin has none."""
    out = np.full(len(texts) * BINS, _EMPTY, np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(_U)
    if len(x):
        x, doc = _mix(x + _U(1)), np.repeat(np.arange(len(texts), dtype=np.int32), size)
        for level in range(1, max(LEVELS) + 1):
            x, doc = _level(x, doc)
            if level in LEVELS:
                place = doc.astype(np.int64) * BINS + (x >> _U(58)).astype(np.int64)
                np.minimum.at(out, place, ((x >> _U(20)) & _U(0xFFFFFFFE)).astype(np.uint32))
    return out.reshape(len(texts), BINS)


def fingerprints(texts: list[str]) -> np.ndarray:
    """uint16 [text, bin]; 0xFFFF: empty."""
    rows, at, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS or i + 1 == len(texts):
            rows.append(_sketch(texts[at : i + 1]))
            at, held = i + 1, 0
    smallest = np.concatenate(rows) if rows else np.zeros((0, BINS), np.uint32)
    hashed = (_mix(smallest.astype(_U)) >> _U(48)).astype(np.uint16)
    return np.where(smallest == _EMPTY, np.uint16(0xFFFF), np.where(hashed == 0xFFFF, np.uint16(0), hashed))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two matrices of fingerprints."""
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    n = filled.sum(1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(1) / np.maximum(n, 1))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(docs: list[int], texts: list[str]) -> pa.RecordBatch:
    """Rows of all documents but the last, each with the one that follows it."""
    prints = fingerprints(texts)
    changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
    changed_prints = fingerprints(changed)
    cols = [
        [None if d == NO_ID else d for d in docs[:-1]], [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        [p.astype(">u2").tobytes().hex() for p in prints[:-1]], [p.astype(">u2").tobytes().hex() for p in changed_prints],
        likeness(prints[:-1], changed_prints), likeness(prints[:-1], prints[1:]),
    ]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _stream(batches):
    """Rows (part, guest, doc, text), in order inside a part, its guest last, to their results; the last document is carried on."""
    at, docs, texts, held = None, [], [], 0
    for batch in batches:
        for part, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc", "text"))):
            if part != at:
                if len(docs) > 1:
                    yield _compared(docs, texts)
                at, docs, texts, held, closed = part, [], [], 0, False
            if closed:
                continue
            docs.append(doc)
            texts.append(text)
            held += len(text)
            closed = guest
            if held >= CHARS or len(docs) > 4096:
                if len(docs) > 1:
                    yield _compared(docs, texts)
                docs, texts, held = docs[-1:], texts[-1:], len(texts[-1])
    if len(docs) > 1:
        yield _compared(docs, texts)


def bounds(ids: DataFrame, range_rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> tuple[np.ndarray, np.ndarray]:
    """Ascending lower bounds (doc, print) of the ranges but the first, from all rows or, if there are many, a sample."""
    n = ids.count()
    ranges = min(most, -(-n // range_rows))
    if ranges < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share = min(1.0, 16 * ranges / n)
    some = sorted(tuple(r) for r in (ids.sample(share, seed=7) if share < 1 else ids).collect())
    picked = sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []
    return np.array([d for d, _ in picked], np.int64), np.array([p for _, p in picked], np.int64)


def _part(low_doc: np.ndarray, low_print: np.ndarray):
    """(doc, print) to the number of its range."""

    @F.arrow_udf("int")
    def part(doc: pa.Array, print_: pa.Array) -> pa.Array:
        d, p = doc.to_numpy(), print_.to_numpy()
        first, after = np.searchsorted(low_doc, d, "left"), np.searchsorted(low_doc, d, "right")
        out = after.copy()
        # Bounds with the same doc decide by the hash; these are few.
        for i in np.flatnonzero(first < after):
            out[i] = first[i] + np.searchsorted(low_print[first[i] : after[i]], p[i], "right")
        return pa.array(out, pa.int32())

    return part


def digest(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    low = bounds(rows.select("doc", "print"), range_rows)
    if len(low[0]):
        rows = rows.withColumn("part", _part(*low)("doc", "print"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    # One row a range: the first of each in descending order goes to the range that is read before it.
    tops = {p: (t.doc, t.print) for p, t in rows.groupBy("part").agg(F.max(F.struct("doc", "print")).alias("t")).collect()}
    order = sorted(tops, reverse=True)
    to = {order[i]: order[i - 1] for i in range(len(order))}
    table = docs.sparkSession.createDataFrame([(*tops[p], p, to[p]) for p in order], "doc long, print long, part int, to int")
    dealt = rows.join(F.broadcast(table), ["doc", "print", "part"], "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest")))
    dealt = dealt.withColumn("p", F.explode(F.array_compact(F.array(own, guest)))).select("p.part", "p.guest", "doc", "print", "text")
    dealt = dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", F.desc("doc"), F.desc("print"))
    return dealt.drop("print").mapInArrow(_stream, _SCHEMA)
