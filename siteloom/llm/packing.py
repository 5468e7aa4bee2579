"""Hierarchical multi-length packing.

Documents are dealt by hash to groups of about `group_bytes` of text. In a group a document gives full windows of the
longest tier; what remains is routed to the smallest tier (256, 512, 1024, 2048) that holds it. The long tier is packed
first: each of its pieces opens a window, and its gap is filled from the shorter tiers, largest fitting piece first, at
last by a cut piece. Then each shorter tier packs windows of its own size in the same way, exactly full, so only the
last window of a group is padded. Windows are gathered in step groups of one tier and equal tokens, and the steps of the
tiers are interleaved evenly.

Edge cases: a null or empty text is the end id alone; documents of any length are cut at windows; repeated rows and
rows that share a doc_id are packed one by one; a null doc_id is kept; an empty table gives an empty table; only doc_id
and text are read, so other columns cannot clash.

Scale: one shuffle of the texts by group; a task holds one group at a time, whose size is a parameter and doesn't grow
with the input. The group hash covers id, text and a row's place, so no source, null id, group of copies or of equal
rows meets in one group.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import memo, text_batches

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16384
GROUP_BYTES = 16 << 20
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_tokens int, step_group long"


class _Pool:
    """Pieces (length, document, start) by length."""

    def __init__(self):
        self.pieces: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.pieces, (length, doc, start))

    def largest(self, most: int):
        at = bisect_right(self.pieces, (most, math.inf, 0))
        return self.pieces.pop(at - 1) if at else None


def pack(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tokens of the window with its padding, pieces (document, start, length) in order)."""
    longest, shortest = tiers[0], tiers[-1]
    windows: list = []
    pools = {t: _Pool() for t in tiers}

    def route(doc: int, start: int, length: int) -> None:
        pools[min(t for t in tiers if t >= length)].add(length, doc, start)

    for doc, n in enumerate(lengths):
        full = n // longest
        windows += [(longest, [(doc, longest * i, longest)]) for i in range(full)]
        if n > full * longest:
            route(doc, full * longest, n - full * longest)
    for k, tier in enumerate(tiers):
        below = tiers[k:]
        while piece := pools[tier].largest(tier):
            inside, gap = [(piece[1], piece[2], piece[0])], tier - piece[0]
            while gap:
                found = next((p for t in below if (p := pools[t].largest(gap))), None)
                if not found:
                    # Nothing fits whole: the smallest piece of the smallest tier that has one is cut.
                    pool = next((pools[t] for t in reversed(below) if pools[t].pieces), None)
                    if not pool:
                        break
                    length, doc, start = pool.pieces.pop(0)
                    route(doc, start + gap, length - gap)
                    found = (gap, doc, start)
                inside.append((found[1], found[2], found[0]))
                gap -= found[0]
            if gap and k + 1 < len(tiers) and k:
                # The tier has run dry: its last pieces go on to be cut to shorter windows.
                held = sum(x[2] for x in inside)
                if held >= tiers[k + 1]:
                    for doc, start, length in inside:
                        while length:
                            part = min(length, tiers[k + 1])
                            route(doc, start, part)
                            start, length = start + part, length - part
                    break
            windows.append((tier if not gap else longest, inside))
    return windows


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """For each window the number of its step: steps hold windows of one size and equal tokens, sizes interleaved."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    steps = []
    for s, members in by_size.items():
        each = max(1, step_tokens // s)
        chunks = [members[i : i + each] for i in range(0, len(members), each)]
        steps += [((i + 0.5) / len(chunks), -s, c) for i, c in enumerate(chunks)]
    out = [0] * len(sizes)
    for k, (_, _, chunk) in enumerate(sorted(steps)):
        for i in chunk:
            out[i] = k
    return out


def _packer(path: str, end_id: int, tiers, step_tokens: int):
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("__hash", "ascending")])
        group, doc_ids = table["__group"][0].as_py() if table.num_rows else 0, table["doc_id"].to_pylist()
        tokenizer = memo(path)
        end = np.array([end_id], "<u4")
        texts = table["text"].to_pylist()
        ids = []
        for a, b in text_batches(texts):
            ids += [np.concatenate([np.frombuffer(x, tokenizer.dtype).astype("<u4"), end]) for x in tokenizer.encode(texts[a:b])]
            texts[a:b] = [None] * (b - a)
        windows = pack([len(x) for x in ids], tiers)
        steps = step_groups([w for w, _ in windows], step_tokens)
        cols: list[list] = [[] for _ in names]
        for k, ((size, pieces), step) in enumerate(zip(windows, steps)):
            offset = 0
            for doc, start, length in pieces:
                row = (doc_ids[doc], start, length, zlib.crc32(ids[doc][start : start + length].data), len(ids[doc]),
                       (group << 32) + k, offset, size, (group << 32) + step)
                for c, v in zip(cols, row):
                    c.append(v)
                offset += length
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return packed


def digest(docs: DataFrame, path: str, end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per piece of a document in a window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    rows = rows.withColumn("__hash", F.xxhash64("doc_id", "text", F.monotonically_increasing_id())).withColumn("__group", F.pmod("__hash", F.lit(groups)).cast("long"))
    return rows.groupBy("__group").applyInArrow(_packer(path, end_id, tuple(tiers), step_tokens), SCHEMA)
