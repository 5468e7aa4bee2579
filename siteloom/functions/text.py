"""Scalar functions over text: widths, anchors, directives, fingerprints."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of Helvetica for U+0020..U+007E, in thousandths of the font size. Fixed values.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556,
    278, 278, 584, 584, 584, 556, 1015,
    667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833,
    722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611,
    278, 278, 278, 469, 556, 333,
    556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833,
    556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500,
    334, 260, 334, 584,
)
#: Anchor texts that say nothing. Fixed values.
EMPTY_WORDS = ("click here", "here", "read more", "more", "learn more", "this", "link", "this link", "go", "continue", "details")
#: What a page that stands for a missing one says. Fixed pattern.
SOFT_404 = r"(?i)\b(?:404|page not found|not found|page (?:does not|doesn't) exist|no longer (?:exists|available))\b"
VALUED = ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after")
_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
BLANK = "(?U)^\\s+|\\s+$"


def ascii_low(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(c: Column) -> Column:
    """Without any Unicode white space at the ends (trim() only takes spaces)."""
    return F.regexp_replace(c, BLANK, "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def pixel_width(c: Column, px: int) -> Column:
    """Width in whole pixels: for each width the number of characters that have it, the rest at the mean width."""
    by_width: dict[int, str] = {}
    for i, w in enumerate(WIDTHS):
        by_width[w] = by_width.get(w, "") + chr(32 + i)
    counted = [(w, F.char_length(c) - F.char_length(F.translate(c, chars, ""))) for w, chars in sorted(by_width.items())]
    units, known = F.lit(0.0), F.lit(0)
    for w, n in counted:
        units, known = units + n * float(w), known + n
    units = units + (F.char_length(c) - known) * F.lit(sum(WIDTHS) / len(WIDTHS))
    return F.floor(units * px / 1000 + 0.5).cast("long")


def norm_anchor(c: Column) -> Column:
    edge = "[\\p{P}\\p{S}\\s\\u00a0]+"
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"^{edge}|{edge}$", ""), "(?U)\\s+", " "))


def directives(*sources: Column) -> Column:
    """Distinct robots directives of comma lists, without bot names in front of them."""
    def one(token):
        head, rest = strip(F.substring_index(token, ":", 1)), strip(F.expr("''") if token is None else F.regexp_replace(token, "^[^:]*:", ""))
        return F.when(F.instr(token, ":") > 1, F.when(head.isin(*VALUED), F.concat(head, F.lit(":"), rest)).otherwise(rest)).otherwise(token)

    tokens = F.concat(*[F.transform(F.split(F.lower(F.coalesce(s, F.lit(""))), ","), strip) for s in sources])
    return F.array_distinct(F.filter(F.transform(tokens, one), lambda t: t != ""))


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _window_hashes(found: list[str], window: int) -> np.ndarray:
    """FNV-1a of every run of `window` words joined by a space; all runs advance together, byte by byte."""
    data = np.frombuffer(" ".join(found).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    first, sizes = np.append(0, ends[:-1] + 1)[: len(ends) - window + 1], ends[window - 1 :]
    sizes = sizes - first
    order = np.argsort(-sizes, kind="stable")
    first, falling = first[order], -sizes[order]
    hashes = np.full(len(first), 0xCBF29CE484222325, np.uint64)
    for k in range(int(-falling[0])):
        n = int(np.searchsorted(falling, -k))
        hashes[:n] = (hashes[:n] ^ data[first[:n] + k]) * np.uint64(0x100000001B3)
    return hashes


def simhash(text: str | None, window: int = 3, least: int = 20) -> str:
    """64-bit Charikar fingerprint of word windows as 16 hex digits; empty under `least` words.

    A word is what stands between white space, without what is neither letter nor digit at its ends, in lower case.
    """
    found = [w.lower() for w in _WORD.findall(text or "")]
    if len(found) < least:
        return ""
    hashes, votes = _window_hashes(found, window), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14), None] >> np.arange(64, dtype=np.uint64)
        votes += (part & np.uint64(1)).sum(0).astype(np.int64)
    return f"{sum(1 << i for i in range(64) if 2 * votes[i] > len(hashes)):016x}"
