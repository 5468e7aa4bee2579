"""Word shingles as 64-bit hashes, and minwise signatures of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

_U = np.uint64
POSITIONS = 128
_rng = np.random.default_rng(20240501)
_ODD = (_rng.integers(0, 2**31, POSITIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, POSITIONS, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case; bytes.split() parts at \\x20 and \\x09-\\x0D, as asked."""
    return text.encode().lower().split() if text else []


def sequence_key(found: list[bytes]) -> bytes:
    """Equal for equal sequences of words."""
    return xxhash.xxh3_128_digest(b" ".join(found))


def shingle_sets(docs: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Per document the sorted hashes of its distinct k-word shingles; of fewer words the whole sequence is one."""
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.zeros(0, _U) for _ in docs]
    hashed = pd.util.hash_array(np.array(flat, object), categorize=False)
    n = len(hashed)
    rolled = np.zeros(n, _U)
    for i in range(min(k, n)):
        rolled[: n - i] += mix(hashed[i:] + _U(i + 1))
    out, at = [], 0
    for d in docs:
        m = len(d)
        if m >= k:
            out.append(np.unique(mix(rolled[at : at + m - k + 1])))
        elif m:
            own = mix(hashed[at : at + m] + np.arange(1, m + 1, dtype=_U)).sum(dtype=_U)
            out.append(mix(np.array([own + _U(m)], _U) ^ _U(0x5BD1E995)))
        else:
            out.append(np.zeros(0, _U))
        at += m
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 [document, position]: minwise tokens; the sets must not be empty."""
    out = np.empty((len(sets), POSITIONS), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 65536):
            held += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> _U(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        for j in range(POSITIONS):
            out[at:end, j] = np.minimum.reduceat((x ^ _FLIP[j]) * _ODD[j], starts)
        at = end
    return out
