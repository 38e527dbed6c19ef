"""MinHash signatures and bands, in numpy inside tasks."""

from __future__ import annotations

import functools
import math

import numpy as np

from tickloom.llm.common import hashed_words, mix, shingles


@functools.lru_cache(maxsize=4)
def permutations(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n universal hash functions on 32 bits."""
    drawn = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


#: So many shingles are hashed at once; the work array has this times the number of functions entries.
STEP = 8192


def minima(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Least value of each of n hash functions over each text's shingles; all ones without shingles."""
    rows = len(starts) - 1
    out = np.full((rows, n), 0xFFFFFFFF, np.uint32)
    a, b = permutations(n)
    folded = (grams >> np.uint64(32)).astype(np.uint32) ^ (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    begin = starts[full]
    at = 0
    while at < len(full):
        to = int(np.searchsorted(begin, begin[at] + STEP, side="left"))
        to = max(to, at + 1)
        lo, hi = int(begin[at]), int(starts[full[to - 1] + 1])
        if to == at + 1 and hi - lo > STEP:  # one long text, in parts
            least = out[full[at]].copy()
            for x in range(lo, hi, STEP):
                part = folded[x : min(x + STEP, hi)]
                np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
            out[full[at]] = least
        else:
            values = a[:, None] * folded[None, lo:hi] + b[:, None]
            out[full[at:to]] = np.minimum.reduceat(values, begin[at:to] - lo, axis=1).T
        at = to
    return out


def signatures(texts: list[str | None], n: int, words: int = 5) -> np.ndarray:
    """A signature per text over shingles of ``words`` words; a text without words hashes as one shingle of itself."""
    grams, starts = shingles(*hashed_words(texts), words)
    out = minima(grams, starts, n)
    for i in np.flatnonzero(np.diff(starts) == 0).tolist():
        if texts[i]:
            out[i] = minima(raw_gram(texts[i]), np.array([0, 1]), n)[0]
    return out


def raw_gram(text: str) -> np.ndarray:
    """One hash of a text that has no words."""
    import hashlib

    return np.frombuffer(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), np.uint64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 63-bit key per band of each signature."""
    out = np.zeros((len(signature), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(signature), k + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + signature[:, k * rows + r])
        out[:, k] = key >> np.uint64(1)
    return out.astype(np.int64)


def bands_for(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that pairs at the threshold meet with this probability,
    using at most 128 hash functions."""
    best = (1, 1)
    for rows in range(1, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= 128:
            best = (bands, rows)
    return best
