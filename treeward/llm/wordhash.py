"""Words of whole texts as 64-bit hashes, and hashes of their n-grams, in numpy.

A word is a run of letters and digits, compared without case. The hash of a word is a
polynomial over its code points, taken from running sums, so that a text costs a few
array operations however many words it has.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 18
STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point of the basic plane whether it belongs to words; all others do."""
    return np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * STEP
    h = (h ^ (h >> np.uint64(32))) * STEP
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word of a text, in order; none for null."""
    text, at, out = (text or "").lower(), 0, []
    while at < len(text):
        to = min(len(text), at + SEGMENT)
        if to < len(text):  # cut where no word is cut
            cut = text.rfind(" ", at, to)
            cut = cut if cut > at else text.find(" ", to)
            to = cut if cut > at else len(text)
        out.append(_segment(text[at:to]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _segment(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = np.zeros(len(code) + 2, dtype=np.int8)
    inside[1:-1] = word_characters()[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    size = SEGMENT
    while size < len(code):
        size *= 2
    up, down = powers(size)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(mixed(code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * STEP + words[k : len(words) - n + 1 + k]
    return mixed(out)
