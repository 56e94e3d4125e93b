"""Vectorised text primitives for Arrow batches.

Many documents are laid end to end in one array of code points, so that word boundaries, word
hashes and rolling hashes cost a handful of NumPy passes per character instead of Python objects
per word. Hashes are 64-bit polynomials over a fixed odd base, hence equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INV_BASE = pow(BASE, -1, 1 << 64)
M1, M2 = U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)
#: Characters that one pass handles; arrays of this size stay in the CPU's caches.
CHUNK = 1 << 18

_pw = np.ones(1, U)
_inv = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _pw, _inv
    if len(_pw) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _pw = np.cumprod(np.r_[U(1), np.full(size - 1, U(BASE))], dtype=U)
            _inv = np.cumprod(np.r_[U(1), np.full(size - 1, U(INV_BASE))], dtype=U)
    return _pw[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> U(32))
    h *= M1
    h ^= h >> U(29)
    h *= M2
    h ^= h >> U(32)
    return h


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """True at the code points that make up words: letters and digits of any script."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans_of(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of the mixed code points i..j-1 times BASE**position."""
    out = np.zeros(len(cp) + 1, U)
    pw, _ = powers(len(cp) + 1)
    x = cp.astype(U)
    x += U(1)
    x *= M1
    x ^= x >> U(31)
    x *= pw[: len(cp)]
    np.cumsum(x, out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def gram_hash(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points; empty if there are fewer."""
    if len(cp) < k:
        return np.zeros(0, U)
    p = prefix_hash(cp)
    _, inv = powers(len(p))
    n = len(cp) - k + 1
    return mix((p[k:] - p[:n]) * inv[:n])


class Words:
    """The words of several texts: ``start``/``end`` in the joined code points, ``doc`` (index of the text), ``hash``."""

    def __init__(self, texts: list[str], hashed: bool = True):
        self.n_docs = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.r_[0, np.cumsum(self.lengths + 1)]
        self.cp = cp = code_points("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
        self.alnum = inside = alnum_table()[cp]
        step = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        self.start, self.end = step[::2], step[1::2]
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        if hashed:
            self.hash = segment_hash(prefix_hash(cp), self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_runs(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n consecutive words of one text, and the run's first word."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for i in range(n):
        h *= U(BASE)
        h += words.hash[i : i + m]
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return mix(h[at]), at
