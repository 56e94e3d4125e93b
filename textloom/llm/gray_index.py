"""A hierarchical index over binary fingerprints in Gray order, and the Hamming join it answers.

Neighbours in Gray order differ in few bits, so consecutive fingerprints share long bit patterns.
An upper node keeps, for the fingerprints below it, the bits that all of them share (as the AND and
the OR of the fingerprints). The bits in which the shared patterns of two nodes contradict each
other are a lower bound of every distance between them, and it only grows on the way down; pairs of
nodes whose bound exceeds the radius are pruned as a whole. The join is exact: pruning loses no pair.

A forest holds the trees of many groups at once, so that one vectorised step goes down in all of them.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LEAF, FAN = 16, 4
#: Pairs that one vectorised comparison handles.
SLICE = 1 << 18


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Ranks of fingerprints (n x words, the first word is the highest) in the reflected Gray code, same shape."""
    out = f.astype(U).copy()
    carry = np.zeros(len(f), bool)
    for w in range(f.shape[1]):
        x = out[:, w]
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> U(s)
        x ^= np.where(carry, ~U(0), U(0))
        carry = (x & U(1)).astype(bool)
    return out


def gray_order(f: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """The order by Gray rank; by group first, if given."""
    r = gray_rank(f)
    by = [r[:, w] for w in reversed(range(r.shape[1]))]
    return np.lexsort((*by, group) if group is not None else tuple(by))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class Forest:
    """Trees over the fingerprints ``f``, which are in Gray order within each group; ``first`` are the groups' first rows.

    ``levels[0]`` are blocks of rows, and the last level has one node for each group. A level is (start, AND, OR): node k covers
    the rows, or the nodes of the level below, from start[k] to start[k + 1].
    """

    def __init__(self, f: np.ndarray, first: np.ndarray, height: int = 1):
        self.f, self.levels = f, []
        both, any_, step = f, f, LEAF
        at, size = first, np.diff(np.r_[first, len(f)])
        while True:
            n = -(-size // step)
            top = np.cumsum(n) - n
            start = np.repeat(at, n) + step * (np.arange(int(n.sum())) - np.repeat(top, n))
            stop = len(both)
            both, any_ = np.bitwise_and.reduceat(both, start, axis=0), np.bitwise_or.reduceat(any_, start, axis=0)
            self.levels.append((np.r_[start, stop], both, any_))
            at, size, step = top, n, FAN
            if len(self.levels) >= height and (n == 1).all():
                return


def _cross(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the nodes a[k] and b[k], for every k."""
    na, nb = x[a + 1] - x[a], y[b + 1] - y[b]
    n = na * nb
    k = np.repeat(np.arange(len(a)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return x[a][k] + within // nb[k], y[b][k] + within % nb[k]


def _slices(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray):
    """Bounds of runs of node pairs with about ``SLICE`` pairs of children each."""
    total = np.cumsum((x[a + 1] - x[a]) * (y[b + 1] - y[b]))
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def hamming_join(x: Forest, y: Forest | None, radius: int, work: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of x, j of y) of groups of the same number at most ``radius`` bits apart; without y, pairs i < j within each group of x.

    Both forests must have the same height. ``work`` gets the number of fingerprint pairs compared one by one.
    """
    z = y or x
    top = len(x.levels) - 1
    roots = np.arange(len(x.levels[top][1]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        (xs, xa, xo), (zs, za, zo) = x.levels[level], z.levels[level]
        keep = _bits((xa[a] & ~zo[b]) | (za[b] & ~xo[a])) <= radius
        a, b = a[keep], b[keep]
        for lo, hi in _slices(xs, a, zs, b):
            i, j = _cross(xs, a[lo:hi], zs, b[lo:hi])
            if y is None:
                ordered = i < j if level == 0 else i <= j
                i, j = i[ordered], j[ordered]
            if level:
                stack.append((level - 1, i, j))
                continue
            if work is not None:
                work["compared"] = work.get("compared", 0) + len(i)
            near = _bits(x.f[i] ^ z.f[j]) <= radius
            found.append((i[near], j[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def join_groups(key: np.ndarray, f: np.ndarray, radius: int, work: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key at most ``radius`` bits apart, over all keys; each unordered pair once."""
    by_key = np.argsort(key, kind="stable")
    k = key[by_key]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True] if len(k) else new
    rows = by_key[~alone]  # a group of one has no pairs
    if not len(rows):
        return rows, rows
    order = rows[gray_order(f[rows], key[rows])]
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    if work is not None:
        size = np.diff(np.r_[first, len(k)])
        work["groups"] = work.get("groups", 0) + len(first)
        work["largest"] = max(work.get("largest", 0), int(size.max()))
        work["pairs"] = work.get("pairs", 0) + int((size * (size - 1) // 2).sum())
    i, j = hamming_join(Forest(f[order], first), None, radius, work)
    return order[i], order[j]


def join_sides(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and rows of y at most ``radius`` bits apart; neither is empty."""
    ox, oy = gray_order(x), gray_order(y)
    one = np.zeros(1, np.int64)
    height = max(len(Forest(f, one).levels) for f in (x, y))
    i, j = hamming_join(Forest(x[ox], one, height), Forest(y[oy], one, height), radius)
    return ox[i], oy[j]
