"""Signature trees: nodes hold the OR of their members' token bitmaps and the range of their sizes.

A dual traversal walks pairs of nodes from the roots.  A pair goes on only if its size ranges allow the threshold
and its maximum possible overlap does: members a and b share at most ``popcount(OR_x & OR_y)`` bits, and a set of
``n`` tokens with ``k`` bits can hide at most ``n - k`` tokens behind them.  Sets are kept in classes by size (a class
doubles), each with a bitmap width of its own; the wider one of two classes is folded.  Every pair of classes whose
sizes may reach the threshold is traversed, as many classes apart as the threshold allows.

Defined results: no members and a single member give no pairs; equal sets are pairs like others; empty sets fit
nothing, and callers leave them out; sets of any size are members, their bitmaps grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
CHUNK = 1 << 15
BITS_A_TOKEN = 2
#: Groups up to this size are compared at the leaves.
SMALL = 32


def size_class(n: int) -> int:
    return max(n, 1).bit_length() - 1


def width_of(cls: int) -> int:
    """64-bit words of a class's bitmaps."""
    return max(1, (BITS_A_TOKEN << (cls + 1)) // 64)


def bitmap(tokens: np.ndarray, cls: int) -> np.ndarray:
    words = width_of(cls)
    out = np.zeros(words * 64, dtype=bool)
    out[(tokens >> np.uint64(7)) % np.uint64(words * 64)] = True
    return np.packbits(out, bitorder="little").view("<u8").astype(np.uint64)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of a wider class as they would be with ``words`` words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of sizes a and b have ``100 |a & b| >= percent |a | b|``."""
    return -(-percent * (a + b) // (100 + percent))


def classes_apart(percent: int) -> int:
    """How many size classes sets that reach the threshold can lie apart."""
    if not 0 < percent <= 100:
        raise ValueError("the threshold must be from 1 to 100 percent")
    return (100 // percent).bit_length()


def fits(low_a, high_a, low_b, high_b, percent: int):
    return (100 * np.minimum(high_a, high_b) >= percent * np.maximum(low_a, low_b))


class Tree:
    """The members (rows) of one class, smallest set first."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.rows = rows[order]
        maps, sizes = maps[order], sizes[order]
        spare = sizes - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, spare = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = node * FANOUT
        return first, np.minimum(first + FANOUT, len(self.levels[level - 1][0])) - first


def leaf_bound(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """At most so many tokens are shared: a token whose bit the other lacks is not."""
    return np.minimum(size_a - np.bitwise_count(a & ~b).sum(axis=1), size_b - np.bitwise_count(b & ~a).sum(axis=1))


def dual(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y) that may reach the threshold; with ``x is y`` each pair once."""
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > CHUNK:
            for at in range(0, len(i), CHUNK):
                stack.append((level, i[at : at + CHUNK], j[at : at + CHUNK]))
            continue
        lx, ly = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        (mx, lowx, highx, sparex), (my, lowy, highy, sparey) = x.levels[lx], y.levels[ly]
        ok = fits(lowx[i], highx[i], lowy[j], highy[j], percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        words = min(mx.shape[1], my.shape[1])
        a, b = fold(mx[i], words), fold(my[j], words)
        if level == 0:
            if same:
                ok = i < j
                i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            ok = leaf_bound(a, b, lowx[i], lowy[j]) >= needed(lowx[i], lowy[j], percent)
            if ok.any():
                yield x.rows[i[ok]], y.rows[j[ok]]
            continue
        # the bits of a folded map hide more: its spare counts only against the unfolded map
        hide = np.where(mx.shape[1] == words, sparex[i], highx[i])
        hide = np.minimum(hide, np.where(my.shape[1] == words, sparey[j], highy[j]))
        ok = np.bitwise_count(a & b).sum(axis=1) + hide >= needed(lowx[i], lowy[j], percent)
        i, j = i[ok], j[ok]
        if lx == level:
            first, n = x.children(level, i)
            at = np.repeat(first, n) + ranges(n)
            i, j = at, np.repeat(j, n)
        if ly == level and len(j):
            first, n = y.children(level, j)
            at = np.repeat(first, n) + ranges(n)
            i, j = np.repeat(i, n), at
        if same:
            ok = i <= j
            i, j = i[ok], j[ok]
        if len(i):
            stack.append((level - 1, i, j))


def ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def candidates(rows: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], sides: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one group that may reach the threshold; with ``sides`` only pairs between 0 and 1."""
    classes = np.array([size_class(int(n)) for n in sizes])
    parts = [np.ones(len(rows), bool)] if sides is None else [sides == 0, sides == 1]
    trees = [{c: Tree(rows[(m := p & (classes == c))], sizes[m], np.stack([maps[i] for i in np.flatnonzero(m)])) for c in sorted(set(classes[p].tolist()))} for p in parts]
    left, right, far = trees[0], trees[-1], classes_apart(percent)
    for c, tree in left.items():
        for d in range(c if sides is None else c - far, c + far + 1):
            if d in right:
                yield from dual(tree, right[d], percent)


def small_pairs(group: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf comparisons inside many small groups at once; ``group`` is ascending."""
    left, right = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        i = i[fits(sizes[i], sizes[i], sizes[i + step], sizes[i + step], percent)]
        left.append(i)
        right.append(i + step)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    classes = np.array([size_class(int(n)) for n in sizes])
    keep = np.zeros(len(i), bool)
    for c in set(np.minimum(classes[i], classes[j]).tolist()):
        own = np.flatnonzero(np.minimum(classes[i], classes[j]) == c)
        words = width_of(c)
        for at in range(0, len(own), CHUNK):
            part = own[at : at + CHUNK]
            a = np.stack([fold(maps[k][None], words)[0] for k in i[part].tolist()])
            b = np.stack([fold(maps[k][None], words)[0] for k in j[part].tolist()])
            keep[part] = leaf_bound(a, b, sizes[i[part]], sizes[j[part]]) >= needed(sizes[i[part]], sizes[j[part]], percent)
    return i[keep], j[keep]
