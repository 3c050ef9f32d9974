"""Signature trees over token sets: exact pruning of pairs by OR-combined bitmaps and size ranges.

A set's signature has one bit per hashed token.  Two sets share at most
``common bits + min(loss)`` tokens, where a set's loss is its size less its own
bits.  A node ORs the bitmaps of its children and keeps their size range and
largest loss, so the same sum bounds every pair below two nodes.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16


def width_of(n: int) -> int:
    """Bytes of the bitmap of a set of n tokens: a power of two with four to eight bits a token."""
    return max(8, 1 << max(0, (n + 1) // 2 - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """The set's bitmap, by low token bits, so folding halves together gives the bitmap of half the width."""
    width = width_of(len(tokens))
    bits = np.zeros(width * 8, np.uint8)
    bits[(tokens & np.uint64(width * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Tree:
    """Levels from single sets (level 0) up to one root; sets are in order of size."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        maps = np.ascontiguousarray(maps).view(np.uint64)
        loss = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, loss, groups, groups)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, loss, gmin, gmax = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(loss, cut), np.minimum.reduceat(gmin, cut), np.maximum.reduceat(gmax, cut)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``node``, child) for all children one level below."""
        n = len(self.levels[level - 1][0])
        count = np.minimum((node + 1) * FANOUT, n) - node * FANOUT
        owner = np.repeat(np.arange(len(node)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, node[owner] * FANOUT + within


def _possible(x: Tree, y: Tree, lx: int, ly: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    mx, lowx, highx, lossx, gminx, gmaxx = (t[i] for t in x.levels[lx])
    my, lowy, highy, lossy, gminy, gmaxy = (t[j] for t in y.levels[ly])
    need = -(-percent * (lowx + lowy) // (100 + percent))
    keep = (100 * highx >= percent * lowy) & (100 * highy >= percent * lowx)
    keep &= ~((gminx == gmaxx) & (gminy == gmaxy) & (gminx == gminy))  # all of one group already
    keep &= np.minimum(highx, highy) >= need
    at = np.flatnonzero(keep)
    share = np.bitwise_count(mx[at] & my[at]).sum(1).astype(np.int64) + np.minimum(lossx[at], lossy[at])
    keep[at] = share >= need[at]
    return keep


def dual_traversal(x: Tree, y: Tree, percent: int, same: bool, chunk_bytes: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in x, index in y) that may reach ``percent`` of Jaccard; ``same``: x is y, pairs i < j only."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    width = x.levels[0][0].shape[1] * 8
    chunk = max(256, chunk_bytes // (2 * width))
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        lx, ly, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(lx, ly, i[a : a + chunk], j[a : a + chunk]) for a in range(0, len(i), chunk)]
            continue
        ok = (i <= j) if same and lx == ly else np.ones(len(i), bool)
        if same and lx == ly == 0:
            ok = i < j
        i, j = i[ok], j[ok]
        ok = _possible(x, y, lx, ly, i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if lx == ly == 0:
            found.append((i, j))
            continue
        if lx >= ly:
            owner, i = x.children(lx, i)
            j = j[owner]
            lx -= 1
            if same and ly > 0:
                owner, j = y.children(ly, j)
                i = i[owner]
                ly -= 1
        else:
            owner, j = y.children(ly, j)
            i = i[owner]
            ly -= 1
        stack.append((lx, ly, i, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def likeness(x: Tree, y: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    mx, sx, _, lx, _, _ = (t[i] for t in x.levels[0])
    my, sy, _, ly, _, _ = (t[j] for t in y.levels[0])
    share = np.minimum(np.bitwise_count(mx & my).sum(1).astype(np.int64) + np.minimum(lx, ly), np.minimum(sx, sy))
    return share / (sx + sy - share)


def candidate_pairs(sizes: np.ndarray, maps: list[bytes], groups: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of sets of different groups that may link, and the largest Jaccard similarity their bitmaps allow.

    ``side`` 0 and 1 asks for pairs across the two sides only; all 0 for pairs
    within.  Sets are split by bitmap width; widths meet, folded to the smaller,
    if sizes that differ by no more than ``percent`` allows can have them.
    """
    widths = np.array([len(m) for m in maps])
    order = np.lexsort((np.arange(len(sizes)), sizes))
    classes: dict[tuple[int, int], np.ndarray] = {}
    for w in np.unique(widths):
        for s in np.unique(side):
            at = order[(widths[order] == w) & (side[order] == s)]
            if len(at):
                classes[(int(w), int(s))] = at
    out_i, out_j, out_s = [], [], []

    def tree(at: np.ndarray, width: int) -> Tree:
        stacked = np.frombuffer(b"".join(maps[k] for k in at), np.uint8).reshape(len(at), -1)
        return Tree(fold(stacked, width), sizes[at], groups[at])

    two = len(np.unique(side)) > 1
    apart = 1 << max(1, (-(-100 // percent) - 1).bit_length())  # a width doubles with the size
    for (w1, s1), a in classes.items():
        for (w2, s2), b in classes.items():
            same = (w1, s1) == (w2, s2)
            if not w1 <= w2 <= apart * w1 or (two and s1 == s2) or (not two and s1 != s2) or (two and w1 == w2 and s1 > s2):
                continue
            x = tree(a, w1)
            y = x if same else tree(b, w1)
            i, j = dual_traversal(x, y, percent, same)
            step = max(256, (4 << 20) // w1)
            for k in range(0, len(i), step):
                out_s.append(likeness(x, y, i[k : k + step], j[k : k + step]))
            out_i.append(a[i])
            out_j.append(b[j])
    if not out_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, s = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_s)
    differ = groups[i] != groups[j]
    return i[differ], j[differ], s[differ]
