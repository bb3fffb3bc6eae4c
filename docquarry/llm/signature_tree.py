"""A tree over sets: nodes hold OR-combined token bitmaps and size ranges; two trees are joined by dual traversal.

The bitmaps stand for the tokens that at least two of the sets share, one bit each while there are at most MAX_BITS of them,
else hashed to MAX_BITS. A pair of nodes is left out when no two of their sets can overlap enough, when their size ranges
don't fit, or when all their sets are already known to be connected.
"""

from __future__ import annotations

import numpy as np

LEAF, FANOUT, MAX_BITS = 32, 4, 1 << 16


class Sets:
    """Sets as sorted arrays end to end, their bitmaps, and the component that each is in."""

    def __init__(self, tokens: np.ndarray, offs: np.ndarray):
        self.tokens, self.offs, self.sizes = tokens, offs, np.diff(offs)
        n = len(self.sizes)
        owner = np.repeat(np.arange(n), self.sizes)
        _, index, seen = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = seen[index] > 1
        number = np.cumsum(seen > 1) - 1
        bits = number[index[shared]]
        n_bits = int((seen > 1).sum())
        self.exact = n_bits <= MAX_BITS
        width = max(1, -(-min(n_bits, MAX_BITS) // 64))
        bits = bits % (width * 64)
        self.bitmaps = np.zeros((n, width), np.uint64)
        np.bitwise_or.at(self.bitmaps, (owner[shared], bits // 64), np.uint64(1) << (bits % 64).astype(np.uint64))
        # Tokens that share a bit with another of the same set: a bound on what the bitmap hides.
        self.hidden = np.bincount(owner[shared], minlength=n) - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        self.root = np.arange(n)

    def unite(self, x: int, y: int) -> None:
        a, b = self.root[x], self.root[y]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)

    def overlap(self, x: int, y: int) -> int:
        a, b = self.tokens[self.offs[x] : self.offs[x + 1]], self.tokens[self.offs[y] : self.offs[y + 1]]
        return len(np.intersect1d(a, b, assume_unique=True))


class Tree:
    """Levels of nodes over ``members``, leaves first; near sets lie near each other by their least tokens."""

    def __init__(self, sets: Sets, members: np.ndarray):
        least = sets.tokens[sets.offs[:-1][members]]
        self.members = members[np.lexsort((sets.sizes[members], least))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        cut = np.arange(0, len(members), LEAF)
        size, maps, hidden = sets.sizes[self.members], sets.bitmaps[self.members], sets.hidden[self.members]
        self.span = [(cut, np.append(cut[1:], len(members)))]
        self.levels.append((np.bitwise_or.reduceat(maps, cut, 0), np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut), np.maximum.reduceat(hidden, cut)))
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            starts, ends = self.span[-1]
            self.span.append((starts[cut], ends[np.append(cut[1:], len(low)) - 1]))
            self.levels.append((np.bitwise_or.reduceat(maps, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)))

    def inside(self, node: tuple[int, int]) -> np.ndarray:
        level, i = node
        return self.members[self.span[level][0][i] : self.span[level][1][i]]

    def children(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        level, i = node
        return [(level - 1, c) for c in range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][1])))]


def _may_link(sets: Sets, s: Tree, a: tuple[int, int], t: Tree, b: tuple[int, int], percent: int) -> bool:
    maps_a, low_a, high_a, hidden_a = (x[a[1]] for x in s.levels[a[0]])
    maps_b, low_b, high_b, hidden_b = (x[b[1]] for x in t.levels[b[0]])
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    most = int(np.bitwise_count(maps_a & maps_b).sum()) + min(int(hidden_a), int(hidden_b))
    if (100 + percent) * most < percent * (int(low_a) + int(low_b)):
        return False
    first = sets.root[s.inside(a)[0]]
    return bool((sets.root[s.inside(a)] != first).any() or (sets.root[t.inside(b)] != first).any())


def _link_leaves(sets: Sets, x: np.ndarray, y: np.ndarray, percent: int) -> None:
    """Link the pairs of two leaves that are similar enough and not yet connected."""
    most = np.bitwise_count(sets.bitmaps[x][:, None] & sets.bitmaps[y][None]).sum(2, dtype=np.int64) + np.minimum(sets.hidden[x][:, None], sets.hidden[y][None])
    fits = (100 + percent) * most >= percent * (sets.sizes[x][:, None] + sets.sizes[y][None])
    fits &= sets.root[x][:, None] != sets.root[y][None]
    for i, j in zip(*np.nonzero(fits)):
        a, b = int(x[i]), int(y[j])
        if sets.root[a] == sets.root[b]:
            continue
        common = int(most[i, j]) if sets.exact else sets.overlap(a, b)
        if 100 * common >= percent * (sets.sizes[a] + sets.sizes[b] - common):
            sets.unite(a, b)


def join(sets: Sets, s: Tree, t: Tree, percent: int) -> None:
    """Dual traversal from both roots; with ``s is t``, every node is first joined to itself, so near sets connect early."""
    top = (len(s.levels) - 1, 0), (len(t.levels) - 1, 0)
    stack = [top]
    while stack:
        a, b = stack.pop()
        if not _may_link(sets, s, a, t, b, percent):
            continue
        if a[0] == 0 and b[0] == 0:
            _link_leaves(sets, s.inside(a), t.inside(b), percent)
            continue
        if s is t and a == b:
            below = s.children(a)
            stack += [(p, q) for i, p in enumerate(below) for q in below[i + 1 :]]
            stack += [(p, p) for p in below]
        elif a[0] >= b[0]:
            stack += [(p, b) for p in s.children(a)]
        else:
            stack += [(a, q) for q in t.children(b)]
