"""Sets that overlap, found by walking a trie of the sets.

Elements get ranks by falling frequency, so similar sets share long paths. The
trie is kept as the list of its sets in order of their paths, with the length
of the path that each shares with the one before: the depth-first order of
its nodes. A set is compared with those behind it in that order. The overlap
counted along a shared path is used again, and where the elements left cannot
reach the overlap needed, all sets below that node are passed over.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


class Trie:
    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        distinct, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, -counts))] = np.arange(len(distinct))
        # Elements of one set only lie at the ends of paths and overlap nothing.
        self.n_shared = int((counts > 1).sum())
        ranked = np.split(rank[place], np.cumsum(self.sizes)[:-1]) if sets else []
        paths = [np.sort(r[r < self.n_shared]).astype(np.int32) for r in ranked]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.shared = [0] * len(sets)
        for j in range(1, len(sets)):
            a, b = self.paths[j - 1], self.paths[j]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[j] = int(differ[0]) if len(differ) else m

    def link(self, num: int, den: int, forest: Forest, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of positions with ``den * |x & y| >= num * |x | y|`` that
        connect what ``forest`` has not connected yet. With ``probe``, only
        pairs with one position marked there are compared."""
        found = []
        n = len(self.paths)
        member = np.zeros(self.n_shared, bool)
        sizes = self.sizes[self.order]
        for i in range(n - 1):
            x, size = self.paths[i], int(sizes[i])
            if not len(x):
                continue
            low, high = -(-num * size // den), den * size // num
            needed_by_any = low
            member[x] = True
            kept, seen = len(x), np.arange(1, len(x) + 1)  # overlap of the path last walked, at each depth
            walked = x
            depth, dead = len(x), n and 1 << 60
            for j in range(i + 1, n):
                depth = min(depth, self.shared[j])
                if depth >= dead:
                    continue
                dead = 1 << 60
                y_size = int(sizes[j])
                if not low <= y_size <= high:
                    continue
                a, b = self.order[i], self.order[j]
                if probe is not None and not (probe[a] or probe[b]):
                    continue
                if forest.find(a) == forest.find(b):
                    continue
                y = self.paths[j]
                before = int(seen[depth - 1]) if depth else 0
                seen = np.concatenate([seen[:depth], before + np.cumsum(member[y[depth:]])])
                walked, depth = y, len(y)
                overlap = int(seen[-1]) if len(seen) else 0
                if den * overlap >= num * (size + y_size - overlap):
                    forest.union(a, b)
                    found.append((a, b))
                    continue
                # Overlap at a depth plus what the set has beyond that rank.
                left = len(x) - np.searchsorted(x, walked, side="right")
                short = np.flatnonzero(seen + left < needed_by_any)
                dead = int(short[0]) + 1 if len(short) else 1 << 60
            member[x] = False
        return found
