"""Blocks of a graph: the largest parts that stay connected whichever of their nodes is lost; two of them share one node at most.

Links are taken in turns, so that their number doesn't bound anything: a cycle through each block's nodes loses and adds no
connection, whichever node is lost, so the cycles stand for all links that came before, and are fewer than twice the nodes.
"""

from __future__ import annotations

import numpy as np

#: Links that wait, at most, before they are put into blocks.
FEW = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each place the smallest one that the links (a, b), and those that root already has, lead to. root is changed."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def _breadth_first(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and parent (-1: none) of each of n nodes, from the smallest of each component."""
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(source, kind="stable")
    target, start = target[order], np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
    level, parent = np.full(n, -1), np.full(n, -1)
    front = np.flatnonzero(roots(a, b, np.arange(n)) == np.arange(n))
    level[front] = depth = 0
    while len(front):
        some = start[front + 1] - start[front]
        near = target[np.repeat(start[front] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
        fresh = level[near] < 0
        near, above = near[fresh], np.repeat(front, some)[fresh]
        depth += 1
        level[near], parent[near] = depth, above
        front = np.unique(near)
    return level, parent


class Blocks:
    """Blocks of n nodes under the links added so far. A node's block is that of the link to its parent; a block has one node, its head, above these."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.block, self.head = -1 - np.arange(n), np.full(n, -1)  # below 0: nothing is above the node
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether both nodes are in one block already, so that a link of them tells nothing new."""
        return (self.block[a] == self.block[b]) | (self.head[a] == b) | (self.head[b] == a)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(a), FEW):
            x, y = a[s : s + FEW], b[s : s + FEW]
            new = ~self.together(x, y)
            self.waiting.append((x[new], y[new]))
            if sum(len(p[0]) for p in self.waiting) >= FEW:
                self._fold()

    def _fold(self) -> None:
        if not any(len(p[0]) for p in self.waiting):
            return
        a, b = (np.concatenate(c) for c in zip(self._cycles(), *self.waiting, strict=True))
        self.waiting = []
        level, parent = _breadth_first(a, b, self.n)
        # a link aside from the tree makes a circle with it: all links on it are in one block. Circles climb level by level;
        # nodes of one level that are in one block are as good as one link from one of them to each other
        aside = (parent[a] != b) & (parent[b] != a)
        low, high = np.where(level[a] >= level[b], a, b)[aside], np.where(level[a] >= level[b], b, a)[aside]
        lower = level[low] > level[high]
        one, other = [low[lower]], [parent[low[lower]]]
        low = np.where(lower, parent[low], low)
        order = np.argsort(level[low], kind="stable")
        low, high = low[order], high[order]
        ends = np.searchsorted(level[low], np.arange(level.max() + 2))
        p = q = np.zeros(0, np.int64)
        for k in range(int(level.max()), 0, -1):
            p, q = np.concatenate([p, low[ends[k] : ends[k + 1]]]), np.concatenate([q, high[ends[k] : ends[k + 1]]])
            if not len(p):
                continue
            ids, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            root = roots(at[: len(p)], at[len(p) :], np.arange(len(ids)))
            above = parent[ids]
            apart = above != above[root]
            wide = np.isin(root, root[apart])
            one += [ids, ids[wide]]
            other += [ids[root], above[wide]]
            p, q = above[root[apart]], above[apart]
        own = roots(np.concatenate(one), np.concatenate(other), np.arange(self.n))
        order = np.argsort(level, kind="stable")
        _, first, number = np.unique(own[order], return_index=True, return_inverse=True)
        head = np.empty(self.n, np.int64)
        head[order] = parent[order[first]][number]  # above the block's highest link
        self.block, self.head = np.where(parent >= 0, own, -1 - np.arange(self.n)), np.where(parent >= 0, head, -1)

    def _cycles(self) -> tuple[np.ndarray, np.ndarray]:
        below = np.flatnonzero(self.block >= 0)
        below = below[np.argsort(self.block[below], kind="stable")]
        block, head = self.block[below], self.head[below]
        same = block[1:] == block[:-1]
        first, last = np.concatenate([[True], ~same])[: len(below)], np.concatenate([~same, [True]])[: len(below)]
        close = last & ~first
        return np.concatenate([head[first], below[:-1][same], below[close]]), np.concatenate([below[first], below[1:][same], head[close]])

    def cycles(self) -> tuple[np.ndarray, np.ndarray]:
        """Links (a, b), fewer than twice the nodes, with the blocks of all that were added."""
        self._fold()
        return self._cycles()

    def parts(self) -> np.ndarray:
        """For each node the number of its blocks: of the parts that its component falls into if the node is lost."""
        self._fold()
        below = self.block >= 0
        _, first = np.unique(self.block[below], return_index=True)
        return below + np.bincount(self.head[below][first], minlength=self.n)
