"""Exact nearest neighbours among rows held in memory, by a tree of median splits (numpy only)."""

from __future__ import annotations

import numpy as np


class Splits:
    """Median splits along the coordinate of largest spread; a leaf is a block of at most ``leaf`` of the fitted rows
    (more where these are equal)."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.axis, self.at, self.low, self.high, self.leaf = [], [], [], [], []
        self.n = 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                (self.low, self.high)[side][parent] = me
            for column, empty in ((self.axis, -1), (self.at, 0.0), (self.low, -1), (self.high, -1), (self.leaf, -1)):
                column.append(empty)
            if len(rows) > leaf:
                own = x[rows]
                k = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                mid = float(np.median(own[:, k]))
                right = own[:, k] > mid
                if not right.any():  # the upper half is one value
                    right = own[:, k] >= mid
                if 0 < right.sum() < len(rows):
                    self.axis[me], self.at[me] = k, float(own[~right, k].max())
                    todo += [(rows[right], me, 1), (rows[~right], me, 0)]
                    continue
            self.leaf[me] = self.n
            self.n += 1
        self.axis, self.at, self.low, self.high, self.leaf = map(np.array, (self.axis, self.at, self.low, self.high, self.leaf))

    def bucket(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if len(inner) == 0:
                return self.leaf[node]
            own = node[inner]
            node[inner] = np.where(x[inner, self.axis[own]] > self.at[own], self.high[own], self.low[own])

    def probes(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and all leaves that reach into the row's radius."""
        rows, node, out = np.arange(len(x)), np.zeros(len(x), int), []
        while len(rows):
            done = self.axis[node] < 0
            out.append((rows[done], self.leaf[node[done]]))
            rows, node = rows[~done], node[~done]
            gap = x[rows, self.axis[node]] - self.at[node]
            reach = radius[rows] * (1 + 1e-9)
            left, right = gap <= reach, gap >= -reach
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([self.low[node[left]], self.high[node[right]]])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))


def nearest(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int, most: np.ndarray | None = None, cells: int = 1_500_000):
    """Per row of ``a`` its k nearest rows of ``b`` with another id, nearer first, smaller id first: row, id, squared distance."""
    out = []
    step = max(1, cells // max(len(b), 1))
    for lo in range(0, len(a), step):
        p = a[lo : lo + step]
        d2 = np.zeros((len(p), len(b)))
        for c in range(a.shape[1]):
            d = p[:, c][:, None] - b[:, c][None]
            d2 += d * d
        d2[ia[lo : lo + step][:, None] == ib[None]] = np.inf
        bound = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(p), np.inf)
        if most is not None:
            bound = np.minimum(bound, most[lo : lo + step])
        i, j = np.nonzero((d2 <= bound[:, None]) & (d2 < np.inf))
        out.append((lo + i, ib[j], d2[i, j]))
    return first_k(out, k)


def first_k(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Of all (row, id, squared distance) the k nearest of each row, in order."""
    if not found:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    row, ids, d2 = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, d2, row))
    row, ids, d2 = row[order], ids[order], d2[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], ids[keep], d2[keep]


def search(index, a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int, most: np.ndarray | None = None):
    """As :func:`nearest`, by an ``index`` fitted on ``b``: the row's own leaf first, then the leaves that the k-th
    distance found there reaches into. The cost per row follows the leaf, not the number of rows."""
    leaf_of = index.bucket(b)
    order = np.argsort(leaf_of, kind="stable")
    cuts = np.searchsorted(leaf_of[order], np.arange(leaf_of.max() + 2 if len(b) else 1))
    members = lambda leaf: order[cuts[leaf] : cuts[leaf + 1]] if leaf + 1 < len(cuts) else order[:0]
    home = index.bucket(a)
    bound = np.full(len(a), np.inf) if most is None else most.copy()
    found = []

    def meet(rows: np.ndarray, leaf: int) -> None:
        own = members(leaf)
        if len(own) and len(rows):
            r, i, d = nearest(a[rows], ia[rows], b[own], ib[own], k, bound[rows])
            found.append((rows[r], i, d))

    by = np.argsort(home, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], home[by][1:] != home[by][:-1]))) if len(by) else []
    for rows in np.split(by, starts[1:]) if len(by) else ():
        meet(rows, int(home[rows[0]]))
    row, _, d2 = first_k(found, k)
    full = np.bincount(row, minlength=len(a)) == k
    last = np.cumsum(np.bincount(row, minlength=len(a))) - 1
    bound[full] = np.minimum(bound[full], d2[last[full]])
    r, leaf = index.probes(a, np.sqrt(bound))
    away = leaf != home[r]
    r, leaf = r[away], leaf[away]
    order_ = np.argsort(leaf, kind="stable")
    r, leaf = r[order_], leaf[order_]
    starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1]))) if len(leaf) else []
    for lo, hi in zip(starts, [*starts[1:], len(leaf)] if len(leaf) else [], strict=False):
        meet(r[lo:hi], int(leaf[lo]))
    return first_k(found, k)
