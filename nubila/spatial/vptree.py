"""Vantage-point tree whose build and search run a whole level at a time in NumPy.

The points of a level form a matrix of equal segments (padded with -1), so a
level is built by one sort along its rows and searched for all queries at once.
"""

from __future__ import annotations

import numpy as np


class VPTree:
    def __init__(self, points: np.ndarray, metric, leaf: int = 12):
        self.points, self.metric = np.ascontiguousarray(points, dtype=float), metric
        n = len(points)
        depth = 0
        while n > leaf << depth:
            depth += 1
        width = -(-n // (1 << depth)) if n else 0
        order = np.full((1, width << depth), -1, dtype=np.int64)
        order[0, :n] = np.arange(n)
        self.vantage, self.inner, self.outer, self.reach = [], [], [], []
        for _ in range(depth):
            real = order >= 0
            # the last real point of a segment is the farthest from the parent's vantage point
            last = np.maximum(real.sum(axis=1) - 1, 0)
            vantage = order[np.arange(len(order)), last]
            d = metric(self.points[order], self.points[vantage][:, None, :])
            d[~real] = np.inf
            at = np.argsort(d, axis=1)
            order, d = np.take_along_axis(order, at, 1), np.take_along_axis(d, at, 1)
            half = order.shape[1] // 2
            left = np.where(np.isinf(d[:, :half]), -np.inf, d[:, :half])
            self.vantage.append(vantage)
            self.reach.append(np.where(np.isinf(d), -np.inf, d).max(axis=1))  # largest distance in all of the segment
            self.inner.append(left.max(axis=1))  # largest distance in the near half
            self.outer.append(d[:, half])  # least distance in the far half
            order = order.reshape(-1, half)
        self.leaves = order

    def within(self, queries: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, point index, distance) of all pairs at a distance below ``radius``
        (one number, or one for each query)."""
        queries = np.asarray(queries, dtype=float)
        m = len(queries)
        none = np.empty(0, dtype=np.int64)
        if not m or not len(self.points):
            return none, none, np.empty(0)
        radius = np.broadcast_to(np.asarray(radius, dtype=float), (m,))
        q, node = np.arange(m), np.zeros(m, dtype=np.int64)
        for vantage, inner, outer in zip(self.vantage, self.inner, self.outer):
            d, r = self.metric(queries[q], self.points[vantage[node]]), radius[q]
            slack = 1e-9 * (d + r) + 1e-9
            near, far = d - r <= inner[node] + slack, d + r >= outer[node] - slack
            q, node = np.concatenate((q[near], q[far])), np.concatenate((2 * node[near], 2 * node[far] + 1))
        found: list[tuple] = []
        step = max(1, 4_000_000 // max(1, self.leaves.shape[1]))
        for k in range(0, len(q), step):
            qs, points = q[k : k + step], self.leaves[node[k : k + step]]
            d = self.metric(queries[qs][:, None, :], self.points[points])
            row, col = np.nonzero((points >= 0) & (d < radius[qs][:, None]))
            found.append((qs[row], points[row, col], d[row, col]))
        if not found:
            return none, none, np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def count(self, queries: np.ndarray, radius: float, weights: np.ndarray | None = None) -> np.ndarray:
        """Of each query the points nearer than ``radius``, each as often as its weight says. Segments that lie within the
        radius as a whole are counted without a look at their points, so crowded places cost no more than others."""
        queries = np.asarray(queries, dtype=float)
        out = np.zeros(len(queries))
        if not len(queries) or not len(self.points):
            return out
        w = np.append(np.ones(len(self.points)) if weights is None else np.asarray(weights, dtype=float), 0.0)
        leaf = w[self.leaves]  # -1 is padding: the last weight
        total = np.concatenate(([0.0], np.cumsum(leaf.sum(axis=1))))
        depth = len(self.vantage)
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        for level, (vantage, inner, outer, reach) in enumerate(zip(self.vantage, self.inner, self.outer, self.reach)):
            d = self.metric(queries[q], self.points[vantage[node]])
            slack = 1e-9 * (d + radius) + 1e-9
            whole = d + reach[node] < radius - slack
            if whole.any():
                a, b = node[whole] << (depth - level), (node[whole] + 1) << (depth - level)
                np.add.at(out, q[whole], total[b] - total[a])
                q, node, d, slack = q[~whole], node[~whole], d[~whole], slack[~whole]
            near, far = d - radius <= inner[node] + slack, d + radius >= outer[node] - slack
            q, node = np.concatenate((q[near], q[far])), np.concatenate((2 * node[near], 2 * node[far] + 1))
        step = max(1, 4_000_000 // max(1, self.leaves.shape[1]))
        for k in range(0, len(q), step):
            qs, points = q[k : k + step], self.leaves[node[k : k + step]]
            d = self.metric(queries[qs][:, None, :], self.points[points])
            np.add.at(out, qs, (w[points] * (d < radius)).sum(axis=1))
        return out

    def bound(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Of each query a distance that its k nearest points do not exceed: that to the k-th of a small segment around it."""
        queries = np.asarray(queries, dtype=float)
        if not len(queries) or not len(self.points):
            return np.full(len(queries), np.inf)
        depth = 0
        while depth < len(self.vantage) and self.leaves.size >> (depth + 1) >= 2 * k + 4:
            depth += 1
        node = np.zeros(len(queries), dtype=np.int64)
        for vantage, inner, outer in zip(self.vantage[:depth], self.inner, self.outer):
            d = self.metric(queries, self.points[vantage[node]])
            node = 2 * node + (d > (inner[node] + np.where(np.isinf(outer[node]), inner[node], outer[node])) / 2)
        segments = self.leaves.reshape(1 << depth, -1)
        out = np.empty(len(queries))
        step = max(1, 2_000_000 // segments.shape[1])
        for a in range(0, len(queries), step):
            points = segments[node[a : a + step]]
            d = np.where(points >= 0, self.metric(queries[a : a + step, None, :], self.points[points]), np.inf)
            out[a : a + step] = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.inf
        short = np.isinf(out)
        if short.any():  # a padded segment with too few points: the farthest point bounds all
            out[short] = self.metric(queries[short], self.points[:1]) + self.metric(self.points, self.points[:1]).max()
        return out
