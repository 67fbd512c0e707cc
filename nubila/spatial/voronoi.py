"""Two-level Voronoi partition around pivots, complete for radius joins.

A point p belongs to the cell of its nearest pivot. It is also sent to every
cell whose pivot is at most ``d(p, nearest) + 2 r`` away: if q of that cell lies
within r of p, then by the triangle inequality
``d(p, pivot) <= d(q, pivot) + r <= d(q, nearest of p) + r <= d(p, nearest) + 2 r``.
The bound holds in a coarse cell among its own fine pivots too, so both levels
use it and a point costs two searches among about sqrt(P) pivots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .metrics import METRICS

#: Rows a cell should hold, pivots at most, and sampled rows a pivot.
CELL_ROWS, MAX_PIVOTS, SAMPLE_PER_PIVOT, MAX_SAMPLE = 20_000, 65_536, 40, 400_000


@dataclass
class Partition:
    metric: str
    coarse: np.ndarray
    fine: list[np.ndarray]

    @property
    def cells(self) -> int:
        return sum(map(len, self.fine))

    @staticmethod
    def fit(sample: np.ndarray, rows: int, metric: str, cell_rows: int = CELL_ROWS, seed: int = 7) -> "Partition":
        """``sample``: a bounded sample of the points; it decides how even the cells are, never what is found."""
        rng = np.random.default_rng(seed)
        sample = np.unique(np.asarray(sample, dtype=float), axis=0)
        if not len(sample):
            sample = np.zeros((1, 2))
        pivots = int(min(MAX_PIVOTS, len(sample), max(1, math.ceil(rows / cell_rows))))
        dist = METRICS[metric]
        coarse = sample[rng.choice(len(sample), max(1, round(math.sqrt(pivots))), replace=False)]
        home = np.concatenate([dist(sample[k : k + 4096, None, :], coarse[None]).argmin(axis=1) for k in range(0, len(sample), 4096)])
        fine = []
        for c in range(len(coarse)):
            own = sample[home == c]
            want = max(1, min(len(own), math.ceil(pivots * len(own) / len(sample))))
            fine.append(own[rng.choice(len(own), want, replace=False)] if len(own) else coarse[c : c + 1])
        return Partition(metric, coarse, fine)

    def assign(self, points: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of each copy of each point that a join within ``radius`` needs.

        ``radius``: one number or one a row; a region with a bounding circle is
        its centre with that circle's radius.
        """
        dist, n = METRICS[self.metric], len(points)
        radius = np.broadcast_to(np.asarray(radius, dtype=float), (n,))
        base = np.concatenate(([0], np.cumsum([len(f) for f in self.fine])))
        rows, cells, homes = [], [], []
        for k in range(0, n, 16384):
            p, r = points[k : k + 16384], radius[k : k + 16384]
            d = dist(p[:, None, :], self.coarse[None])
            home = d.argmin(axis=1)
            bound = d[np.arange(len(p)), home] + 2 * r
            takes = d <= (bound * (1 + 1e-9) + 1e-9)[:, None]
            for c in np.flatnonzero(takes.any(axis=0)):
                at = np.flatnonzero(takes[:, c])
                f = dist(p[at][:, None, :], self.fine[c][None])
                best = f.argmin(axis=1)
                limit = f[np.arange(len(at)), best] + 2 * r[at]
                row, cell = np.nonzero(f <= (limit * (1 + 1e-9) + 1e-9)[:, None])
                rows.append(at[row] + k)
                cells.append(cell + base[c])
                homes.append((home[at[row]] == c) & (best[row] == cell))
        if not rows:
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0, dtype=bool)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)
