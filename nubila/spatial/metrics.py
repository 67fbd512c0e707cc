"""Distance functions of rows, ``f(a, b) -> distances`` with NumPy broadcasting.

Both obey the triangle inequality, which the partitioning and the trees need.
"""

from __future__ import annotations

import numpy as np

EARTH_RADIUS_M = 6371008.8


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt(np.einsum("...i,...i->...", d, d))


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between (longitude, latitude) pairs in degrees, on the sphere."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 1] - a[..., 1]) / 2) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


METRICS = {"euclidean": euclidean, "great_circle": great_circle}
