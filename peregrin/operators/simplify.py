"""Douglas-Peucker simplification, a trajectory at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .clean import DISTANCES, ORDER


def key_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places that stay: the ends, and wherever the farthest point lies beyond the tolerance from the segment."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py, n = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], dx * dx + dy * dy
        u = np.clip((px * dx + py * dy) / n, 0, 1) if n > 0 else 0.0
        d = np.hypot(px - u * dx, py - u * dy)
        i = int(np.argmax(d))
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def simplify(d: DataFrame, tolerance: float = 20, spacing: float = 30, distance: str = "haversine") -> DataFrame:
    """Key points in EPSG:3857 metres, then only those at least `spacing` from the last kept one. Trajectories of two points or fewer stay."""
    far, _ = DISTANCES[distance]

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by([(c, "ascending") for c in ORDER])
        if p.num_rows > 2:
            lon, lat = (p.column(c).to_numpy() for c in ("lon", "lat"))
            at = key_points(6378137.0 * np.radians(lon), 6378137.0 * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)), tolerance).tolist()
            x, y = lon.tolist(), lat.tolist()
            kept = [at[0]]
            for i in at[1:]:
                if far(x[kept[-1]], y[kept[-1]], x[i], y[i]) >= spacing:
                    kept.append(i)
            p = p.take(pa.array(kept))
        return p

    return d.groupBy("id").applyInArrow(run, d.schema)
