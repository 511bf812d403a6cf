"""Continuous-time quantum walks on a road graph, fitted to a displacement curve.

The Hamiltonian is the weighted adjacency. It is decomposed once, in one task of its own (dense, so the graph must fit a worker), and
shipped to the tasks of the start nodes, which scan all couplings. The best start is then searched finely.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diffusion import alpha_curve

#: Coarse couplings, weights of the two parts of the loss, the largest coupling.
COARSE = np.arange(10, 2000, 50).astype(float)
WEIGHT_MSD, WEIGHT_ALPHA, TOP = 3.0, 1.0, 2000.0


def simulate(values: np.ndarray, vectors: np.ndarray, start: int, d2: np.ndarray, gammas: np.ndarray, steps: int = 100, dt: float = 1.0) -> np.ndarray:
    """Rows of gammas: sum of probability times d2 after each step."""
    out = np.empty((len(gammas), steps))
    time = np.arange(1, steps + 1) * dt
    for i, g in enumerate(gammas):
        psi = vectors @ (vectors[start][:, None] * np.exp(-1j * g * np.outer(values, time)))
        out[i] = d2 @ (psi.real**2 + psi.imag**2)
    return out


def interpolate(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear, with the first and last piece carried on outside."""
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    return y[i] + (y[i + 1] - y[i]) * (at - x[i]) / (x[i + 1] - x[i])


def fit(sims: np.ndarray, gammas: np.ndarray, t: np.ndarray, msd: np.ndarray, alpha: np.ndarray) -> tuple[float, float, np.ndarray] | None:
    """(gamma, loss, prediction at t) of the first least loss; None if fewer than four points can be compared."""
    x = np.arange(1, sims.shape[1] + 1) * float(t[0])
    m = t <= min(t.max(), x.max())
    if m.sum() < 4:
        return None
    best = None
    for g, y in zip(gammas, sims, strict=True):
        f = interpolate(x, y, t[m])
        k = max(0.0, float(f @ msd[m]) / float(f @ f)) if f @ f > 0 else 0.0
        log = np.log(np.maximum(f * k, 1e-9))
        a = np.gradient(log, np.log(t[m]))
        ok = np.isfinite(a) & np.isfinite(alpha[m])
        off = np.mean((alpha[m][ok] - a[ok]) ** 2) if ok.any() else 10.0
        loss = WEIGHT_MSD * np.mean((np.log(msd[m] + 1e-9) - log) ** 2) + WEIGHT_ALPHA * off
        if best is None or loss < best[1]:
            best = (float(g), float(loss), interpolate(x, y, t) * k)
    return best


def hops_squared(n: int, edges: list[tuple[int, int, float]], start: int, metres: bool = False) -> np.ndarray:
    """Squares of the distances from start: edges on the way, or metres; 0 where nothing leads."""
    if metres:
        import heapq

        near = defaultdict(list)
        for u, v, m in edges:
            near[u].append((v, m))
            near[v].append((u, m))
        far, heap = np.full(n, np.inf), [(0.0, start)]
        far[start] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for v, m in near[u]:
                if d + m < far[v]:
                    far[v] = d + m
                    heapq.heappush(heap, (d + m, v))
        return np.where(np.isfinite(far), far, 0.0) ** 2
    near = defaultdict(list)
    for u, v, _ in edges:
        near[u].append(v)
        near[v].append(u)
    far, todo = np.full(n, -1), deque([start])
    far[start] = 0
    while todo:
        u = todo.popleft()
        for v in near[u]:
            if far[v] < 0:
                far[v] = far[u] + 1
                todo.append(v)
    return np.maximum(far, 0).astype(float) ** 2


class Walk:
    """The decomposed graph: nodes (ids in order), values, vectors, edges by place."""

    def __init__(self, rows: list[tuple[int, int, float, float]], most_nodes: int = 6000):
        self.nodes = sorted({x for r in rows for x in r[:2]})
        if len(self.nodes) > most_nodes:
            raise ValueError(f"{len(self.nodes)} nodes: the dense decomposition is for {most_nodes} at most")
        at = {x: i for i, x in enumerate(self.nodes)}
        self.edges = [(at[u], at[v], m) for u, v, m, _ in rows]
        h = np.zeros((len(at), len(at)))
        for u, v, _, w in rows:
            h[at[u], at[v]] = h[at[v], at[u]] = w
        self.values, self.vectors = np.linalg.eigh(h)


def walk_of(g: DataFrame, most_nodes: int = 6000) -> Walk:
    """From graph edges u, v, length_m, weight (of one component; bounded by most_nodes and a check of the count)."""
    most = most_nodes * 20
    rows = g.select("u", "v", "length_m", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many edges for a dense walk")
    return Walk([tuple(r) for r in rows], most_nodes)


def walk_msd(g: DataFrame, starts: DataFrame, gammas: list[float], steps: int = 100, metres: bool = False) -> DataFrame:
    """start, gamma, step, msd: the walk from each start node."""
    shared = g.sparkSession.sparkContext.broadcast(walk_of(g))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        place = {n: i for i, n in enumerate(w.nodes)}
        for p in it:
            for s in p["node"]:
                if s in place:
                    y = simulate(w.values, w.vectors, place[s], hops_squared(len(w.nodes), w.edges, place[s], metres), np.array(gammas, float), steps)
                    yield pd.DataFrame({"start": s, "gamma": np.repeat(gammas, steps), "step": np.tile(np.arange(1, steps + 1), len(gammas)), "msd": y.ravel()})

    return starts.select("node").repartition(8).mapInPandas(run, "start long, gamma double, step int, msd double")


def fit_walk(g: DataFrame, starts: DataFrame, curve: DataFrame, metres: bool = False) -> DataFrame:
    """One row a lag: lag, real_msd, real_alpha, fit_msd, with gamma, loss and start of the best walk; empty if nothing can be fitted.

    Coarse couplings for all starts, then windows of 60 and 10 around the best, for the best start. The curve (lag, msd, alpha)
    has one row a lag and is collected.
    """
    spark = g.sparkSession
    rows = curve.where("lag > 0 and msd > 0").orderBy("lag").select("lag", "msd", "alpha").collect()
    out = "lag int, real_msd double, real_alpha double, fit_msd double, gamma double, loss double, start long"
    if len(rows) < 4:
        return spark.createDataFrame([], out)
    t, msd = np.array([r.lag for r in rows], float), np.array([r.msd for r in rows])
    alpha = np.array([np.nan if r.alpha is None else r.alpha for r in rows])
    walk = walk_of(g)
    shared = spark.sparkContext.broadcast((walk, t, msd, alpha))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t, msd, alpha = shared.value
        place = {n: i for i, n in enumerate(w.nodes)}
        for p in it:
            for s in p["node"]:
                if s in place:
                    d2 = hops_squared(len(w.nodes), w.edges, place[s], metres)
                    f = fit(simulate(w.values, w.vectors, place[s], d2, COARSE), COARSE, t, msd, alpha)
                    if f:
                        yield pd.DataFrame({"start": [s], "gamma": [f[0]], "loss": [f[1]]})

    best = starts.select("node").repartition(8).mapInPandas(run, "start long, gamma double, loss double").orderBy("loss", "start").limit(1).collect()
    if not best:
        return spark.createDataFrame([], out)
    place, f = walk.nodes.index(best[0].start), (best[0].gamma, best[0].loss, None)
    d2 = hops_squared(len(walk.nodes), walk.edges, place, metres)
    for reach, step in ((60, 5.0), (10, 0.05)):
        gammas = np.arange(max(0.0, f[0] - reach), min(TOP, f[0] + reach), step)
        f = fit(simulate(walk.values, walk.vectors, place, d2, gammas), gammas, t, msd, alpha)
    rows = [(int(a), float(b), None if np.isnan(c) else float(c), float(d), f[0], f[1], int(best[0].start)) for a, b, c, d in zip(t, msd, alpha, f[2], strict=True)]
    return spark.createDataFrame(rows, out)


def result_table(fitted: DataFrame, window: int = 7) -> DataFrame:
    """Time, Real_MSD, Real_Alpha, Fit_MSD, Fit_Alpha: the table of a fit; the fit's exponent is computed as the measured one's."""
    a = alpha_curve(fitted.select("lag", F.col("fit_msd").alias("msd")), window=window).select("lag", F.col("alpha").alias("Fit_Alpha"))
    t = fitted.join(F.broadcast(a), "lag", "left")  # a row a lag
    return t.select(F.col("lag").alias("Time"), F.col("real_msd").alias("Real_MSD"), F.col("real_alpha").alias("Real_Alpha"), F.col("fit_msd").alias("Fit_MSD"), "Fit_Alpha")


def r_squared(fitted: DataFrame) -> DataFrame:
    """One row: r2 of fit_msd against real_msd."""
    m = fitted.agg(F.avg("real_msd").alias("m"))
    s = fitted.crossJoin(F.broadcast(m)).agg(F.sum((F.col("real_msd") - F.col("fit_msd")) ** 2).alias("res"), F.sum((F.col("real_msd") - F.col("m")) ** 2).alias("tot"))  # one row
    return s.select((1 - F.try_divide("res", "tot")).alias("r2"))
