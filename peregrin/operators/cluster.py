"""Exact one-dimensional k-means of radii of gyration, the elbow table and the box plot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranks import quantiles

#: Distinct values of which the exact optimum is sought in one task.
MOST_VALUES = 20_000_000


def best_cuts(x: np.ndarray, weight: np.ndarray, k: int) -> tuple[list[float], list[list[int]]]:
    """For 1 to k clusters the least within-cluster sum of squares, and the places where clusters start (x sorted)."""
    s0, s1, s2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (weight, weight * x, weight * x * x))

    def cost(i: np.ndarray, j: int) -> np.ndarray:  # of i..j
        n, s = s0[j + 1] - s0[i], s1[j + 1] - s1[i]
        return np.maximum(0.0, s2[j + 1] - s2[i] - s * s / n)

    n = len(x)
    best = np.array([cost(np.array([0]), j)[0] for j in range(n)])
    inertia, back = [float(best[-1])], []
    for c in range(1, min(k, n)):
        new, start = np.full(n, np.inf), np.zeros(n, int)
        todo = [(c, n - 1, c, n - 1)]
        while todo:  # the best start grows with the end, so halves can be searched apart
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(max(a, c), min(b, mid) + 1)
            v = best[i - 1] + cost(i, mid)
            p = int(np.argmin(v))
            new[mid], start[mid] = v[p], i[p]
            todo += [(lo, mid - 1, a, int(i[p])), (mid + 1, hi, int(i[p]), b)]
        best = new
        back.append(start)
        inertia.append(float(best[-1]))
    every = []
    for c in range(len(back) + 1):
        starts, end = [], n - 1
        for start in reversed(back[:c]):
            starts.append(int(start[end]))
            end = starts[-1] - 1
        every.append([0, *reversed(starts)])
    return inertia, every


def elbow(values: DataFrame, column: str = "rg", k: int = 6) -> DataFrame:
    """k, inertia of the standardised values, and low: the least value of each cluster. One row a k up to the number of distinct values.

    One run finds all k. Equal values are counted before they meet in one task, where the exact optimum is found: a value a
    trajectory at most, MOST_VALUES in all.
    """
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("w"))

    def run(p: pa.Table) -> pa.Table:
        if p.num_rows > MOST_VALUES:
            raise ValueError(f"{p.num_rows} distinct values: the exact optimum is for {MOST_VALUES} at most")
        x, w = (p.sort_by("x").column(c).to_numpy().astype(float) for c in ("x", "w"))
        mean = np.average(x, weights=w)
        sd = np.sqrt(np.average((x - mean) ** 2, weights=w)) or 1.0
        inertia, starts = best_cuts((x - mean) / sd, w, k)
        return pa.table({"k": pa.array(range(1, len(inertia) + 1), pa.int32()), "inertia": inertia, "low": [[float(x[s]) for s in at] for at in starts]})

    return v.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "k int, inertia double, low array<double>")


def clusters(values: DataFrame, column: str = "rg", k: int = 3) -> DataFrame:
    """values with cluster from 1, in the order of the mean: the exact optimum of k-means."""
    cuts = elbow(values, column, k).where(F.col("k") == k).select("low")
    v = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts))  # one row
    return v.withColumn("cluster", F.size(F.filter("low", lambda x: F.col(column) >= x))).drop("low")


def box_plot(labelled: DataFrame, column: str = "rg") -> DataFrame:
    """Quartiles and whiskers (the farthest values within 1.5 interquartile ranges) of each cluster."""
    labelled = cut(labelled.select("cluster", column))
    found = quantiles(labelled, {column: [0.25, 0.5, 0.75]}, "cluster")
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    q = sizes.join(F.broadcast(labelled.sparkSession.createDataFrame([(k, v[column]) for k, v in found.items()], "cluster int, q array<double>")), "cluster")
    j = labelled.join(F.broadcast(q), "cluster")  # a row a cluster
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.when((F.col(column) >= F.col("q")[0] - reach) & (F.col(column) <= F.col("q")[2] + reach), F.col(column))
    return j.groupBy("cluster").agg(F.first("n").alias("n"), F.first("q").alias("q"), F.min(inside).alias("low"), F.max(inside).alias("high")).select("cluster", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "low", "high")


def split_by_cluster(fixes: DataFrame, labels: DataFrame, path: str) -> None:
    """Write the fixes of labelled ids, a folder a cluster (those with fixes); the label is in the folder's name alone."""
    fixes.join(labels.select("id", "cluster"), "id").write.mode("overwrite").partitionBy("cluster").parquet(path)
