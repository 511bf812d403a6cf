"""The diffusion exponent alpha(t) of a curve, its cut-off, transition, power law and regimes.

Curves are rows (keys, lag, msd) of at most a few hundred lags each, so one row of arrays holds a curve.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothing_matrix(w: int) -> np.ndarray:
    """Row r: weights of the window's w values in the quadratic fit at its r-th place."""
    x = np.vander(np.arange(w) - (w - 1) / 2, 3)
    return x @ np.linalg.pinv(x)


def _smoothed(y: Column, n: Column, window: int) -> Column:
    """Savitzky-Golay, quadratic, the ends from the fit to the first and last window; shorter curves use a shorter odd window."""
    def with_window(w: int) -> Column:
        h = F.array(*[F.lit(float(v)) for v in smoothing_matrix(w).ravel()])
        base = lambda r: F.greatest(F.lit(0), F.least(r - w // 2, n - w))
        row = lambda r: F.aggregate(F.sequence(F.lit(0), F.lit(w - 1)), F.lit(0.0), lambda s, k: s + F.get(h, (r - base(r)) * w + k) * F.get(y, base(r) + k))
        return F.transform(F.sequence(F.lit(0), n - 1), row)

    out = y
    for w in range(3, window + 1, 2):
        out = F.when(n >= w, with_window(w)).otherwise(out)
    return out


def _gradient(y: Column, x: Column, n: Column) -> Column:
    def at(i: Column) -> Column:
        lo, hi = F.greatest(i - 1, F.lit(0)), F.least(i + 1, n - 1)
        a, b = F.get(x, i) - F.get(x, lo), F.get(x, hi) - F.get(x, i)
        ends = (F.get(y, hi) - F.get(y, lo)) / (F.get(x, hi) - F.get(x, lo))
        inner = (a * a * F.get(y, hi) + (b * b - a * a) * F.get(y, i) - b * b * F.get(y, lo)) / (a * b * (a + b))
        return F.when((i > 0) & (i < n - 1), inner).otherwise(ends)

    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 1), at))


def alpha_curve(curve: DataFrame, keys: list[str] | None = None, window: int = 7, smooth: bool = True) -> DataFrame:
    """curve with alpha: the gradient of the smoothed log msd by log lag. Rows without positive lag and msd are left out."""
    keys = keys or []
    c = curve.where("lag > 0 and msd > 0")
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "msd"))).alias("c"))
    g = g.select(*keys, "c", F.transform("c", lambda p: F.log(p["lag"].cast("double"))).alias("x"), F.transform("c", lambda p: F.log(p["msd"])).alias("y"), F.size("c").alias("n"))
    g = g.select(*keys, "c", "x", "n", (_smoothed(F.col("y"), F.col("n"), window) if smooth else F.col("y")).alias("s"))
    g = g.select(*keys, "c", _gradient(F.col("s"), F.col("x"), F.col("n")).alias("a"))
    return g.select(*keys, F.explode(F.arrays_zip("c", "a")).alias("r")).select(*keys, "r.c.lag", "r.c.msd", F.col("r.a").alias("alpha"))


def _by(keys: list[str]) -> Window:
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("lag")


def rebound_flags(curve: DataFrame, keys: list[str] | None = None, threshold: float = 0.2) -> DataFrame:
    """run_min, hit (alpha rebounded after the sub-diffusive zone, or is not positive) and keep (no hit so far; curves of fewer than five stay whole)."""
    w = _by(keys or []).rowsBetween(Window.unboundedPreceding, 0)
    c = curve.where(F.col("alpha").isNotNull() & ~F.isnan("alpha")).withColumn("run_min", F.min("alpha").over(w))
    hit = ((F.col("run_min") < 1) & (F.col("alpha") > F.col("run_min") + threshold)) | (F.col("alpha") <= 0)
    c = c.withColumn("hit", hit).withColumn("n", F.count("*").over(Window.partitionBy(*(keys or [F.lit(1)]))))
    return c.withColumn("keep", (F.col("n") < 5) | (F.max(F.col("hit").cast("int")).over(w) == 0)).drop("n")


def cutoff_log(curve: DataFrame, keys: list[str] | None = None, threshold: float = 0.2) -> DataFrame:
    """original, vis and reason of each curve."""
    keys = keys or []
    f = rebound_flags(curve, keys, threshold)
    first = F.min_by(F.when(F.col("alpha") > F.col("run_min") + threshold, F.format_string(f"Rebound > {threshold} (Min=%.2f)", "run_min")).otherwise("Alpha <= 0"), F.when(F.col("hit"), F.col("lag")))
    g = f.groupBy(*keys).agg(F.count("*").alias("original"), F.sum(F.col("keep").cast("int")).alias("vis"), first.alias("why"))
    return g.withColumn("reason", F.when(F.col("original") < 5, "TooShort").otherwise(F.coalesce("why", F.lit("Complete")))).drop("why")


def transition(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first point where alpha comes down to 1 or below from above."""
    c = curve.withColumn("p", F.lag("alpha").over(_by(keys or []))).where("alpha <= 1 and p > 1")
    return c.groupBy(*(keys or [])).agg(F.min("lag").alias("lag"), F.min_by("alpha", "lag").alias("alpha")).where("lag is not null")


def power_law(curve: DataFrame, keys: list[str] | None = None, least: int = 5) -> DataFrame:
    """slope, coefficient and r2 of msd = coefficient * lag ** slope, by regression of the logs; curves of `least` points and more."""
    c = curve.where("lag > 0 and msd > 0").select(*(keys or []), F.log(F.col("lag").cast("double")).alias("x"), F.log("msd").alias("y"))
    g = c.groupBy(*(keys or [])).agg(F.regr_slope("y", "x").alias("slope"), F.exp(F.regr_intercept("y", "x")).alias("coefficient"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).drop("n")


def regime(alpha: Column) -> Column:
    """The band of the exponent: sub up to a half, normal up to 1, super above."""
    return F.when(alpha < 0.5, "sub").when(alpha < 1, "normal").when(alpha.isNotNull(), "super")
