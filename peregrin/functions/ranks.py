"""Exact quantiles and numbers in an order, without one task that sees all rows."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Values of a narrowed range that may be brought to the driver; approximate ranks are off by 1 / ACCURACY at most.
MOST_VALUES, ACCURACY = 50_000, 10_000


def quantiles(d: DataFrame, of: dict[str, list[float]], by: str | None = None) -> dict[object, dict[str, list[float]]]:
    """Of each column the exact quantiles (interpolated between the two nearest ranks), for each value of `by`: {key: {column: [...]}}.

    by has few values (a cluster, a measure); without it the one key is None. Nulls are left out; a key with no value in a column has
    no entry for it. A pass finds values of approximate ranks on both sides of each wanted one, the next counts what is below and between; if
    few values are between, they are ranked exactly, else the range is narrowed again. What reaches the driver is bounded.
    """
    key = F.lit(None) if by is None else F.col(by)
    rows = d.select(key.alias("__by"), *[F.col(c).cast("double").alias(c) for c in of]).where(" or ".join(f"{c} is not null" for c in of))
    margin = 2 / ACCURACY
    around = lambda q: [max(0.0, q - margin), min(1.0, q + margin)]
    first = rows.groupBy("__by").agg(*[F.count(c).alias(f"n_{c}") for c in of], *[F.percentile_approx(c, [x for q in at for x in around(q)], ACCURACY).alias(f"q_{c}") for c, at in of.items()])
    sizes = {r[0]: r.asDict() for r in first.collect()}  # a row a key
    open_: dict[tuple, tuple] = {}  # (key, column, rank) to (low, high): the value of that rank is between, all are if they are None
    for k, r in sizes.items():
        for c, at in of.items():
            n = r[f"n_{c}"]
            for j, q in enumerate(at if n else ()):
                span = tuple(r[f"q_{c}"][2 * j : 2 * j + 2]) if n > MOST_VALUES else (None, None)
                open_.update(dict.fromkeys([(k, c, floor(q * (n - 1))), (k, c, ceil(q * (n - 1)))], span))
    values: dict[tuple, float] = {}
    while open_:
        counted = _counted(rows, sorted({(k, c, *span) for (k, c, _), span in open_.items()}, key=str))
        few = {x: r for x, r in counted.items() if min(r[1], 2 * r[2]) <= MOST_VALUES or x[2] == x[3]}
        seen = _seen(rows, few)
        for (k, c, rank), span in list(open_.items()):
            if (x := (k, c, *span)) in few:
                below = few[x][0]
                for v, n in seen[x]:
                    if below <= rank < below + n:
                        values[k, c, rank] = v
                        del open_[k, c, rank]
                        break
                    below += n
                else:
                    raise ValueError("a rank isn't where the approximation has it")
        if open_:
            asked = list(open_.items())
            shares = [(rank - counted[k, c, *span][0]) / (counted[k, c, *span][1] - 1) for (k, c, rank), span in asked]
            got = rows.agg(*[F.percentile_approx(F.when(_inside(k, c, *span), F.col(c)), around(q), ACCURACY).alias(f"q{i}") for i, (((k, c, _), span), q) in enumerate(zip(asked, shares, strict=True))]).first()
            open_ = {x: tuple(got[i]) for i, (x, _) in enumerate(asked)}
    out: dict[object, dict[str, list[float]]] = {}
    for k, r in sizes.items():
        out[k] = {}
        for c, at in of.items():
            if n := r[f"n_{c}"]:
                ends = [(values[k, c, floor(q * (n - 1))], values[k, c, ceil(q * (n - 1))], q * (n - 1) % 1) for q in at]
                out[k][c] = [a + (b - a) * share for a, b, share in ends]
    return out


def _inside(k: object, c: str, low: float | None, high: float | None) -> Column:
    ok = F.col("__by").eqNullSafe(F.lit(k)) & F.col(c).isNotNull()
    return ok if low is None else ok & (F.col(c) >= low) & (F.col(c) <= high)


def _counted(rows: DataFrame, ranges: list[tuple]) -> dict[tuple, tuple[int, int, int]]:
    """Of each range (key, column, low, high): values below, between, and about how many different ones between."""
    sums = []
    for i, (k, c, low, high) in enumerate(ranges):
        mine = _inside(k, c, low, high)
        below = F.lit(None) if low is None else F.when(F.col("__by").eqNullSafe(F.lit(k)) & (F.col(c) < low), 1)
        sums += [F.count(below).alias(f"b{i}"), F.count(F.when(mine, 1)).alias(f"n{i}"), F.approx_count_distinct(F.when(mine, F.col(c))).alias(f"k{i}")]
    r = rows.agg(*sums).first()
    return {x: (r[f"b{i}"], r[f"n{i}"], r[f"k{i}"]) for i, x in enumerate(ranges)}


def _seen(rows: DataFrame, ranges: dict[tuple, tuple[int, int, int]]) -> dict[tuple, list[tuple[float, int]]]:
    """The values of each range in order, with their numbers."""
    out = {x: [(x[2], r[1])] for x, r in ranges.items() if x[2] is not None and x[2] == x[3]}
    asked = [x for x in ranges if x not in out]
    for x in asked:
        out[x] = []
    if asked:
        hit = F.array_compact(F.array(*[F.when(_inside(*x), F.struct(F.lit(i).alias("i"), F.col(x[1]).alias("v"))) for i, x in enumerate(asked)]))
        for r in rows.select(F.explode(hit).alias("e")).groupBy("e.i", "e.v").agg(F.count("*").alias("n")).collect():  # few of a range
            out[asked[r.i]].append((r.v, r.n))
    return {x: sorted(v) for x, v in out.items()}


def numbered(d: DataFrame, *by: str) -> DataFrame:
    """d with n from 0 in the order of `by`: range partitions sorted apart, and the sizes of those before (a row a partition)."""
    shuffles = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.shiftright(F.col("__m"), 33)  # the partition, as monotonically_increasing_id has it
    sorted_ = cut(d.repartitionByRange(shuffles, *by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()))
    sizes = sorted(sorted_.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for r in sizes:
        before[r.p], total = total, total + r.n
    offsets = d.sparkSession.createDataFrame(sorted(before.items()), "__p long, __before long")
    n = F.col("__m") - F.shiftleft(F.col("__p"), 33) + F.col("__before")
    return sorted_.withColumn("__p", at).join(F.broadcast(offsets), "__p").withColumn("n", n).drop("__m", "__p", "__before")
