"""Operator 9, MinHash near-dedup with sequential Bayesian verification.

1. One pass gives each document the fingerprint of its shingle set and a signature. Equal sets become one class
   (partial aggregation before the shuffle), so groups of exact copies of any size cost a row a partition.
2. Classes meet in the buckets of BANDS bands of ROWS minhashes; buckets of one class vanish.
3. Candidate pairs are verified in batches of signature places: a pair is dropped once the posterior chance (uniform
   prior) that its similarity reaches the threshold falls below `miss`; survivors are compared exactly on their full sets.
4. Pairs are never all pairs of a bucket. First each class is compared with one centre of each of its buckets, the
   smallest, then with the best linked one; what is linked by then is one component. Classes in buckets that still hold several
   components are joined by rare shingles: with shingles in the order of how many such classes have them, two sets that reach the
   threshold share one among the first few of both (prefix filter; fewer of the smaller set), and have enough left behind it (positional
   filter). That loses no link between components, whatever the buckets hold, and what many texts share is no key.

Bands lose a link at the threshold with chance (1 - t**ROWS)**BANDS: 5e-11 at 0.85, 5e-8 at 0.8.
Shingle sets are built again for the classes in shared buckets alone, as sorted 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, schema, slices, staged, texts, word_hashes
from .components import components

WORDS, PLACES, BANDS, ROWS, BATCH = 5, 128, 32, 4, 16
_rng = np.random.default_rng(20_24)
_MUL = (_rng.integers(1, 2**32, PLACES, np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, PLACES, np.uint64).astype(np.uint32)
_NULL = -(2**63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(col: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; fewer words are one shingle, none are none."""
    h, at = word_hashes(col)
    all_ = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        all_ = (all_ + h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
    all_ = _mix(all_)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= k:
            yield np.unique(all_[s : e - k + 1])
        elif e > s:
            x = np.uint64(e - s)
            for y in h[s:e]:
                x = _mix(np.array([x]) * np.uint64(0x9E3779B97F4A7C15) + y)[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, ((low[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def least_matches(t: float, miss: float) -> list[tuple[int, int]]:
    """For each number of compared places, the fewest matches that leave P(similarity >= t) at `miss` or more."""

    def tail(m: int, n: int) -> float:  # of Beta(m + 1, n - m + 1) above t, as a binomial sum
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 1) if tail(m, n) >= miss)) for n in range(BATCH, PLACES + 1, BATCH)]


def _profiles(docs: DataFrame) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                n, fp, sig = [], [], []
                for s in shingle_sets(part.column("text")):
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "fp", "sig"])

    return docs.mapInArrow(run, schema("doc_id long, n long, fp binary, sig binary"))


def _sets(wanted: DataFrame) -> DataFrame:
    """(v, fp, text) to (v, set), where the text has that fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                got = [(v, s.tobytes()) for v, fp, s in zip(part.column("v").to_pylist(), part.column("fp").to_pylist(), shingle_sets(part.column("text")), strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["v", "set"])

    return wanted.mapInArrow(run, schema("v long, set binary"))


def _shingles(sets: DataFrame) -> DataFrame:
    """(v, component, set) to a row a shingle: (v, component, n, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, c, s in zip(b.column("v").to_pylist(), b.column("component").to_pylist(), b.column("set").to_pylist(), strict=True):
                h = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(h), x)) for x in (v, c, len(h))), pa.array(h)], names=["v", "component", "n", "h"])

    return sets.mapInArrow(run, schema("v long, component long, n long, h long"))


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (v, component) of different components, with all whose similarity reaches the threshold among them."""
    every = _shingles(sets.join(left, "v"))
    common = every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    w = Window.partitionBy("v", "n").orderBy("k", "h")
    ranked = every.join(common, "h").withColumn("alone", F.col("n") - F.count("*").over(Window.partitionBy("v", "n")))
    ranked = ranked.withColumn("pos", F.col("alone") + F.row_number().over(w) - 1)  # those that no other class has come first
    ranked = staged(ranked.where(f"pos <= n - ({percent} * n + 99) div 100").select("h", "v", "component", "n", "pos"), "prefixes")
    small = ranked.where(f"pos <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent}").select("h", *[F.col(c).alias(f"{c}_a") for c in ("v", "component", "n", "pos")])
    large = ranked.select("h", *[F.col(c).alias(f"{c}_b") for c in ("v", "component", "n", "pos")])
    fits = (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= percent * F.col("n_b")) & (F.col("component_a") != F.col("component_b"))
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # the first shingle that both have, and what follows it
    enough = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    return small.join(large, "h").where(fits & enough).select(F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b")).distinct()


def _with_both(p: DataFrame, t: DataFrame, what: str) -> DataFrame:
    p = p.join(t.select(F.col("v").alias("a"), F.col(what).alias(f"{what}_a")), "a")
    return p.join(t.select(F.col("v").alias("b"), F.col(what).alias(f"{what}_b")), "b").select("a", "b", f"{what}_a", f"{what}_b")


def _verified(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that are links. Joins are on one class's id; adaptive execution splits those of a hot centre."""
    least = least_matches(percent / 100, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, PLACES) for c in ("sig_a", "sig_b"))
                live, matches = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
                for n, m in least:
                    matches[live] += (x[live, n - BATCH : n] == y[live, n - BATCH : n]).sum(axis=1)
                    live = live[matches[live] >= m]
                yield part.select(["a", "b"]).take(pa.array(live))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_py(), np.uint64) for c in ("set_a", "set_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    survivors = _with_both(pairs, sigs, "sig").mapInArrow(prune, schema("a long, b long"))
    return _with_both(survivors, sets, "set").mapInArrow(exact, schema("a long, b long")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-7) -> DataFrame:
    """Return per row doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Links: 100 * |A & B| >= percent * |A | B| of the sets of distinct 5-word shingles. A text of fewer words is one shingle;
    null texts and texts without words have none, are linked with nothing and kept. Repeated rows are equal texts: both
    name the same component, and both are kept if its id is theirs. Null ids count as one smallest id, and come back null.
    An empty table gives no rows.
    """
    docs = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL)))
    base = staged(_profiles(docs), "minhash")
    classes = staged(base.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("v"), F.any_value("sig").alias("sig")), "classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    bands = classes.select("v", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.min("v").alias("centre"), F.max("v").alias("last")).where("centre < last").select("key", "centre")
    buckets = staged(bands.join(shared, "key").select("key", "v", "centre"), "buckets")
    members = buckets.select("v").distinct()
    sigs = staged(classes.join(members, "v", "left_semi").select("v", "fp", "sig"), "candidates")
    sets = staged(_sets(docs.join(sigs.select("v", "fp"), F.col("doc_id") == F.col("v")).select("v", "fp", "text")).dropDuplicates(["v", "set"]), "sets")

    star = buckets.where("v <> centre").select(F.col("v").alias("a"), F.col("centre").alias("b")).distinct()
    links = staged(_verified(star, sigs, sets, percent, miss), "links")
    labels = components(links)

    def unsettled(b: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component: key, v, component."""
        labelled = b.join(labels, "v", "left").select("key", "v", F.coalesce("component", "v").alias("component"))
        several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        return labelled.join(several, "key", "left_semi")

    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
    left = staged(unsettled(buckets).join(degree, "v", "left"), "buckets")
    discard(buckets)
    centres = left.groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("v")).alias("low"), F.col("component").alias("c"))).alias("m")).select("key", (-F.col("m.low")).alias("centre"), F.col("m.c").alias("of"))
    star = left.join(centres, "key").where("component <> of").select(F.col("v").alias("a"), F.col("centre").alias("b")).distinct()
    links = staged(links.unionByName(_verified(star, sigs, sets, percent, miss)), "links")
    labels = staged(components(links), "labels")

    rest = _across(unsettled(left.select("key", "v")).select("v", "component").distinct(), sets, percent)
    more = staged(_verified(rest, sigs, sets, percent, miss), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(sigs, sets, left)

    of = classes.select("fp", "v").join(labels, "v", "left").select("fp", F.coalesce("component", "v").alias("component"))
    back = lambda c: F.when(c != _NULL, c)
    out = base.select("doc_id", "n", "fp").join(of, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component"))
    return out.select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(F.col("component")).alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def op9_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


#: Whole sets, joined by shingle; one of equal sets stands for all.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS s FROM w
), classed AS (
  SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS v, s FROM sets
), members AS (
  SELECT doc_id AS v, n, md5_number(unnest(s)) AS h FROM classed WHERE doc_id = v
), links AS (
  SELECT a.v AS a, b.v AS b FROM members a JOIN members b ON a.h = b.h AND a.v < b.v GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT v, v AS r FROM members
  UNION SELECT reach.v, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.r
), least AS (
  SELECT v, min(r) AS component FROM reach GROUP BY v
), found AS (
  SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE component END AS component_id FROM classed LEFT JOIN least USING (v)
)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM found
"""
