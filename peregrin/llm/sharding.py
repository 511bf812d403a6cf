"""Operator 4, sharding: global byte-size prefix sums cut at equal targets.

Documents are ordered by id over range partitions. Each partition reports its total (one row a partition goes to the
driver, whatever the number of documents); their prefix sums give every partition its offset, and a running sum within
the partition gives each document its place in the byte stream of the whole corpus. The stream is cut at equal targets:
shards are contiguous in document order and differ by no more than the largest document. No key is grouped, so hot
sources and groups of copies are of no concern. Only (id, size, crc) is sorted, never the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, schema, texts

_PLACED = "doc_id long, size long, text_crc32 long, row long, shard int"


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, size, text_crc32, row (global), shard, slot (gapless from 0 in each shard).

    size: UTF-8 bytes plus 1, so that empty texts count too. A null text counts as empty; a null id sorts first; rows
    with equal ids are ordered by size and crc, and equal rows are interchangeable. An empty table gives no rows.
    Documents whose middle byte lies in [s, s+1) * total / n_shards go to shard s.
    """
    spark = docs.sparkSession
    slim = texts(docs, key, text).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    slim = cut(slim.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order))
    pid = F.spark_partition_id().alias("pid")
    totals = sorted((r.pid, r.n, r.b) for r in slim.groupBy(pid).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    rows, size, at = 0, 0, {}
    for p, n, b in totals:
        at[p] = (rows, size)
        rows, size = rows + n, size + b

    bounds = np.array([-(-2 * size * s // n_shards) for s in range(1, n_shards)], np.int64)  # of twice the middle byte

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, before = at.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            sizes = b.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(sizes)
            shard = np.searchsorted(bounds, 2 * ends - sizes, "right")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(np.arange(row, row + len(sizes))), pa.array(shard, pa.int32())], names=["doc_id", "size", "text_crc32", "row", "shard"])
            row += len(sizes)
            before = int(ends[-1]) if len(ends) else before

    placed = slim.mapInArrow(place, schema(_PLACED))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))  # n_shards rows
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "row", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op4_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its polynomial, a byte at a time; shards by where the middle of a document lies.
OP4_SQL = r"""
WITH steps AS (
  SELECT range AS i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, range) AS v FROM range(256)
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM steps
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents
), sized AS (
  SELECT doc_id, len(b) + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM sized
), sharded AS (
  SELECT *, ((2 * upto - size) * 8 // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM sharded
"""
