"""Five stages over the documents, each on all that its predecessor kept.

Stages judge rows, not ids: rows with a null doc_id, or that share one, stay or go each by its own text and language.
`run` applies them; each stage is written as Parquet to the shared folder and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peregrin.llm.common import delete, fresh_path, scratch, staged, write
from peregrin.llm.decontaminate import find_leaks
from peregrin.llm.lines import dedup_lines
from peregrin.llm.minhash import near_duplicates
from peregrin.llm.pieces import digests
from peregrin.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, a hash of what verdicts depend on and the id; never null, equal for repeated rows only."""
    return docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", F.col("text").isNull(), "text", F.col("lang").isNull(), "lang"))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose __key is no doc_id of bad."""
    return docs.join(bad.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the divergence from their language reject.

    A null or empty text goes, as it has too few words; a null or unknown language leaves the base rules alone to decide. Repeated rows
    share their verdict. An empty table stays empty.
    """
    d = _keyed(docs)
    return _without(d, quality(d.withColumn("doc_id", F.col("__key"))).where(~F.col("kept")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand earlier; drop documents of which no line with a word is left.

    Earlier is a smaller doc_id (null first), then a smaller number of the line; equal lines of rows that share an id are at one place if
    at the same number. So of repeated rows all stay or none. A null text goes; one without a word in any line stays as it
    is. Texts of any length are taken whole. An empty table stays empty.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return out.where(F.col("text").isNotNull()).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked at a similarity of 0.8: that of the smallest doc_id (null first), then by a hash of the text.

    Rows are numbered in that order, so rows of one id are apart, and of repeated rows one stays. Null texts and texts without a word are
    linked to none and stay. An empty table stays empty.
    """
    ordered = docs.select(*COLUMNS).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    d = staged(ordered.withColumn("__key", F.monotonically_increasing_id()), "numbered")
    return _without(d, near_duplicates(d.withColumn("doc_id", F.col("__key")), percent=80).where(~F.col("kept")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none, null and empty items are in none. Repeated rows share their verdict. An empty table of either kind drops
    nothing.
    """
    d = _keyed(docs)
    return _without(d, find_leaks(d.withColumn("doc_id", F.col("__key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, covered.

    A row a document, null ids and repeated rows included; a null or empty text has no ids, and the digests of nothing.
    """
    import public_tokenizers

    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
#: Near-duplicate links, word edits and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):  # what a stage staged for itself, and what it read, isn't needed once its result is written
            out = stage(spark, docs, sf_dir)
            write(out, path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
