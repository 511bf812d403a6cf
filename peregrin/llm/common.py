"""What the operators of this subpackage share: the shared folder, column selection, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space.
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is named and the master is local, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(sc, "_peregrin_dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            where = sc._peregrin_dir = "file://" + tempfile.mkdtemp(prefix="peregrin-")
            sc.setCheckpointDir(where)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_SCRATCH: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for opened in _SCRATCH:
        opened.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders, through whatever file system they are on."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What fresh_path names inside is removed at the end: for work whose result is written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        delete(spark, *_SCRATCH.pop())


def write(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write a table, and let the shuffle files of doing so go at once: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, name)
    write(df, path, compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._peregrin_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing lazy refers to any more."""
    for t in tables:
        delete(t.sparkSession, t._peregrin_path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: partitions and their order of rows stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (key, text), whatever else the table holds; a null text counts as empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(b: pa.RecordBatch, column: str, most_bytes: int = 4 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """b in slices of so many rows and bytes of a text column at most; a longer text is a slice of its own."""
    size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < b.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, b.num_rows)
        yield b.slice(at, to - at)
        at = to


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls end to end, and where each text starts (and the end)."""
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def word_hashes(col: pa.Array, strip: str | None = None, lower: Callable[[pa.Array], pa.Array] = pc.ascii_lower) -> tuple[np.ndarray, np.ndarray]:
    """Of texts: the 64-bit hashes of all their words, lower-cased (A-Z by default), end to end; and where each text starts (and the end).

    strip: characters taken off both ends of each word; a word of nothing else is none.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(lower(col.cast(pa.string())))
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    kinds = words.dictionary.to_pylist()
    if strip:
        kinds = [w.strip(strip) for w in kinds]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in kinds), np.uint64, len(kinds))
    which = words.indices.to_numpy()
    real = np.fromiter(map(bool, kinds), bool, len(kinds))[which]
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes[which[real]], before[np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)]
