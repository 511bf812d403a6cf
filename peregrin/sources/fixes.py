"""Readers that bring point logs to id, time, lon, lat, and CSV sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Names that columns go by, in order of preference.
ALIASES = {
    "id": ["id", "cid", "车辆ID", "车牌号", "DEVICEID"],
    "time": ["time", "数据发送时间", "数据接收时间", "时间", "DateTime", "timestamp"],
    "lon": ["lon", "经度", "lng", "Longitude"],
    "lat": ["lat", "纬度", "Latitude"],
}


def standardise(df: DataFrame) -> DataFrame:
    """Rename columns by their aliases, in any case; the first alias that is there wins. Others stay."""
    by = {c.strip("﻿").lower(): c for c in df.columns}
    taken = {}
    for name, aliases in ALIASES.items():
        found = next((by[a.lower()] for a in aliases if a.lower() in by), None)
        if found is not None:
            taken[found] = name
    if not {"lon", "id"} & set(taken.values()):
        raise ValueError(f"no column for an id or longitude among {df.columns}")
    return df.withColumnsRenamed(taken)


def parse_time(c: str) -> Column:
    """Timestamps in the formats met with; null for others."""
    forms = ["yyyy-MM-dd HH:mm:ss[.SSSSSS][X]", "yyyy-MM-dd HH:mm:ssX", "yyyy/M/d H:mm[:ss]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][X]", "yyyyMMddHHmmss"]
    return F.coalesce(F.col(c).try_cast("timestamp"), *[F.try_to_timestamp(F.col(c), F.lit(f)) for f in forms])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Text without header, `id;time;POINT(lat lon)`: latitude stands first. Lines that don't parse come with nulls."""
    raw = spark.read.option("sep", ";").schema("id string, time string, geo string").csv(path)
    xy = F.regexp_extract("geo", r"POINT\s*\(\s*(\S+)\s+([^\s)]+)", 1), F.regexp_extract("geo", r"POINT\s*\(\s*(\S+)\s+([^\s)]+)", 2)
    return raw.select(F.col("id").try_cast("long").alias("id"), parse_time("time").alias("time"), xy[1].try_cast("double").alias("lon"), xy[0].try_cast("double").alias("lat"), F.col("_metadata.file_path").alias("source_file"))


def _names(header: str) -> list[str]:
    """Column names of a header line, quotes respected; unnamed ones are numbered."""
    import csv

    return [c.strip().strip("\ufeff") or f"_c{i}" for i, c in enumerate(next(csv.reader([header.strip("\ufeff\r\n")])))]


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """The lines of files as they are: file, at (whether they are in the first block, and their place there), raw (bytes). Files are split as text is."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    t = reader.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.struct((F.col("_metadata.file_block_start") != 0).alias("later"), F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").cast("binary").alias("raw")).where(F.octet_length("raw") > 0)


def _decoded(encoding: str) -> Callable[[str], Column]:
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError:
                return None

        return raw.map(one)

    return F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR)


def read_table(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "gbk", "gb18030"), pattern: str | None = None) -> DataFrame:
    """CSV with headers, of one or many files: each in the first of the encodings that all its lines can be read in (the last if none).

    Columns go by their aliases, time, lon and lat are cast, bad values are null, source_file tells the file. Files may differ in columns:
    those that one lacks are null there. Fields don't hold line ends. Of lines that no encoding fits, bad characters are replaced.
    """
    raw = _lines(spark, path, pattern)
    fits = raw.select("file", "at", "raw", F.is_valid_utf8(F.col("raw").cast("string")).alias("ok"))
    files = fits.groupBy("file").agg(F.min_by("raw", "at").alias("head"), F.min("at").alias("first"), F.bool_and("ok").alias("utf8")).withColumn("encoding", F.when(F.col("utf8"), "utf-8"))
    for e in encodings[1:-1]:  # only files that none before fits are decoded
        left = raw.join(files.where("encoding is null").select("file"), "file", "left_semi")
        good = left.groupBy("file").agg(F.bool_and(_decoded(e)("raw").isNotNull()).alias("good")).where("good").select("file", F.lit(e).alias("fits"))
        files = files.join(good, "file", "left").withColumn("encoding", F.coalesce("encoding", "fits")).drop("fits")
    files = files.withColumn("encoding", F.coalesce("encoding", F.lit(encodings[-1]))).select("file", "first", "encoding", "head")
    files = cut(files)  # a row a file
    kinds = [(r.encoding, bytes(r.head)) for r in files.select("encoding", "head").distinct().collect()]  # one an encoding and header
    rows = raw.join(files.select("file", "first", "encoding", F.col("head").alias("own")), "file").where(F.col("at") != F.col("first"))
    out = None
    for encoding, head in kinds:
        mine = rows.where((F.col("encoding") == encoding) & (F.col("own") == F.lit(bytearray(head))))
        text = F.col("raw").cast("string") if encoding == "utf-8" else F.coalesce(_decoded(encoding)("raw"), F.col("raw").cast("string"))
        names = _names(head.decode(encoding, "replace"))
        schema = ", ".join(f"`{c.replace('`', '')}` string" for c in names)
        part = mine.select(F.from_csv(F.rtrim(text), schema).alias("r"), F.col("file").alias("source_file")).select("r.*", "source_file")
        part = typed(part)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no line in {path}")
    return out


def typed(df: DataFrame) -> DataFrame:
    """df with columns by their aliases, time as a timestamp, lon and lat as doubles; values that don't parse are null."""
    df = standardise(df)
    if "time" in df.columns:
        df = df.withColumn("time", parse_time("time"))
    for c in {"lon", "lat"} & set(df.columns):
        df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


def load(spark: SparkSession, path: str) -> DataFrame:
    """Text of points if the path ends in .txt and its first line holds one, else a table; source_file tells the file."""
    if path.lower().endswith(".txt") and "POINT" in (spark.read.text(path).limit(1).first() or [""])[0]:
        return read_points(spark, path)
    return read_table(spark, path)


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All tables below a folder as read_table has them."""
    return read_table(spark, folder, pattern=pattern)


def cluster_label(name: Column, any_case: bool = False) -> Column:
    """ClusterN of a file's name or path, where N is a number; cluster_N counts from 0. Null if it has none."""
    found = F.regexp_extract(name, r"(?i)(Cluster\d+)" if any_case else r"(Cluster\d+)", 1)
    zero = F.regexp_extract(name, r"cluster_(\d+)", 1)
    return F.when(found != "", found).when(zero != "", F.concat(F.lit("Cluster"), (zero.try_cast("long") + 1).cast("string")))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """lag and msd of a curve CSV: the first columns named like time and msd; positive rows only (alpha is computed anew)."""
    df = spark.read.option("header", True).csv(path)
    pick = lambda what: next(c for c in df.columns if what in c.lower())
    out = df.select(F.col(f"`{pick('time')}`").try_cast("double").alias("lag"), F.col(f"`{pick('msd')}`").try_cast("double").alias("msd"))
    return out.where("lag > 0 and msd > 0 and not isnan(msd)")


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Part files with headers in UTF-8; with bom each starts with the mark that spreadsheets look for."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "\ufeff" + first)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
