"""Operator 6, WARC: a writer, and a PySpark Python data source that reads archives.

The source plans one partition a file. Predicates on record_type and on header columns are pushed down to the reader, which inflates the
start of a record's gzip member, parses the headers, and passes over members that don't qualify without inflating the rest: the
writer notes each member's compressed length in the gzip header (extra field `sl`); members without it are inflated to
find their end. Records of archives that aren't compressed are passed over by their Content-Length. Payloads of revisits, of records that
fail a predicate, and with the option payload=false of all, are never decoded; with verify=true those of responses are
decoded and held against their digests.

Among records with equal payloads that with the largest page_id is the response, others are revisits of it. Payloads are
gathered by digest, partially before the shuffle, and adaptive execution splits the join of a hot payload.
An attempt of a task writes files under names of its own, and a task's output is the list of them: Spark's commit protocol lets
the list of one attempt of each task into the manifest, a table beside the archives, and readers take the files it names. What a
failed or doubled attempt left is in no manifest. Paths go through pyarrow's file systems: local and shared folders, HDFS, S3.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import fresh_path, schema

RECORD = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column to the header that holds it.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
_FILE_BYTES = 64 << 20
MANIFEST = "_manifest"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field `sl` holds the lengths of the member and of its content."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (page_id, url, html, refers_to) to files of this attempt; gives their names and numbers of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, folder = open_fs(path)
        task, attempt = TaskContext.get(), uuid.uuid4().hex
        names, counts, out, size = [], [], None, 0
        try:
            for b in batches:
                for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None:
                        names.append(f"part-{task.partitionId():05d}-{len(names):04d}-{attempt}.warc.gz")
                        counts.append(0)
                        out, size = filesystem.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    payload = html.encode()
                    data = gzip_member(_record(page, url, payload, refers, digest_of(payload)))
                    out.write(data)
                    counts[-1] += 1
                    size += len(data)
                    if size >= _FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "n"])

    return write


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> int:
    """Write a record for each row (page_id, url, html) to path/*.warc.gz, named by path/_manifest; return the number of records.

    Null html is an empty payload; a null url leaves its header out; a null page_id gives an empty one, and such a record is revisit
    if any page with an id has its payload. Payloads below least_bytes are all responses. Rows that repeat the largest page_id of a
    payload are all responses. An empty table writes a manifest of no file. A folder that has a manifest isn't written to.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1("html"))
    last = p.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"))
    rows = p.join(last, "sha1", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    filesystem, folder = open_fs(path)
    filesystem.create_dir(folder, recursive=True)
    rows.mapInArrow(_writer(path), schema("file string, n long")).write.parquet(f"{path}/{MANIFEST}")
    return pages.sparkSession.read.parquet(f"{path}/{MANIFEST}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Member:
    """A gzip member at an offset of a file, or all that follows if it isn't compressed: gives as much as is asked for."""

    def __init__(self, f: pa.NativeFile, at: int):
        self.f, self.at, self.read = f, at, 0
        f.seek(at)
        start = f.read(24)
        self.plain = start[:5] == b"WARC/"
        if not self.plain and start[:2] != b"\x1f\x8b":
            raise ValueError("neither a gzip member nor a record")
        self.length = struct.unpack("<I", start[16:20])[0] if not self.plain and start[3] & 4 and start[12:14] == b"sl" else None
        self.z, self.data, self.done = zlib.decompressobj(31), bytearray(), False
        f.seek(at)

    def need(self, n: int | None) -> bytearray:
        """Content up to n bytes (None: all of a member)."""
        while not self.done and (n is None or len(self.data) < n):
            raw = self.z.unconsumed_tail or self.f.read(1 << 16 if n is None else max(1 << 12, min(1 << 20, n - len(self.data))))
            if not raw:
                if not self.plain:
                    raise ValueError("truncated gzip member")
                self.done = True
            elif self.plain:
                self.data += raw
            else:
                self.read += 0 if self.z.unconsumed_tail else len(raw)
                self.data += self.z.decompress(raw, 1 << 16 if n is None else max(4096, n - len(self.data)))
                self.done = self.z.eof
        return self.data

    def find(self, what: bytes, start: int) -> int:
        """Where `what` stands from start on; -1 if nowhere."""
        n = start + 1024
        while (cut := self.need(n).find(what, max(start, n - 1024 - len(what)))) < 0 and not self.done:
            n += 1024
        return cut

    def end(self, content: int) -> int:
        """Where the next one starts; content: bytes of this record."""
        if self.plain:
            return self.at + content + 4
        if self.length is None:
            self.need(None)
            return self.at + self.read - len(self.z.unused_data)
        return self.at + self.length


def _head(data: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that starts with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", data.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.equal, self.with_payload = options["path"], {}, False
        self.payload, self.verify = (options.get(k, d).lower() == "true" for k, d in (("payload", "true"), ("verify", "false")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership of header columns; give the rest back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[f.attribute[0]] = self.equal.get(f.attribute[0], values) & values
            else:
                if isinstance(f, IsNotNull) and f.attribute == ("payload",):
                    self.with_payload = True  # all but revisits have one
                yield f

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        filesystem, folder = open_fs(self.path)
        if filesystem.get_file_info(folder).type != fs.FileType.Directory:
            return [_File(folder)]
        found = [f for f in filesystem.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith((".", "_"))]
        if filesystem.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.Directory:
            lists = [f.path for f in filesystem.get_file_info(fs.FileSelector(f"{folder}/{MANIFEST}")) if f.path.endswith(".parquet")]
            named = {x for p in lists for x in pq.read_table(p, columns=["file"], filesystem=filesystem).column("file").to_pylist()}
            if missing := named - {f.base_name for f in found}:
                raise ValueError(f"{len(missing)} files of the manifest are missing, such as {min(missing)}")
            found = [f for f in found if f.base_name in named]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        filesystem, _ = open_fs(self.path)
        with filesystem.open_input_file(partition.value) as f:
            at, size = 0, f.size()
            while at < size:
                m = _Member(f, at)
                cut = m.find(b"\r\n\r\n", 0)
                if cut < 0:
                    raise ValueError(f"a record without an end of its head at {at} of {partition.value}")
                heads = _head(bytes(m.data[:cut]))
                row = {c: heads.get(h) for c, h in _HEADERS.items()}
                row["payload_digest"] = row["payload_digest"] and re.sub("^sha1:", "", row["payload_digest"], flags=re.I)
                content = cut + 4 + int(heads["content-length"])
                if all(row[c] in v for c, v in self.equal.items()) and not (self.with_payload and row["record_type"] == "revisit"):
                    yield self._row(m, row, cut + 4, content)
                at = m.end(content)

    def _row(self, m: _Member, row: dict, start: int, end: int) -> tuple:
        payload, size = None, None
        if row["record_type"] in ("response", "revisit"):
            cut = m.find(b"\r\n\r\n", start)
            said = _head(bytes(m.data[start:cut])).get("content-length")
            start, size = cut + 4, int(said) if said is not None else None
        if row["record_type"] != "revisit":
            size = end - start
            if self.payload or self.verify:
                payload = bytes(m.need(end)[start:end])
        if self.verify and row["record_type"] == "response" and (len(payload) != size or digest_of(payload) != row["payload_digest"]):
            raise ValueError(f"the payload of {row['record_id']} isn't what its digest says")
        return (row["record_type"], row["record_id"], row["refers_to"], row["target_uri"], row["payload_digest"], size, payload if self.payload else None)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder or file); a record a gzip member, or none compressed. Options: payload, verify."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Rows of RECORD: of a folder, the files that its manifest names, or all if it has none.

    payload: without it, payloads are null and not decoded. verify: payloads of responses are decoded and held against digest
    and length; ValueError if one differs. Headers that a record lacks are null; revisits have no payload, an empty one is empty. No file
    gives no rows. Sets the session's switch for predicates of Python sources, which Spark reads when the query is planned.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path, payload=False, verify=True)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.where(F.col("record_type").isin("response", "revisit")).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
d AS (SELECT page_id, last, strlen(p.html) AS n, sha1(p.html) AS hex FROM p JOIN m USING (html))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d"""
