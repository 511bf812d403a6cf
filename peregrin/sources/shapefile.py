"""A Python data source for shapefiles of lines and points, by the published format: reads a partition a .shp file, writes one a task."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

READ = "file string, record int, parts array<array<struct<x:double,y:double>>>, attributes map<string,string>, crs string"
_POINT, _LINE = 1, 3


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Shp(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        f, p = _open(self.path)
        found = f.get_file_info(fs.FileSelector(p, recursive=True)) if f.get_file_info(p).type == fs.FileType.Directory else [f.get_file_info(p)]
        return [_Shp(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".shp")]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        """A record at a time, from the geometry's and the attributes' file side by side."""
        if partition is None:
            return
        f, _ = _open(self.path)
        base = partition.value[:-4]
        crs = None
        if f.get_file_info(base + ".prj").type == fs.FileType.File:
            with f.open_input_file(base + ".prj") as prj:
                crs = prj.read().decode("utf-8", "replace")
        rows = _attributes(f, base + ".dbf")
        with f.open_input_stream(partition.value) as shp:
            shp.read(100)
            n = 0
            while len(head := shp.read(8)) == 8:
                body = shp.read(struct.unpack(">i", head[4:])[0] * 2)
                yield (partition.value, n, _parts(body), next(rows, {}), crs)
                n += 1


def _parts(body: bytes) -> list[list[dict[str, float]]]:
    kind = struct.unpack("<i", body[:4])[0]
    if kind in (1, 11, 21):
        x, y = struct.unpack("<2d", body[4:20])
        return [[{"x": x, "y": y}]]
    if kind not in (3, 5, 13, 15, 23, 25):
        return []
    k, m = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{k}i", body[44 : 44 + 4 * k]), m]
    flat = struct.unpack(f"<{2 * m}d", body[44 + 4 * k : 44 + 4 * k + 16 * m])
    pts = [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2], strict=True)]
    return [pts[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _attributes(f: fs.FileSystem, path: str) -> Iterator[dict[str, str]]:
    if f.get_file_info(path).type != fs.FileType.File:
        return
    with f.open_input_stream(path) as dbf:
        n, head, size = struct.unpack("<IHH", dbf.read(12)[4:12])
        data, fields = dbf.read(head - 12), []
        for at in range(20, len(data) - 31, 32):
            if data[at] == 0x0D:
                break
            fields.append((data[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), data[at + 16]))
        for _ in range(n):
            record, p, row = dbf.read(size), 1, {}
            for name, width in fields:
                row[name] = record[p : p + width].decode("utf-8", "replace").strip()
                p += width
            yield row


@dataclass
class _Written(WriterCommitMessage):
    base: str | None
    name: str


class _Writer(DataSourceArrowWriter):
    """Columns points (a line) or x and y (a point), others are attributes. Files of an attempt get their names when the job commits."""

    def __init__(self, path: str, crs: str | None):
        self.path, self.crs = path, crs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}"
        bodies, rows, columns, kind = [], [], [], _POINT
        for b in iterator:
            geometry = ("points",) if "points" in b.schema.names else ("x", "y")
            kind = _LINE if geometry == ("points",) else _POINT
            columns = [c for c in b.schema.names if c not in geometry]
            for r in b.to_pylist():
                if kind == _LINE:
                    flat = [v for q in r["points"] for v in (q["x"], q["y"])]
                    box = (min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2]))
                    body = struct.pack("<i4d3i", _LINE, *box, 1, len(flat) // 2, 0) + struct.pack(f"<{len(flat)}d", *flat)
                else:
                    box = (r["x"], r["y"], r["x"], r["y"])
                    body = struct.pack("<i2d", _POINT, r["x"], r["y"])
                bodies.append((box, body))
                rows.append(["" if r[c] is None else repr(r[c]) if isinstance(r[c], float) else str(r[c]) for c in columns])
        if not bodies:
            return _Written(None, name)
        f, folder = _open(self.path)
        f.create_dir(folder, recursive=True)
        base = f"{folder}/.{name}-{uuid.uuid4().hex}"
        box = [g(x[0][i] for x in bodies) for i, g in ((0, min), (1, min), (2, max), (3, max))]
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
        shp, shx, at = [], [], 100
        for n, (_, body) in enumerate(bodies, 1):
            shp.append(struct.pack(">2i", n, len(body) // 2) + body)
            shx.append(struct.pack(">2i", at // 2, len(body) // 2))
            at += 8 + len(body)
        if at >= 2**32:
            raise ValueError("a shapefile can't hold this much: use more partitions")
        files = {".shp": head(at) + b"".join(shp), ".shx": head(100 + 8 * len(shx)) + b"".join(shx), ".dbf": _dbf(columns, rows)}
        if self.crs:
            files[".prj"] = self.crs.encode()
        for end, data in files.items():
            with f.open_output_stream(base + end, compression=None) as out:
                out.write(data)
        return _Written(base, name)

    def _each(self, messages: list[_Written | None]) -> Iterator[tuple[fs.FileSystem, str, str]]:
        f, folder = _open(self.path)
        for m in messages:
            if m is not None and m.base is not None:
                for end in (".dbf", ".shx", ".prj", ".shp"):  # the geometry last: readers look for it
                    if f.get_file_info(m.base + end).type == fs.FileType.File:
                        yield f, m.base + end, f"{folder}/{m.name}{end}"

    def commit(self, messages: list[_Written | None]) -> None:
        for f, old, new in self._each(messages):
            f.move(old, new)

    def abort(self, messages: list[_Written | None]) -> None:
        for f, old, _ in self._each(messages):
            f.delete_file(old)


def _dbf(columns: list[str], rows: list[list[str]]) -> bytes:
    """Every attribute as text, cut to what a field can hold; names to ten bytes."""
    data = [[v.encode()[:254] for v in r] for r in rows]
    widths = [max([1, *(len(r[i]) for r in data)]) for i in range(len(columns))]
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(columns), 1 + sum(widths))
    head += b"".join(struct.pack("<11sc4xB15x", c.encode()[:10], b"C", w) for c, w in zip(columns, widths, strict=True)) + b"\r"
    return head + b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in data) + b"\x1a"


class Shapefile(DataSource):
    """spark.read.format("shapefile").load(file or folder); df.write.format("shapefile").mode("append").save(folder), option crs: the text of .prj."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return READ

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: object, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("crs"))
