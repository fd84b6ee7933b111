"""Shapefiles, each read by many tasks: the index file says where records lie, so a task reads only its own bytes.

A Python data source (Spark's DataSource API). Paths are local to all machines or URIs that pyarrow's file systems open
(file, hdfs, s3, gs); nothing is copied whole to a machine.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roadweave.functions import geometry as G

#: Fixed values of the format: length of the header and of an index entry; kinds of shape, by what they are without height and measure.
HEADER, ENTRY = 100, 8
KINDS = {1: "POINT", 11: "POINT", 21: "POINT", 3: "LINESTRING", 13: "LINESTRING", 23: "LINESTRING"}
ROWS = 8192
SCHEMA = f"record long, part int, kind string, pts {G.LINE}, attributes map<string,string>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.schema([("record", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("pts", pa.list_(_POINT)), ("attributes", pa.map_(pa.string(), pa.string()))])


class Records(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def _opened(path: str):
    fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return fs, name


def shapes(content: bytes) -> Iterator[tuple[str | None, np.ndarray | None]]:
    """(kind, places) of each part of a record's shape; a shape of another kind has one part without places."""
    (code,) = struct.unpack_from("<i", content)
    kind = KINDS.get(code)
    if kind == "POINT":
        yield kind, np.frombuffer(content, "<f8", 2, 4).reshape(1, 2)
    elif kind == "LINESTRING":
        parts, points = struct.unpack_from("<2i", content, 36)
        starts = [*np.frombuffer(content, "<i4", parts, 44).tolist(), points]
        xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
        for a, b in zip(starts, starts[1:], strict=False):
            yield kind, xy[a:b]
    else:
        yield None, None


class Attributes:
    """The table beside the shapes: fixed fields at fixed places."""

    def __init__(self, fs, name: str, encoding: str):
        self.file = fs.open_input_file(name)
        head = self.file.read_at(32, 0)
        self.start, self.width = struct.unpack_from("<2H", head, 8)
        self.encoding, self.fields, at = encoding, [], 1
        raw = self.file.read_at(self.start - 32, 32)
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            self.fields.append((raw[k : k + 11].split(b"\0")[0].decode(encoding, "replace"), at, at + raw[k + 16]))
            at += raw[k + 16]

    def rows(self, first: int, count: int) -> list[list[tuple[str, str | None]]]:
        raw = self.file.read_at(count * self.width, self.start + first * self.width)
        row = lambda k: raw[k * self.width : (k + 1) * self.width]
        return [[(n, row(k)[a:b].decode(self.encoding, "replace").strip("\0 ") or None) for n, a, b in self.fields] for k in range(count)]


class ShapefileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes, self.encoding = options["path"], int(options.get("bytes", 32 << 20)), options.get("encoding", "utf-8")

    def partitions(self) -> list[Records]:
        """Runs of records, of about `bytes` bytes of shapes each, of every file of the path."""
        fs, name = _opened(self.path)
        info = fs.get_file_info(name)
        files = [name] if info.type == pa.fs.FileType.File else sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(name)) if f.path.lower().endswith(".shp"))
        if not files:
            raise ValueError(f"no shapefile at {self.path}")
        out = []
        for f in files:
            records = (fs.get_file_info(f[:-4] + ".shx").size - HEADER) // ENTRY
            parts = max(1, math.ceil(fs.get_file_info(f).size / self.bytes))
            cuts = np.linspace(0, records, parts + 1).astype(int).tolist()
            out += [Records(f, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        index, shp = fs.open_input_file(partition.path[:-4] + ".shx"), fs.open_input_file(partition.path)
        table = Attributes(fs, partition.path[:-4] + ".dbf", self.encoding)
        for at in range(partition.first, partition.first + partition.count, ROWS):
            count = min(ROWS, partition.first + partition.count - at)
            places = np.frombuffer(index.read_at(count * ENTRY, HEADER + at * ENTRY), ">i4").reshape(count, 2).astype(np.int64) * 2
            low, high = int(places[:, 0].min()), int((places[:, 0] + places[:, 1]).max()) + 8
            together = high - low <= 2 * int(places[:, 1].sum()) + 16 * count  # records lie together but for odd writers
            block = shp.read_at(high - low, low) if together else b""
            out: dict[str, list] = {c: [] for c in ARROW.names}
            for k, fields in enumerate(table.rows(at, count)):
                offset, size = places[k].tolist()
                content = block[offset - low + 8 : offset - low + 8 + size] if together else shp.read_at(size, offset + 8)
                for part, (kind, xy) in enumerate(shapes(content)):
                    pts = None if xy is None else [{"x": x, "y": y} for x, y in xy.tolist()]
                    for c, v in zip(out, (at + k, part, kind, pts, fields), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=ARROW)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadweave-shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)


def read_shapefile(spark: SparkSession, path: str, id_col: str, *, srid: int | None = None, id_cast: str | None = "bigint", kind: str = "LINESTRING", keep: tuple[str, ...] = (), always_xy: bool = True, encoding: str = "utf-8", split_bytes: int = 32 << 20) -> DataFrame:
    """(id, part, pts, kept columns as text) of a shapefile or of all in a folder.

    A shape of several parts gives a row for each, numbered by `part`; pts is null for shapes of another kind.
    """
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("roadweave-shapefile").options(path=path, encoding=encoding, bytes=str(split_bytes)).load()
    key = F.col("attributes")[id_col]
    pts = F.when(F.col("kind") == kind, F.col("pts"))
    return df.select((key.cast(id_cast) if id_cast else key).alias("id"), "part", G.to_metres(pts, srid, always_xy).alias("pts"), *(F.col("attributes")[k].alias(k) for k in keep))
