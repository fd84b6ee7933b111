"""GeoPackage layers: each file of a path is read by a task of its own, in memory, so files have to stay below 2 GB."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import geometry as G

#: Fixed values of the format: bytes of the envelope by its code; kinds of geometry; rows that leave a task together.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
KINDS = {"POINT": 1, "LINESTRING": 2}
ROWS = 10_000


def vertices(blob: bytes | None, kind: str) -> list[dict] | None:
    """The vertices of a geometry of this kind, without heights and measures; None for any other, and for an empty one."""
    if not blob or blob[:2] != b"GP" or blob[3] >> 4 & 1:
        return None
    at = 8 + ENVELOPE[blob[3] >> 1 & 7]
    end = "<" if blob[at] == 1 else ">"
    (code,) = struct.unpack_from(end + "I", blob, at + 1)
    plain, more = code & 0xFFFF, bool(code & 0x80000000) + bool(code & 0x40000000)
    if plain % 1000 != KINDS[kind]:
        return None
    width = 2 + more + {0: 0, 1: 1, 2: 1, 3: 2}[plain // 1000]
    at += 5
    n = 1
    if kind == "LINESTRING":
        (n,) = struct.unpack_from(end + "I", blob, at)
        at += 4
    xy = np.frombuffer(blob, end + "f8", n * width, at).reshape(n, width)[:, :2]
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def layer_rows(content: bytes, layer: str | None, id_col: str, keep: tuple[str, ...], kind: str) -> Iterator[dict]:
    """Rows of a layer, the first by name unless given; values as text."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(content)
        layers = dict(con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name DESC"))
        name = layer if layer is not None else list(layers)[-1]
        quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in (id_col, layers[name], *keep))
        for row in con.execute(f'SELECT {quoted} FROM "{name.replace(chr(34), chr(34) * 2)}"'):
            yield {"id": None if row[0] is None else str(row[0]), "pts": vertices(row[1], kind), **{k: None if v is None else str(v) for k, v in zip(keep, row[2:], strict=True)}}
    finally:
        con.close()


def read_geopackage(spark: SparkSession, path: str, id_col: str, *, layer: str | None = None, srid: int | None = None, id_cast: str | None = "bigint", kind: str = "LINESTRING", keep: tuple[str, ...] = (), always_xy: bool = True) -> DataFrame:
    """(id, pts, kept columns as text) of a layer in the files of a path; pts is null for geometries of another kind."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("id", pa.string()), ("pts", pa.list_(point)), *((k, pa.string()) for k in keep)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for content in b.column("content"):
                rows: list[dict] = []
                for row in layer_rows(content.as_py(), layer, id_col, keep, kind):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    df = files.mapInArrow(run, f"id string, pts {G.LINE}" + "".join(f", `{k}` string" for k in keep))
    key = F.col("id").cast(id_cast) if id_cast else F.col("id")
    return df.select(key.alias("id"), G.to_metres(F.col("pts"), srid, always_xy).alias("pts"), *keep)
