"""Shapefiles by many tasks, and routes of edges that arrive in batches."""

import random
import struct

from pyspark.sql import functions as F

from roadweave.operators import routes
from roadweave.sources.shapefile import read_shapefile
from roadweave.streaming.routes import route_stream

from .conftest import lines


def write_shapefile(path, rows, code=3, shuffle=False):
    """rows: (name, list of parts, or None); plain writer of the published format, heights and measures for 13."""
    body, index, table = b"", [], b""
    order = list(range(len(rows)))
    if shuffle:
        random.Random(1).shuffle(order)
    places = {}
    for k in order:
        parts = rows[k][1]
        if parts is None:
            content = struct.pack("<i", 0)
        elif code == 1:
            content = struct.pack("<i2d", 1, *parts[0][0])
        else:
            points = [p for part in parts for p in part]
            starts = [sum(map(len, parts[:j])) for j in range(len(parts))]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            content = struct.pack("<i4d2i", code, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
            if code == 13:
                content += struct.pack(f"<2d{len(points)}d", 0, 9, *([5.0] * len(points)))
        places[k] = (100 + len(body), len(content))
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, code, *[0.0] * 8)
    index = b"".join(struct.pack(">2i", a // 2, n // 2) for a, n in (places[k] for k in range(len(rows))))
    fields = [("fid", 8), ("name", 12)]
    width = 1 + sum(n for _, n in fields)
    table = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    table += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, size in fields) + b"\r"
    for k, (name, _) in enumerate(rows):
        table += b" " + str(k).rjust(8).encode() + name.encode()[:12].ljust(12)
    for end, content in (("shp", head(100 + len(body)) + body), ("shx", head(100 + len(index)) + index), ("dbf", table)):
        with open(f"{path}.{end}", "wb") as f:
            f.write(content)


def test_one_shapefile_is_read_by_many_tasks(spark, tmp_path):
    draw = random.Random(2)
    line = lambda: [(draw.uniform(0, 100), draw.uniform(0, 100)) for _ in range(draw.randint(2, 9))]
    rows = [(f"väg {k}", [line() for _ in range(1 if k % 7 else 2)] if k % 50 else None) for k in range(2000)]
    for code, shuffle in ((3, False), (13, True)):
        path = str(tmp_path / f"roads{code}.shp")
        write_shapefile(path[:-4], rows, code, shuffle)
        df = read_shapefile(spark, path, "fid", keep=("name",), split_bytes=20_000)
        assert df.rdd.getNumPartitions() > 5
        got = {(r.id, r.part): (r.name, r.pts and [(p.x, p.y) for p in r.pts]) for r in df.collect()}
        want = {(k, j): (name, part) for k, (name, parts) in enumerate(rows) for j, part in enumerate(parts or [None])}
        assert got == want
    both = read_shapefile(spark, str(tmp_path), "fid")
    assert both.count() == 2 * len(want) and read_shapefile(spark, "file://" + path, "fid").where("id < 10").count() == sum(k[0] < 10 for k in want)
    assert read_shapefile(spark, path, "fid", kind="POINT").where("pts is not null").count() == 0
    write_shapefile(str(tmp_path / "points"), [("a", [[(1.5, 2.5)]]), ("b", None)], code=1)
    p = read_shapefile(spark, str(tmp_path / "points.shp"), "fid", kind="POINT").orderBy("id").collect()
    assert [(r.id, r.pts and (r.pts[0].x, r.pts[0].y)) for r in p] == [(0, (1.5, 2.5)), (1, None)]


def test_streamed_routes_equal_one_run(spark, tmp_path):
    a = {k: [(100.0 * k, 0), (100.0 * k + 60, 4 * (k % 3))] for k in range(12)}
    b = {10 * k + j: [(100.0 * k + 30 * j - 2, 1), (100.0 * k + 30 * j + 28, 1)] for k in range(11) for j in range(2)}
    source, network = lines(spark, a), lines(spark, b)
    folder = str(tmp_path / "in")
    for k in range(3):
        source.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):  # a second start has nothing left to do
        q = route_stream(arriving, network, str(tmp_path / "out"), str(tmp_path / "check"), step=5.0)
        q.processAllAvailable()
        q.stop()
    long, summary = routes.match_routes(source, network, step=5.0)
    for name, want in (("long", long), ("summary", summary)):
        got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out" / name))
        assert got.select("batch_id").distinct().count() == 3
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
