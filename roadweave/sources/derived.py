"""Road-like geometry that follows from the star-schema tables, so that every query runs on any scale of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions import geometry as G


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corner(o: str):
    return ((F.col(o) % 40) * 100).cast("double"), (F.floor(F.col(o) / 40) * 60).cast("double")


def a_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One straight edge for each order."""
    x, y = _corner("o_orderkey")
    oneway = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("-1")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(G.point(x, y), G.point(x + 90.0, y)).alias("pts"), oneway.alias("oneway"))


def b_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of edges for each order, one for each of its lines."""
    by = Window.partitionBy("l_orderkey")
    k = F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", k.alias("k"), F.count("*").over(by).alias("n"))
    x, y = _corner("l_orderkey")

    def at(j):
        return G.point(x + F.lit(90.0) * j / F.col("n"), y + ((F.col("l_orderkey") * 31 + j * 17) % 11 - 5))

    return lines.select((F.col("l_orderkey") * 100 + F.col("k")).alias("id"), F.array(at(F.col("k") - 1), at(F.col("k"))).alias("pts"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each event."""
    x, y = _corner("event_id")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(G.point(x + F.col("value") % 90.0, y + (F.col("user_id") % 13 - 6))).alias("pts"))


#: The same tables in DuckDB: bp has the two ends of each B-edge, ae each A-edge, pt each point.
SQL = """
bp AS (
  SELECT l_orderkey AS o, l_orderkey * 100 + k AS id, (l_orderkey % 40) * 100 + 90.0::DOUBLE * (k - 1) / n AS x1, (l_orderkey // 40) * 60 + ((l_orderkey * 31 + (k - 1) * 17) % 11 - 5)::DOUBLE AS y1,
         (l_orderkey % 40) * 100 + 90.0::DOUBLE * k / n AS x2, (l_orderkey // 40) * 60 + ((l_orderkey * 31 + k * 17) % 11 - 5)::DOUBLE AS y2
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
), ae AS (
  SELECT o_orderkey AS id, ((o_orderkey % 40) * 100)::DOUBLE AS x1, ((o_orderkey // 40) * 60)::DOUBLE AS y1, ((o_orderkey % 40) * 100 + 90)::DOUBLE AS x2, ((o_orderkey // 40) * 60)::DOUBLE AS y2,
         CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE '-1' END AS oneway
  FROM orders
), pt AS (
  SELECT event_id AS id, (event_id % 40) * 100 + value % 90.0::DOUBLE AS x, (event_id // 40) * 60 + (user_id % 13 - 6)::DOUBLE AS y FROM events
)"""


#: Streets of four kinds, chosen by a customer's key: part, then three vertices, about the corner of the key's block.
#: A bend that the other side cuts in two, a cut that the other side lacks (and a stub at it), a fork, and a block with two ways round.
A_SHAPES = {
    0: [(0, 0, 0, 45, 7, 90, 0)],
    1: [(0, 0, 0, 20, 2, 40, 3), (1, 40, 3, 66, 3, 90, 0)],
    2: [(0, 0, 0, 15, 1, 30, 0), (1, 30, 0, 60, 10, 90, 14), (2, 30, 0, 60, -10, 90, -14)],
    3: [(0, 0, 0, 8, 0, 15, 0), (1, 15, 0, 45, 12, 75, 0), (2, 15, 0, 45, -12, 75, 0), (3, 75, 0, 82, 0, 90, 0)],
}
B_SHAPES = {
    0: [(0, 0, 0, 20, 4, 42, 6), (1, 42, 6, 70, 5, 90, 0)],
    1: [(0, 0, 0, 40, 3, 90, 0), (1, 40, 3, 41, 12, 42, 22)],
    2: [(0, 0, 0, 15, 0, 28, 0), (1, 28, 0, 45, 5, 60, 9), (2, 60, 9, 75, 12, 90, 14), (3, 28, 0, 60, -9, 90, -14)],
    3: [(0, 0, 0, 7.3, 1, 14, 0), (1, 14, 0, 30, 7, 45, 11), (2, 45, 11, 60, 7, 76, 0), (3, 14, 0, 45, -11, 76, 0), (4, 76, 0, 83, 0, 90, 0)],
}


def _roads(spark: SparkSession, sf_dir: str, shapes: dict, dx, dy) -> DataFrame:
    form = spark.createDataFrame([(k, *map(float, row)) for k, rows in shapes.items() for row in rows], "kind long, part double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    x, y = _corner("c_custkey")
    at = lambda k: G.point(x + dx + F.col(f"x{k}"), y + dy + F.col(f"y{k}"))
    keys = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("kind"))
    return keys.join(F.broadcast(form), "kind").select((F.col("c_custkey") * 10 + F.col("part").cast("long")).alias("id"), F.array(at(1), at(2), at(3)).alias("pts"))


def a_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with junctions, forks and blocks, one network for each customer."""
    return _roads(spark, sf_dir, A_SHAPES, F.lit(0.0), F.lit(0.0))


def b_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streets drawn with other cuts, a little aside."""
    return _roads(spark, sf_dir, B_SHAPES, (F.col("c_custkey") * 17 % 7 - 3) * 0.43 + 0.11, (F.col("c_custkey") * 31 % 11 - 5) * 0.37)


def _values(shapes: dict) -> str:
    return ", ".join("(" + ", ".join(map(str, (k, *row))) + ")" for k, rows in shapes.items() for row in rows)


def _road_sql(shapes: dict, dx: str, dy: str) -> str:
    at = ", ".join(f"((c_custkey % 40) * 100)::DOUBLE + {dx} + f.x{k} AS x{k}, ((c_custkey // 40) * 60)::DOUBLE + {dy} + f.y{k} AS y{k}" for k in (1, 2, 3))
    return f"SELECT c_custkey AS o, c_custkey * 10 + part AS id, {at} FROM customer JOIN (VALUES {_values(shapes)}) f(kind, part, x1, y1, x2, y2, x3, y3) ON kind = c_custkey % 4"


#: a_roads and b_roads in DuckDB.
ROADS_SQL = f"ar AS ({_road_sql(A_SHAPES, '0', '0')}), br AS ({_road_sql(B_SHAPES, '(c_custkey * 17 % 7 - 3) * 0.43::DOUBLE + 0.11::DOUBLE', '(c_custkey * 31 % 11 - 5) * 0.37::DOUBLE')})"
