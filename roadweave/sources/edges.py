"""Edge and point tables: WKT files, GeoJSON, parquet or any DataFrame, in the form (id, pts, further columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions import geometry as G
from roadweave.plans.scratch import Scratch


def bind(df: DataFrame, id_col: str, geom: str | Column, *, srid: int | None = None, id_cast: str | None = None, kind: str = "LINESTRING", keep: tuple[str, ...] = (), always_xy: bool = True) -> DataFrame:
    """(id, pts, kept columns): any relation with an id and a WKT or vertex column; pts is null unless it is of `kind`."""
    geom = F.col(geom) if isinstance(geom, str) else geom
    pts = G.from_wkt(geom, kind) if dict(df.select(geom.alias("g")).dtypes)["g"] == "string" else geom.cast(G.LINE)
    key = F.col(id_col).cast(id_cast) if id_cast else F.col(id_col)
    return df.select(key.alias("id"), G.to_metres(pts, srid, always_xy).alias("pts"), *keep)


def read_wkt_csv(spark: SparkSession, path: str, id_col: str, *, geom_col: str = "geometry", srid: int | None = None, id_cast: str | None = "bigint", kind: str = "LINESTRING", keep: tuple[str, ...] = (), always_xy: bool = True) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    return bind(df, id_col, geom_col, srid=srid, id_cast=id_cast, kind=kind, keep=keep, always_xy=always_xy)


def read_geojson(spark: SparkSession, path: str, id_col: str, *, srid: int | None = None, id_cast: str | None = None, kind: str = "LineString", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of a collection; ids and kept columns are properties, geometries of other kinds get null pts."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.option("multiLine", True).schema(shape).json(path).select(F.explode("features").alias("f"))
    xy = F.from_json(F.col("f.geometry.coordinates"), "array<array<double>>" if kind == "LineString" else "array<double>")
    pts = F.transform(xy, lambda p: G.point(p[0], p[1])) if kind == "LineString" else F.array(G.point(xy[0], xy[1]))
    pts = F.when(F.col("f.geometry.type") == kind, pts)
    key = F.col("f.properties")[id_col]
    return f.select((key.cast(id_cast) if id_cast else key).alias("id"), G.to_metres(pts, srid).alias("pts"), *(F.col("f.properties")[k].alias(k) for k in keep))


def directed(edges: DataFrame, oneway: str = "oneway") -> DataFrame:
    """A row for each travel direction: forward unless '-1', reversed for 'no' and '-1'; a null oneway gives none."""
    ahead = edges.where(F.col(oneway) != "-1").withColumn("is_reverse", F.lit(False))
    back = edges.where(F.col(oneway).isin("no", "-1")).withColumn("pts", G.reversed_line(F.col("pts"))).withColumn("is_reverse", F.lit(True))
    both = ahead.unionByName(back).withColumnRenamed("id", "original_edge_id")
    return both.withColumn("directed_id", F.concat_ws(":", F.col("original_edge_id").cast("string"), F.when(F.col("is_reverse"), "r").otherwise("f")))


#: Tags that mean one direction, and kinds of junction that do.
ONE_WAY, ROUND = ("yes", "true", "1", "-1"), ("roundabout", "circular")


def is_oneway(tag: str | Column) -> Column:
    """Whether a tag says that a road is open in one direction only; a null tag doesn't."""
    return F.coalesce(F.lower((F.col(tag) if isinstance(tag, str) else tag).cast("string")).isin(*ONE_WAY), F.lit(False))


def is_roundabout(junction: str | Column) -> Column:
    return F.coalesce(F.lower((F.col(junction) if isinstance(junction, str) else junction).cast("string")).isin(*ROUND), F.lit(False))


def one_direction(directed_edges: DataFrame, original: str = "original_edge_id") -> DataFrame:
    """Rows whose original edge has a single direction."""
    return directed_edges.join(directed_edges.groupBy(original).agg(F.count("*").alias("_n")).where("_n = 1").select(original), original, "left_semi")


def two_directions(directed_edges: DataFrame, original: str = "original_edge_id", reverse: str = "is_reverse") -> DataFrame:
    """One row, the one along the drawing, of each original edge with both directions."""
    both = directed_edges.groupBy(original).agg(F.count("*").alias("_n")).where("_n = 2").select(original)
    return directed_edges.join(both, original, "left_semi").where(F.lower(F.col(reverse).cast("string")) == "false")


def numbered(directed_edges: DataFrame, order: tuple[str, ...] = ("original_edge_id", "is_reverse")) -> DataFrame:
    """Adds directed_number, 1, 2, 3, ... in the given order: parts of a range-sorted table are counted first, so no task sorts all."""
    rows = Scratch(directed_edges.sparkSession, "numbers").table(directed_edges.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rows")
    w = Window.partitionBy("_part").orderBy(*order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    firsts = sizes.select("_part", before.alias("_before"))
    return rows.withColumn("_k", F.row_number().over(w)).join(F.broadcast(firsts), "_part").withColumn("directed_number", F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def to_wkt_csv(edges: DataFrame, path: str) -> None:
    edges.withColumn("geometry", G.to_wkt(F.col("pts"))).drop("pts").write.mode("overwrite").option("header", True).csv(path)


def to_geojson_rows(edges: DataFrame) -> DataFrame:
    """A feature for each row, as JSON text."""
    xy = F.transform("pts", lambda p: F.array(p["x"], p["y"]))
    rest = [c for c in edges.columns if c != "pts"]
    return edges.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))
