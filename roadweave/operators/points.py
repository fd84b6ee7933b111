"""Mode 4: points snapped to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import geometry as G
from roadweave.operators.resolve import PLACES
from roadweave.operators.spatial import within_join

#: Names of the output columns.
COLUMNS = ("source_id", "dest_id", "distance_m", "position_pct", "edge_bearing_deg", "snap_wkt", "rank", "match_type")


def snap_candidates(points: DataFrame, edges: DataFrame, max_distance: float = 25.0) -> DataFrame:
    """Each point and each edge at most `max_distance` from it: where on the edge it falls, and the edge's bearing there."""
    pairs = within_join(points, edges, max_distance, exact=False)
    on = pairs.withColumn("at", G.project(F.col("pts_b"), F.col("pts_a")[0])).where(F.col("at.d") <= max_distance)
    on = on.withColumn("len", G.length(F.col("pts_b")))
    s, line = F.col("at.s"), F.col("pts_b")
    on = on.withColumn("snap", G.interpolate(line, s))
    ahead = G.bearing(G.interpolate(line, F.greatest(s - 1.0, F.lit(0.0))), G.interpolate(line, F.least(s + 1.0, F.col("len"))))
    return on.select(
        F.col("id_a").alias("source_id"), F.col("id_b").alias("dest_id"), F.col("at.d").alias("distance_m"),
        F.when(F.col("len") > 0, 100.0 * s / F.col("len")).otherwise(0.0).alias("position_pct"), ahead.alias("edge_bearing_deg"), G.to_wkt(F.array("snap")).alias("snap_wkt"),
    )


def match_points(points: DataFrame, edges: DataFrame, max_distance: float = 25.0) -> DataFrame:
    """Ranked candidates of each point, and a NO_MATCH row for each point without any; candidates are found once."""
    near = points.select(F.col("id").alias("source_id")).distinct().join(snap_candidates(points, edges, max_distance), "source_id", "left")
    by = Window.partitionBy("source_id")
    lost = F.col("dest_id").isNull()
    ranked = near.withColumn("rank", F.when(~lost, F.row_number().over(by.orderBy(F.round("distance_m", PLACES), "dest_id"))).cast("long"))
    kind = F.when(lost, "NO_MATCH").when(F.count("*").over(by) > 1, "1:N_CANDIDATES").otherwise("1:1")
    return ranked.withColumn("match_type", kind).select(*COLUMNS)
