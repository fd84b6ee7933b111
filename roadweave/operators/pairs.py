"""Mode 2: ranked pairs of edges by warping distance, and the symmetric reconciliation of both directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import dtw
from roadweave.operators.components import connected_components
from roadweave.operators.resolve import PLACES
from roadweave.operators.spatial import within_join
from roadweave.plans.scratch import Scratch

#: Names of the output columns.
METRICS = ("dtw_distance", "max_dtw_distance", "min_dtw_distance", "bearing_diff", "overlap_pct", "matched_len")
COLUMNS = ("source_id", "dest_id", "dtw_distance", "max_dtw_distance", "min_dtw_distance", "bearing_diff", "overlap_pct", "rank", "match_type")


def _metrics(a: tuple, b: tuple, undirected: bool) -> dict[str, np.ndarray]:
    """Warps rows of (xy, bounds) pairwise, those with equal vertex counts together."""
    (xa, ca), (xb, cb) = a, b
    na, nb = np.diff(ca), np.diff(cb)
    got = {k: np.zeros(len(na)) for k in ("dtw", "max", "min", "overlap", "matched", "bearing")}
    for n, m in {*zip(na.tolist(), nb.tolist(), strict=True)}:
        rows = np.flatnonzero((na == n) & (nb == m))
        at = lambda xy, c, k: xy[c[rows][:, None] + np.arange(k)]  # noqa: B023, E731
        if n and m:
            for k, v in dtw.warp(at(xa, ca, n), at(xb, cb, m), undirected).items():
                got[k][rows] = v
    return got


def evaluate(candidates: DataFrame, undirected: bool = False) -> DataFrame:
    """(id_a, id_b, metrics) of rows (id_a, pts_a, id_b, pts_b); no shuffle: rows are warped where they are."""
    kinds = dict(candidates.dtypes)
    schema = f"id_a {kinds['id_a']}, id_b {kinds['id_b']}, dtw_distance double, max_dtw_distance double, min_dtw_distance double, bearing_diff double, overlap_pct long, matched_len double"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = _metrics(dtw.vertices(b.column("pts_a")), dtw.vertices(b.column("pts_b")), undirected)
            cols = [b.column("id_a"), b.column("id_b"), *(pa.array(got[k]) for k in ("dtw", "max", "min", "bearing")), pa.array(got["overlap"].astype(np.int64)), pa.array(got["matched"])]
            yield pa.RecordBatch.from_arrays(cols, names=["id_a", "id_b", *METRICS])

    rows = candidates.where((F.size("pts_a") > 0) & (F.size("pts_b") > 0))
    return rows.select("id_a", "pts_a", "id_b", "pts_b").mapInArrow(run, schema)


def evaluate_both_ways(candidates: DataFrame) -> DataFrame:
    """(a_id, b_id, and of A on B and of B on A, whatever way lines are drawn: distance, percent, metres; turn of A on B)."""
    kinds = dict(candidates.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in parts:
            a, b = dtw.vertices(r.column("pts_a")), dtw.vertices(r.column("pts_b"))
            there, back = _metrics(a, b, True), _metrics(b, a, True)
            whole = lambda x: pa.array(x.astype(np.int64))
            cols = [r.column("id_a"), r.column("id_b"), pa.array(there["dtw"]), pa.array(there["bearing"]), whole(there["overlap"]), pa.array(there["matched"]), pa.array(back["dtw"]), whole(back["overlap"]), pa.array(back["matched"])]
            yield pa.RecordBatch.from_arrays(cols, names=["a_id", "b_id", "da", "turn", "ov_ab", "ma", "db", "ov_ba", "mb"])

    rows = candidates.where((F.size("pts_a") > 0) & (F.size("pts_b") > 0))
    return rows.select("id_a", "pts_a", "id_b", "pts_b").mapInArrow(run, f"a_id {kinds['id_a']}, b_id {kinds['id_b']}, da double, turn double, ov_ab long, ma double, db double, ov_ba long, mb double")


def reconcile(evaluated: DataFrame, max_angle: float = 180.0, min_overlap: float = 0) -> DataFrame:
    """Pairs that pass both gates, ranked by distance; all pairs of a source with several are 1:N_SPLIT."""
    by = Window.partitionBy("id_a")
    ok = evaluated.where((F.col("bearing_diff") <= max_angle) & (F.col("overlap_pct") >= min_overlap))
    ok = ok.withColumn("rank", F.row_number().over(by.orderBy(F.round("dtw_distance", PLACES), "id_b")).cast("long"))
    ok = ok.withColumn("match_type", F.when(F.count("*").over(by) > 1, "1:N_SPLIT").otherwise("1:1_SYMMETRIC"))
    return ok.withColumnRenamed("id_a", "source_id").withColumnRenamed("id_b", "dest_id").select(*COLUMNS)


def with_unmatched(results: DataFrame, ids: DataFrame) -> DataFrame:
    """The results, read once, and a NO_MATCH row for each id without any."""
    every = ids.select(F.col("id").alias("source_id")).distinct().join(results, "source_id", "left")
    return every.withColumn("match_type", F.when(F.col("dest_id").isNull(), "NO_MATCH").otherwise(F.col("match_type"))).select(*results.columns)


def match(a: DataFrame, b: DataFrame, max_distance: float = 25.0, max_angle: float = 180.0, min_overlap: float = 0) -> DataFrame:
    """Candidates, warping, ranking, and a NO_MATCH row for each source without any; pairs are warped once."""
    return with_unmatched(reconcile(evaluate(within_join(a, b, max_distance)), max_angle, min_overlap), a)


def unmatched_destinations(results: DataFrame, b: DataFrame) -> DataFrame:
    used = results.where(F.col("dest_id").isNotNull()).select(F.col("dest_id").alias("id")).distinct()
    return b.select("id").distinct().join(used, "id", "left_anti").withColumnRenamed("id", "dest_id")


def cardinality(pairs: DataFrame) -> DataFrame:
    """Adds `cardinality`: how many sources and destinations the pair's component has. The pairs are read three times: pass a written table."""
    end = lambda side: F.concat(F.lit(f"{side}:"), F.col(f"{side}_id").cast("string"))
    ends = pairs.select(end("a").alias("u"), end("b").alias("v"))
    parts = connected_components(ends)
    placed = pairs.withColumn("node", end("a")).join(parts, "node").drop("node")
    sizes = placed.groupBy("component").agg(F.countDistinct("a_id").alias("na"), F.countDistinct("b_id").alias("nb"))
    kind = F.when((F.col("na") == 1) & (F.col("nb") == 1), "1:1").when(F.col("na") == 1, "1:N_SPLIT").when(F.col("nb") == 1, "N:1_MERGE").otherwise("N:M_COMPLEX")
    return placed.join(sizes, "component").withColumn("cardinality", kind).drop("component", "na", "nb")


def match_symmetric(a: DataFrame, b: DataFrame, max_distance: float = 25.0, max_dtw: float | None = None, max_angle: float = 45.0, min_overlap_m: float = 5.0, sym_overlap: float = 70.0) -> DataFrame:
    """Pairs that agree in both directions, with their relation and their component's cardinality."""
    p = evaluate_both_ways(within_join(a, b, max_distance)).select(
        "a_id", "b_id", F.least("da", "db").alias("dtw"), "turn", "ov_ab", "ov_ba", F.bround(F.greatest("ma", "mb"), 1).alias("matched_len_m"),
        F.greatest("ov_ab", "ov_ba").alias("containment"), F.least("ov_ab", "ov_ba").alias("symmetry"),
    )
    p = p.where((F.col("dtw") <= (max_distance if max_dtw is None else max_dtw)) & (F.col("turn") <= max_angle) & (F.col("matched_len_m") >= min_overlap_m))
    p = p.withColumn("relation", F.when(F.col("symmetry") >= sym_overlap, "1:1").when(F.col("ov_ba") >= F.col("ov_ab"), "split").otherwise("merge"))
    p = p.withColumn("bearing_diff", F.bround("turn", 1)).drop("turn")
    p = Scratch(a.sparkSession, "symmetric").table(p, "pairs")
    return cardinality(p).select("a_id", "b_id", "dtw", "bearing_diff", "ov_ab", "ov_ba", "matched_len_m", "containment", "symmetry", "relation", "cardinality")


def single_path(groups: DataFrame, snap: float = 1.0) -> DataFrame:
    """(group, valid) of rows (group, pts): whether a group's edges form one open path; a single edge always does."""
    key = lambda p: F.concat_ws(",", F.round(p["x"] / snap).cast("long").cast("string"), F.round(p["y"] / snap).cast("long").cast("string"))
    e = groups.select("group", key(F.element_at("pts", 1)).alias("p"), key(F.element_at("pts", -1)).alias("q"))
    sizes = e.groupBy("group").agg(F.count("*").alias("n"))
    name = lambda c: F.concat_ws("|", F.col("group").cast("string"), c)
    parts = connected_components(e.select(name("p").alias("u"), name("q").alias("v")))
    ends = e.select("group", F.explode(F.array("p", "q")).alias("k")).groupBy("group", "k").agg(F.count("*").alias("degree"))
    ends = ends.withColumn("node", name("k")).join(parts, "node")
    facts = ends.groupBy("group").agg(F.countDistinct("component").alias("parts"), F.max("degree").alias("most"), F.sum((F.col("degree") == 1).cast("int")).alias("loose"))
    return sizes.join(facts, "group").select("group", ((F.col("n") == 1) | ((F.col("parts") == 1) & (F.col("most") <= 2) & (F.col("loose") == 2))).alias("valid"))
