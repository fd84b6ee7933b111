"""Checks of the target network, diagnosis of pairs, and issue records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import geometry as G
from roadweave.operators.spatial import nearest_other, within_join
from roadweave.plans.scratch import Scratch


def check_network(edges: DataFrame, tolerances: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0), reach: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(one row of figures on gaps from each endpoint to the nearest other one, degenerate edges with the reason).

    Percentiles are of gaps above 0, at whatever distance; `reach` is only where the search begins. Edges without two
    vertices have no endpoints.
    """
    ends = edges.where(F.size("pts") > 1).select(F.posexplode(F.array(F.element_at("pts", 1), F.element_at("pts", -1))).alias("k", "p"), "id")
    ends = ends.select(F.concat_ws(":", F.col("id").cast("string"), F.col("k").cast("string")).alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    gap = nearest_other(Scratch(edges.sparkSession, "ends").table(ends, "ends"), reach)
    apart = F.when(F.col("gap") > 1e-9, F.col("gap"))
    near = [F.count_if(apart <= t).alias("near_" + f"{t:g}".replace(".", "_")) for t in tolerances]
    figures = gap.agg(F.count("*").alias("n_endpoints"), F.count_if(F.col("gap") <= 1e-9).alias("exact_shared"), *near, *(F.percentile(apart, p / 100).alias(f"gap_p{p}") for p in (50, 75, 90, 95)))
    steps = F.transform(G.segments(F.col("pts")), lambda s: G.distance(s["a"], s["b"]))
    same = F.size(F.filter(steps, lambda d: d < 1e-9))
    none = F.coalesce((F.size("pts") < 2) | (G.length(F.col("pts")) == 0), F.lit(True))
    why = F.when(none, "zero_length").when(same > 0, F.concat(same.cast("string"), F.lit("_duplicate_vertices")))
    bad = edges.select("id", why.alias("reason"))
    counts = bad.agg(F.count("*").alias("n_edges"), F.count("reason").alias("n_degenerate"))
    figures = counts.withColumn("k", F.lit(1)).join(figures.withColumn("k", F.lit(1)), "k").drop("k")
    return figures, bad.where("reason is not null")


def diagnose(evaluated: DataFrame, results: DataFrame, max_angle: float, min_overlap: float) -> DataFrame:
    """Evaluated pairs with each gate's outcome, and what the source was matched to."""
    got = results.where(F.col("rank") == 1).select(F.col("source_id").alias("id_a"), F.col("dest_id").alias("matched_to"))
    say = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return evaluated.join(got, "id_a", "left").withColumns({"angle_gate": say(F.col("bearing_diff") <= max_angle), "overlap_gate": say(F.col("overlap_pct") >= min_overlap), "is_match": F.coalesce(F.col("id_b") == F.col("matched_to"), F.lit(False))})


#: Kinds of issue, with their severity and what they say.
KINDS = {
    "oneway_direction_conflict": ("warning", "both sides run one way, in opposite directions"),
    "unmatched_source": ("info", "no counterpart on the other side"),
    "geometry_mismatch": ("warning", "matched, but farther apart than expected"),
    "cardinality_complex": ("info", "part of a tangle of several sources and destinations"),
}
REVIEW = "struct<status:string,suggestion:map<string,string>,note:string>"


def issues(pairs: DataFrame, unmatched: DataFrame, max_drift: float = 10.0, reviewed: DataFrame | None = None, raw_a: DataFrame | None = None, raw_b: DataFrame | None = None) -> DataFrame:
    """(id, type, severity, summary, members, evidence, review): records of pairs and sources to look at.

    members: of each side its id and, from raw_a and raw_b (id and any columns), the row as it was, as JSON. evidence: the
    figures that the record rests on. review (struct of status, suggestion, note) is kept by id from `reviewed`; the rest is
    made anew each time.
    """
    word = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def of(rows: DataFrame, kind: str, a, b, figures: tuple[str, ...]) -> DataFrame:
        severity, says = KINDS[kind]
        evidence = F.map_from_arrays(F.array(*map(F.lit, figures)), F.array(*map(word, figures))) if figures else F.lit(None).cast("map<string,string>")
        return rows.select(F.concat_ws(":", F.lit(kind), a, b).alias("id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(says).alias("summary"), a.alias("a"), b.alias("b"), evidence.alias("evidence"))

    two = (word("a_id"), word("b_id"))
    figures = tuple(c for c in ("dtw", "bearing_diff", "ov_ab", "ov_ba", "matched_len_m", "relation", "cardinality") if c in pairs.columns)
    found = of(pairs.where(F.col("bearing_diff") > 135), "oneway_direction_conflict", *two, figures)
    found = found.unionByName(of(pairs.where(F.col("dtw") > max_drift), "geometry_mismatch", *two, figures))
    found = found.unionByName(of(pairs.where(F.col("cardinality") == "N:M_COMPLEX"), "cardinality_complex", *two, figures))
    found = found.unionByName(of(unmatched, "unmatched_source", word("source_id"), none, ()))
    for side, raw in (("a", raw_a), ("b", raw_b)):
        if raw is None:
            found = found.withColumn(f"raw_{side}", none)
        else:
            found = found.join(raw.select(word("id").alias(side), F.to_json(F.struct("*")).alias(f"raw_{side}")), side, "left")
    member = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.col(side).alias("id"), F.col(f"raw_{side}").alias("raw")))
    found = found.withColumn("members", F.struct(member("a").alias("a"), member("b").alias("b"))).drop("a", "b", "raw_a", "raw_b")
    if reviewed is None:
        return found.select("id", "type", "severity", "summary", "members", "evidence", F.lit(None).cast(REVIEW).alias("review"))
    return found.join(reviewed.select("id", "review"), "id", "left").select("id", "type", "severity", "summary", "members", "evidence", "review")


def pair_figures(spark: SparkSession, a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """How many candidates sources have."""
    n = within_join(a, b, radius).groupBy("id_a").agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("sources"))
