"""The library's registered queries over the derived road tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import geometry as G
from roadweave.operators import dag, pairs, perturb, quality, reconcile, resolve, routes, spatial, thresholds
from roadweave.operators import points as snap
from roadweave.plans import warping_sql
from roadweave.plans.scratch import Scratch
from roadweave.sources import derived, edges

RADIUS = 8.0
#: Decimals in which registered results are compared; the operators don't round.
DECIMALS = 6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + derived.SQL.strip() + sql
        return f

    return register


#: Distance from a point to a segment, and where its foot lies, as DuckDB expressions.
FOOT = "CASE WHEN ({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1}) > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({x}-{x1})*({x2}-{x1})+({y}-{y1})*({y2}-{y1}))/(({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1})))) ELSE 0.0 END"


def sql_distance(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    t = FOOT.format(x=x, y=y, x1=x1, y1=y1, x2=x2, y2=y2)
    return f"(({x1}+({t})*({x2}-{x1})-{x})*({x1}+({t})*({x2}-{x1})-{x})+({y1}+({t})*({y2}-{y1})-{y})*({y1}+({t})*({y2}-{y1})-{y}))"


SNAP = f""", near AS (
  SELECT p.id AS source_id, b.id AS dest_id, b.x1, b.y1, b.x2, b.y2, {FOOT.format(x="p.x", y="p.y", x1="b.x1", y1="b.y1", x2="b.x2", y2="b.y2")} AS t,
         sqrt({sql_distance("p.x", "p.y", "b.x1", "b.y1", "b.x2", "b.y2")}) AS d
  FROM pt p JOIN bp b ON b.o BETWEEN floor((p.y - 40) / 60) * 40 AND floor((p.y + 60) / 60) * 40 + 79 AND least(b.x1, b.x2) <= p.x + 8 AND greatest(b.x1, b.x2) >= p.x - 8 AND least(b.y1, b.y2) <= p.y + 8 AND greatest(b.y1, b.y2) >= p.y - 8
), ranked AS (
  SELECT source_id, dest_id, d AS distance_m, 100.0 * t AS position_pct, {warping_sql.BEARING.format(x1="x1", y1="y1", x2="x2", y2="y2")} AS edge_bearing_deg, x1 + t * (x2 - x1) AS snap_x, y1 + t * (y2 - y1) AS snap_y FROM near WHERE d <= {RADIUS}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(distance_m, 9), dest_id) AS rank, CASE WHEN count(*) OVER (PARTITION BY source_id) > 1 THEN '1:N_CANDIDATES' ELSE '1:1' END AS match_type FROM ranked
), matched AS (
  SELECT * FROM placed UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'NO_MATCH' FROM pt WHERE id NOT IN (SELECT source_id FROM placed)
)"""
SHOWN = "source_id, dest_id, round(distance_m, 6) AS distance_m, round(position_pct, 6) AS position_pct, round(edge_bearing_deg, 6) AS edge_bearing_deg, round(snap_x, 6) AS snap_x, round(snap_y, 6) AS snap_y, rank, match_type"


def _points_shown(m: DataFrame) -> DataFrame:
    """All columns; the snapped place as two numbers."""
    at = G.from_wkt(F.col("snap_wkt"), "POINT")[0]
    return rounded(m.withColumns({"snap_x": at["x"], "snap_y": at["y"]}).drop("snap_wkt"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DECIMALS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def one_to_one_sql(rows: str, score: str) -> str:
    """{rows}1 (source_id, dest_id): pairs of {rows} taken one by one by score, source and destination."""
    first = f"row_number() OVER (PARTITION BY source_id ORDER BY round({score}, 9), dest_id) = 1 AND row_number() OVER (PARTITION BY dest_id ORDER BY round({score}, 9), source_id) = 1"
    return f"""
{rows}_r AS (
  SELECT source_id, dest_id, {score}, {first} AS won FROM {rows}
  UNION ALL
  SELECT source_id, dest_id, {score}, {first} FROM (SELECT * FROM {rows}_r WHERE source_id NOT IN (SELECT source_id FROM {rows}_r WHERE won) AND dest_id NOT IN (SELECT dest_id FROM {rows}_r WHERE won))
), {rows}1 AS (SELECT source_id, dest_id FROM {rows}_r WHERE won)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return snap.match_points(derived.points(spark, d), derived.b_edges(spark, d), RADIUS)


@query(" SELECT id, oneway, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM ae")
def source_edges(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("pts")[0], F.col("pts")[1]
    return derived.a_edges(spark, d).select("id", "oneway", *(F.round(v, 6).alias(n) for v, n in ((p["x"], "x1"), (p["y"], "y1"), (q["x"], "x2"), (q["y"], "y2"))))


@query(" SELECT id, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) AS length_m, round((degrees(atan2(x2-x1, y2-y1)) + 360.0::DOUBLE) % 360.0::DOUBLE, 6) AS bearing FROM bp")
def edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    return derived.b_edges(spark, d).select("id", F.round(G.length(F.col("pts")), 6).alias("length_m"), F.round(G.line_bearing(F.col("pts")), 6).alias("bearing"))


@query("""
SELECT id || ':f' AS directed_id, id AS original_edge_id, false AS is_reverse, oneway, x1 AS first_x, y1 AS first_y, x2 AS last_x, y2 AS last_y, 2 AS vertices FROM ae WHERE oneway <> '-1'
UNION ALL SELECT id || ':r', id, true, oneway, x2, y2, x1, y1, 2 FROM ae WHERE oneway IN ('no', '-1')""")
def directed_expansion(spark: SparkSession, d: str) -> DataFrame:
    return edges.directed(derived.a_edges(spark, d)).select("directed_id", "original_edge_id", "is_reverse", "oneway", *_ends(False), F.size("pts").alias("vertices"))


def _ends(short: bool) -> list:
    """Both ends of a line in four columns."""
    at = {"first": F.element_at("pts", 1), "last": F.element_at("pts", -1)}
    return [(F.round(p[c], DECIMALS) if short else p[c]).alias(f"{n}_{c}") for n, p in at.items() for c in "xy"]


#: A-edges run level from (x1, y) to (x2, y); a crossing has B's ends on both sides and its cut within A.
PAIRS = f""", cand AS (
  SELECT a.id AS id_a, b.id AS id_b, a.x1 AS ax1, a.y1 AS ay, a.x2 AS ax2, b.x1, b.y1, b.x2, b.y2,
    CASE WHEN (b.y1 - a.y1) * (b.y2 - a.y1) < 0 AND b.x1 + (a.y1 - b.y1) / nullif(b.y2 - b.y1, 0) * (b.x2 - b.x1) > a.x1 AND b.x1 + (a.y1 - b.y1) / nullif(b.y2 - b.y1, 0) * (b.x2 - b.x1) < a.x2 THEN 0.0
    ELSE sqrt(least({sql_distance("a.x1", "a.y1", "b.x1", "b.y1", "b.x2", "b.y2")}, {sql_distance("a.x2", "a.y1", "b.x1", "b.y1", "b.x2", "b.y2")}, {sql_distance("b.x1", "b.y1", "a.x1", "a.y1", "a.x2", "a.y1")}, {sql_distance("b.x2", "b.y2", "a.x1", "a.y1", "a.x2", "a.y1")})) END AS d
  FROM ae a JOIN bp b ON b.o BETWEEN a.id - 41 AND a.id + 41 AND least(b.y1, b.y2) <= a.y1 + 8 AND greatest(b.y1, b.y2) >= a.y1 - 8 AND least(b.x1, b.x2) <= a.x2 + 8 AND greatest(b.x1, b.x2) >= a.x1 - 8
), pairs AS (SELECT id_a, id_b FROM cand WHERE d <= {RADIUS})"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_join(derived.a_edges(spark, d), derived.b_edges(spark, d), RADIUS)


@query(PAIRS + " SELECT id_a, id_b FROM pairs")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("id_a", "id_b")


@query(SNAP + f" SELECT {SHOWN} FROM matched")
def match_points(spark: SparkSession, d: str) -> DataFrame:
    return _points_shown(_points(spark, d))


@query(SNAP + f" SELECT {SHOWN} FROM matched WHERE rank = 1 OR rank IS NULL")
def match_points_best(spark: SparkSession, d: str) -> DataFrame:
    return _points_shown(resolve.resolve(_points(spark, d), "best_per_source"))


#: Sources of `matched` that `kept` has no row of.
LOST_POINTS = " UNION ALL SELECT DISTINCT source_id, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, 'NO_MATCH' FROM matched WHERE source_id NOT IN (SELECT source_id FROM kept)"


@query(SNAP + f""", kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dest_id ORDER BY round(distance_m, 9), source_id) AS k FROM placed) WHERE k = 1)
SELECT {SHOWN} FROM kept""" + LOST_POINTS)
def match_points_best_per_dest(spark: SparkSession, d: str) -> DataFrame:
    return _points_shown(resolve.resolve(_points(spark, d), "best_per_dest"))


@query(SNAP + "," + one_to_one_sql("placed", "distance_m") + f", kept AS (SELECT p.* FROM placed p JOIN placed1 USING (source_id, dest_id)) SELECT {SHOWN} FROM kept" + LOST_POINTS)
def match_points_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return _points_shown(resolve.resolve(_points(spark, d), "one_to_one"))


@query(SNAP + " SELECT match_type, count(*) AS n, round(quantile_cont(distance_m, 0.5), 6) AS median_m, round(quantile_cont(distance_m, 0.9), 6) AS p90_m FROM matched GROUP BY match_type")
def match_points_report(spark: SparkSession, d: str) -> DataFrame:
    m = _points(spark, d).groupBy("match_type")
    return m.agg(F.count("*").alias("n"), F.round(F.percentile("distance_m", 0.5), 6).alias("median_m"), F.round(F.percentile("distance_m", 0.9), 6).alias("p90_m"))


@query(SNAP + " SELECT id AS dest_id FROM bp WHERE id NOT IN (SELECT dest_id FROM placed)")
def unused_edges(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unmatched_destinations(_points(spark, d), derived.b_edges(spark, d))


#: Pairs as p, with their vertices in ta and tb.
NUMBERED = ", pr AS (SELECT row_number() OVER (ORDER BY id_a, id_b) AS p, * FROM pairs)"
LINES = NUMBERED + """,
ta AS (SELECT p, unnest([0, 1]) AS k, unnest([a.x1, a.x2]) AS x, unnest([a.y1, a.y2]) AS y FROM pr JOIN ae a ON a.id = pr.id_a),
tb AS (SELECT p, unnest([0, 1]) AS k, unnest([b.x1, b.x2]) AS x, unnest([b.y1, b.y2]) AS y FROM pr JOIN bp b ON b.id = pr.id_b)"""
ROAD_PAIRS = ", " + derived.ROADS_SQL.strip() + f""", sega AS (SELECT id, o, unnest([x1, x2]) AS x1, unnest([y1, y2]) AS y1, unnest([x2, x3]) AS x2, unnest([y2, y3]) AS y2 FROM ar), segb AS (SELECT id, o, unnest([x1, x2]) AS x1, unnest([y1, y2]) AS y1, unnest([x2, x3]) AS x2, unnest([y2, y3]) AS y2 FROM br),
cand AS (
  SELECT a.id AS id_a, b.id AS id_b,
    CASE WHEN ((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1))*((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) < 0 AND ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))*((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) < 0 THEN 0.0
    ELSE sqrt(least({sql_distance("a.x1", "a.y1", "b.x1", "b.y1", "b.x2", "b.y2")}, {sql_distance("a.x2", "a.y2", "b.x1", "b.y1", "b.x2", "b.y2")}, {sql_distance("b.x1", "b.y1", "a.x1", "a.y1", "a.x2", "a.y2")}, {sql_distance("b.x2", "b.y2", "a.x1", "a.y1", "a.x2", "a.y2")})) END AS d
  FROM sega a JOIN segb b ON b.o BETWEEN a.o - 41 AND a.o + 41 AND least(b.y1, b.y2) <= greatest(a.y1, a.y2) + 8 AND greatest(b.y1, b.y2) >= least(a.y1, a.y2) - 8 AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) + 8 AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) - 8
), pairs AS (SELECT DISTINCT id_a, id_b FROM cand WHERE d <= {RADIUS})"""
ROAD_LINES = NUMBERED + """,
ta AS (SELECT p, unnest([0, 1, 2]) AS k, unnest([a.x1, a.x2, a.x3]) AS x, unnest([a.y1, a.y2, a.y3]) AS y FROM pr JOIN ar a ON a.id = pr.id_a),
tb AS (SELECT p, unnest([0, 1, 2]) AS k, unnest([b.x1, b.x2, b.x3]) AS x, unnest([b.y1, b.y2, b.y3]) AS y FROM pr JOIN br b ON b.id = pr.id_b)"""
EDGE = "source_id, dest_id, round(dtw_distance, 6) AS dtw_distance, round(max_dtw_distance, 6) AS max_dtw_distance, round(min_dtw_distance, 6) AS min_dtw_distance, round(bearing_diff, 6) AS bearing_diff, overlap_pct, rank, match_type"
EDGES = "," + warping_sql.warp("t") + """, ranked AS (
  SELECT id_a AS source_id, id_b AS dest_id, dtw AS dtw_distance, mx AS max_dtw_distance, mn AS min_dtw_distance, bearing AS bearing_diff, overlap AS overlap_pct,
    row_number() OVER (PARTITION BY id_a ORDER BY round(dtw, 9), id_b) AS rank, CASE WHEN count(*) OVER (PARTITION BY id_a) > 1 THEN '1:N_SPLIT' ELSE '1:1_SYMMETRIC' END AS match_type
  FROM pr JOIN tm USING (p) WHERE bearing <= 60 AND overlap >= 0
), matched AS (
  SELECT * FROM ranked UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'NO_MATCH' FROM ae WHERE id NOT IN (SELECT source_id FROM ranked)
)"""
LOST_EDGES = " UNION ALL SELECT DISTINCT source_id, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, 'NO_MATCH' FROM matched WHERE source_id NOT IN (SELECT source_id FROM kept)"
SYMMETRIC = "," + warping_sql.both_ways("t") + f""", sym AS (
  SELECT id_a AS a, id_b AS b, least(x.dtw, y.dtw) AS dtw, round_even(x.bearing, 1) AS bearing_diff, x.bearing AS turn, x.overlap AS ov_ab, y.overlap AS ov_ba, round_even(greatest(x.matched, y.matched), 1) AS matched_len_m
  FROM pr JOIN t1m x USING (p) JOIN t2m y USING (p)
), edge AS (SELECT * FROM sym WHERE dtw <= {RADIUS} AND turn <= 45 AND matched_len_m >= 5),
reach AS (SELECT a AS root, a FROM (SELECT DISTINCT a FROM edge) UNION SELECT r.root, e2.a FROM reach r JOIN edge e1 ON e1.a = r.a JOIN edge e2 ON e2.b = e1.b),
comp AS (SELECT a, min(root) AS c FROM reach GROUP BY a), size AS (SELECT c, count(DISTINCT e.a) AS na, count(DISTINCT e.b) AS nb FROM edge e JOIN comp USING (a) GROUP BY c)
SELECT e.a AS a_id, e.b AS b_id, round(dtw, 6) AS dtw, bearing_diff, ov_ab, ov_ba, matched_len_m, greatest(ov_ab, ov_ba) AS containment, least(ov_ab, ov_ba) AS symmetry,
  CASE WHEN least(ov_ab, ov_ba) >= 70 THEN '1:1' WHEN ov_ba >= ov_ab THEN 'split' ELSE 'merge' END AS relation,
  CASE WHEN na = 1 AND nb = 1 THEN '1:1' WHEN na = 1 THEN '1:N_SPLIT' WHEN nb = 1 THEN 'N:1_MERGE' ELSE 'N:M_COMPLEX' END AS cardinality FROM edge e JOIN comp USING (a) JOIN size USING (c)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.match(derived.a_edges(spark, d), derived.b_edges(spark, d), RADIUS, max_angle=60.0)


@query(PAIRS + LINES + EDGES + f" SELECT {EDGE} FROM matched")
def match_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pairs(spark, d))


@query(PAIRS + LINES + EDGES + f" SELECT {EDGE} FROM matched WHERE rank = 1 OR rank IS NULL")
def match_edges_best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resolve.resolve(_pairs(spark, d), "best_per_source"))


@query(PAIRS + LINES + EDGES + "," + one_to_one_sql("ranked", "dtw_distance") + f", kept AS (SELECT r.* FROM ranked r JOIN ranked1 USING (source_id, dest_id)) SELECT {EDGE} FROM kept" + LOST_EDGES)
def match_edges_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resolve.resolve(_pairs(spark, d), "one_to_one"))


@query(PAIRS + LINES + SYMMETRIC)
def match_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.match_symmetric(derived.a_edges(spark, d), derived.b_edges(spark, d), RADIUS))


def _road_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.match(derived.a_roads(spark, d), derived.b_roads(spark, d), RADIUS, max_angle=60.0, min_overlap=20)


@query(ROAD_PAIRS + " SELECT id_a, id_b FROM pairs")
def road_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_join(derived.a_roads(spark, d), derived.b_roads(spark, d), RADIUS).select("id_a", "id_b")


@query(ROAD_PAIRS + ROAD_LINES + EDGES.replace("overlap >= 0", "overlap >= 20").replace("FROM ae", "FROM ar") + f" SELECT {EDGE} FROM matched")
def road_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs over forks, diamonds, stubs and bends."""
    return rounded(_road_pairs(spark, d))


@query(ROAD_PAIRS + ROAD_LINES + EDGES.replace("overlap >= 0", "overlap >= 20").replace("FROM ae", "FROM ar") + "," + one_to_one_sql("ranked", "dtw_distance") + f", kept AS (SELECT r.* FROM ranked r JOIN ranked1 USING (source_id, dest_id)) SELECT {EDGE} FROM kept" + LOST_EDGES)
def road_edges_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resolve.resolve(_road_pairs(spark, d), "one_to_one"))


@query(ROAD_PAIRS + ROAD_LINES + SYMMETRIC)
def road_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.match_symmetric(derived.a_roads(spark, d), derived.b_roads(spark, d), RADIUS))


@query(PAIRS + """, edge AS (SELECT id_a AS a, id_b AS b FROM pairs), node AS (SELECT 'a' || a AS n, a AS o FROM edge UNION SELECT 'b' || b, NULL FROM edge),
reach AS (SELECT a AS root, a FROM (SELECT DISTINCT a FROM edge) UNION SELECT r.root, e2.a FROM reach r JOIN edge e1 ON e1.a = r.a JOIN edge e2 ON e2.b = e1.b),
comp AS (SELECT a, min(root) AS c FROM reach GROUP BY a), size AS (SELECT c, count(DISTINCT e.a) AS na, count(DISTINCT e.b) AS nb FROM edge e JOIN comp USING (a) GROUP BY c)
SELECT e.a AS a_id, e.b AS b_id, CASE WHEN na = 1 AND nb = 1 THEN '1:1' WHEN na = 1 THEN '1:N_SPLIT' WHEN nb = 1 THEN 'N:1_MERGE' ELSE 'N:M_COMPLEX' END AS cardinality FROM edge e JOIN comp USING (a) JOIN size USING (c)""")
def pair_cardinality(spark: SparkSession, d: str) -> DataFrame:
    near = _candidates(spark, d).select(F.col("id_a").alias("a_id"), F.col("id_b").alias("b_id"))
    return pairs.cardinality(Scratch(spark, "near").table(near, "pairs"))


def _routes(spark: SparkSession, d: str, **more) -> tuple[DataFrame, DataFrame]:
    return routes.match_routes(derived.a_edges(spark, d), derived.b_edges(spark, d), max_distance=RADIUS, step=10.0, **more)


@query()
def match_routes_long(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d)[0]


@query()
def match_routes_summary(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d)[1]


@query()
def match_routes_segments(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d, emission="segment", bearing_weight=0.2)[1]


@query()
def match_routes_resolved(spark: SparkSession, d: str) -> DataFrame:
    long, summary = _routes(spark, d)
    return routes.resolve_routes(summary, long, max_match_dist=4.0, min_overlap_pct=80)[0]


#: Least costs over (source, step of A, vertex of the local graph), by as many rounds as the longest way has steps.
ROUTE_STEP = 30.0
ROUTE_COSTS = f""", va AS (SELECT id AS i, unnest([0, 1, 2]) AS k, unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y FROM ar), vb AS (SELECT id AS i, unnest([0, 1, 2]) AS k, unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y FROM br),
ra AS (SELECT row_number() OVER (ORDER BY id_a, id_b) AS p, id_a, id_b FROM pairs),
wa AS (SELECT p, k, x, y FROM ra JOIN va ON va.i = id_a), wb AS (SELECT p, k, x, y FROM ra JOIN vb ON vb.i = id_b),{warping_sql.places("w", ROUTE_STEP)},
n AS (SELECT id_a AS a, id_b AS b, i, x, y, max(i) OVER (PARTITION BY p) AS last FROM wbq JOIN ra USING (p)),
m AS (SELECT * FROM wam),
arc AS (SELECT a, b, i, b AS b2, i + 1 AS i2 FROM n WHERE i < last UNION ALL SELECT u.a, u.b, u.i, w.b, 0 FROM n u JOIN n w ON u.a = w.a AND u.b <> w.b AND u.i = u.last AND w.i = 0 AND (u.x - w.x) * (u.x - w.x) + (u.y - w.y) * (u.y - w.y) <= 0.75::DOUBLE * 0.75::DOUBLE),
e AS (SELECT n.a, m.i AS s, n.b, n.i, sqrt((m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)) AS c FROM n JOIN m ON m.a = n.a),
bf AS (
  SELECT a, s, b, i, c AS cost, 0 AS step FROM e WHERE s = 0
  UNION ALL
  SELECT a, s, b, i, min(cost), step FROM (
    SELECT a, s, b, i, cost, step + 1 AS step FROM bf WHERE step < 40
    UNION ALL SELECT e.a, e.s, e.b, e.i, cost + e.c, step + 1 FROM bf JOIN e ON e.a = bf.a AND e.s = bf.s + 1 AND e.b = bf.b AND e.i = bf.i WHERE step < 40
    UNION ALL SELECT e.a, e.s, e.b, e.i, cost + e.c, step + 1 FROM bf JOIN arc ON arc.a = bf.a AND arc.b = bf.b AND arc.i = bf.i JOIN e ON e.a = bf.a AND e.b = arc.b2 AND e.i = arc.i2 AND e.s IN (bf.s, bf.s + 1) WHERE step < 40) GROUP BY ALL)
SELECT a AS source_id, round(min(cost), 6) AS cost FROM bf JOIN (SELECT a, max(i) AS z FROM m GROUP BY a) USING (a) WHERE s = z AND step = 40 GROUP BY a"""


@query(ROAD_PAIRS + ROUTE_COSTS)
def road_route_costs(spark: SparkSession, d: str) -> DataFrame:
    """What the cheapest way through each source's local network costs (Mode 1), over forks, blocks and bends."""
    return rounded(routes.route_costs(derived.a_roads(spark, d), derived.b_roads(spark, d), max_distance=RADIUS, step=ROUTE_STEP))


#: Members of the cheapest ways: as ROUTE_COSTS, each state with the parts of edges that its way has used, and with the edge that it began on where that counts.
def ways_sql(entry: str) -> str:
    start = "b" if entry else "0"
    base = ROUTE_COSTS[: ROUTE_COSTS.index("\nbf AS (") + 1].replace("SELECT id_a AS a, id_b AS b, i, x, y, max(i)", "SELECT id_a AS a, id_b AS b, i, pos, x, y, max(i)").replace("e AS (SELECT n.a, m.i AS s, n.b, n.i,", "e AS (SELECT n.a, m.i AS s, n.b, n.i, n.pos,")
    grown = "CASE WHEN way[-1].b = e.b THEN way[1:len(way) - 1] || [{'b': e.b, 'f': way[-1].f, 't': e.pos}] ELSE way || [{'b': e.b, 'f': e.pos, 't': e.pos}] END"
    return base + f"""bf AS (
  SELECT a, {start} AS entry, s, b, i, c AS cost, [{{'b': b, 'f': pos, 't': pos}}] AS way, 0 AS step FROM e WHERE s = 0
  UNION ALL
  SELECT a, entry, s, b, i, min(cost), arg_min(way, cost), step FROM (
    SELECT a, entry, s, b, i, cost, way, step + 1 AS step FROM bf WHERE step < 40
    UNION ALL SELECT e.a, entry, e.s, e.b, e.i, cost + e.c, {grown}, step + 1 FROM bf JOIN e ON e.a = bf.a AND e.s = bf.s + 1 AND e.b = bf.b AND e.i = bf.i WHERE step < 40
    UNION ALL SELECT e.a, entry, e.s, e.b, e.i, cost + e.c, {grown}, step + 1 FROM bf JOIN arc ON arc.a = bf.a AND arc.b = bf.b AND arc.i = bf.i JOIN e ON e.a = bf.a AND e.b = arc.b2 AND e.i = arc.i2 AND e.s IN (bf.s, bf.s + 1) WHERE step < 40) GROUP BY a, entry, s, b, i, step),
done AS (SELECT a, entry, b AS leave, i, round(cost, 9) AS cost, way, list_filter(range(1, len(way) + 1), lambda k: way[k].t - way[k].f > 1e-9) AS walked FROM bf JOIN (SELECT a, max(i) AS z FROM m GROUP BY a) USING (a) WHERE s = z AND step = 40),
route AS (SELECT a, entry, leave, cost, i, way[list_min(walked):list_max(walked)] AS way FROM (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY a{", entry, leave" if entry else ""} ORDER BY cost, leave::VARCHAR, i) = 1) WHERE len(walked) > 0)"""


LATTICE = ways_sql("b") + """,
alt AS (SELECT a, cost, way, list_transform(way, lambda x: x.b) AS ids, row_number() OVER (PARTITION BY a ORDER BY cost, list_transform(way, lambda x: x.b::VARCHAR)) - 1 AS rank FROM (SELECT * FROM route QUALIFY row_number() OVER (PARTITION BY a, list_transform(way, lambda x: x.b) ORDER BY cost, entry::VARCHAR, leave::VARCHAR) = 1))"""


@query(ROAD_PAIRS + ways_sql("") + """
SELECT a AS source_id, way[k].b AS dest_id, (k - 1)::INT AS seq, round(way[k].f, 6) AS edge_b_from_m, round(way[k].t, 6) AS edge_b_to_m, len(way) AS n_edges, round(cost, 4) AS dp_cost FROM (SELECT *, unnest(range(1, len(way) + 1)) AS k FROM route)""")
def road_route_members(spark: SparkSession, d: str) -> DataFrame:
    """Which part of each edge every route uses (Mode 1), with what the route costs."""
    long, summary = routes.match_routes(derived.a_roads(spark, d), derived.b_roads(spark, d), max_distance=RADIUS, step=ROUTE_STEP)
    return rounded(long.select("source_id", "dest_id", "seq", "edge_b_from_m", "edge_b_to_m", "n_edges").join(summary.select("source_id", F.round("dp_cost", 4).alias("dp_cost")), "source_id"))


@query(ROAD_PAIRS + LATTICE + """
SELECT a AS source_id, rank::INT AS rank, round(cost, 4) AS dp_cost, array_to_string(ids, ' ') AS dest_ids, array_to_string(list_transform(way, lambda x: round_even(x.f, 2)), ' ') AS from_m, array_to_string(list_transform(way, lambda x: round_even(x.t, 2)), ' ') AS to_m FROM alt WHERE rank < 8""")
def road_lattice(spark: SparkSession, d: str) -> DataFrame:
    """The eight cheapest different routes of each source."""
    alts = _lattice(spark, d)
    said = lambda c: F.concat_ws(" ", F.transform("claims", lambda x: F.bround(x[c], 2).cast("string"))).alias(c)
    return alts.select("source_id", "rank", F.round("dp_cost", 4).alias("dp_cost"), F.concat_ws(" ", F.transform("dest_ids", lambda x: x.cast("string"))).alias("dest_ids"), said("from_m"), said("to_m"))


def _lattice(spark: SparkSession, d: str) -> DataFrame:
    return routes.route_lattice(derived.a_roads(spark, d), derived.b_roads(spark, d), max_distance=RADIUS, step=ROUTE_STEP)


#: Pieces of B between the ends of the parts that candidates use, and who may use those that several sources may.
ATOMS = LATTICE + """,
claim AS (SELECT a, rank, way[k].b AS b, way[k].f AS f, way[k].t AS t FROM (SELECT *, unnest(range(1, len(way) + 1)) AS k FROM alt WHERE rank < 8) WHERE way[k].t > way[k].f + 1e-9),
piece AS (SELECT * FROM (SELECT b, f AS lo, lead(f) OVER (PARTITION BY b ORDER BY f) AS hi FROM (SELECT b, f FROM claim UNION SELECT b, t FROM claim)) WHERE hi > lo + 1e-9),
atom AS (SELECT b, lo, any_value(hi) AS hi, count(DISTINCT a) AS sources, count(DISTINCT (a, rank)) AS candidates FROM piece JOIN claim USING (b) WHERE lo >= f - 1e-9 AND lo < t - 1e-9 GROUP BY b, lo HAVING count(DISTINCT a) > 1)"""


@query(ROAD_PAIRS + ATOMS + " SELECT b AS dest_id, round(lo, 6) AS lo_m, round(hi - lo, 6) AS width_m, sources, candidates FROM atom")
def road_claim_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of B that several sources may use, with how many."""
    claims = Scratch(spark, "claims").table(reconcile.claims_of(_lattice(spark, d)), "claims")
    shared = reconcile.covers(claims, reconcile.atoms_of(claims))
    by = shared.groupBy("dest_id", "lo_m").agg(F.max("width").alias("width_m"), F.countDistinct("source_id").alias("sources"), F.count("*").alias("candidates"))
    return rounded(by)


@query(ROAD_PAIRS + ATOMS + """
SELECT (SELECT count(DISTINCT a) FROM alt) AS sources, (SELECT count(*) FROM alt WHERE rank < 8) AS candidates, count(*) AS shared_atoms, round(sum(hi - lo), 3) AS shared_m, (SELECT count(DISTINCT a) FROM claim JOIN atom USING (b) WHERE lo >= f - 1e-9 AND lo < t - 1e-9) AS coupled FROM atom""")
def road_lattice_figures(spark: SparkSession, d: str) -> DataFrame:
    """How far candidates compete for B, before any is ruled out."""
    alts = Scratch(spark, "lattice").table(_lattice(spark, d).select("source_id", "rank", "claims"), "lattice")
    claims = Scratch(spark, "claims").table(reconcile.claims_of(alts), "claims")
    shared = Scratch(spark, "covers").table(reconcile.covers(claims, reconcile.atoms_of(claims)), "covers")
    n = alts.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("candidates"))
    atoms = shared.groupBy("dest_id", "lo_m").agg(F.max("width").alias("width")).agg(F.count("*").alias("shared_atoms"), F.round(F.sum("width"), 3).alias("shared_m"))
    return reconcile.beside(n, atoms, shared.agg(F.countDistinct("source_id").alias("coupled")))


TAU, MU = 12.0, 10.0


@query()
def road_probe(spark: SparkSession, d: str) -> DataFrame:
    """How many sources are settled without a solve."""
    return reconcile.probe(Scratch(spark, "lattice").table(_lattice(spark, d), "lattice"), TAU, MU)


@query()
def road_choices(spark: SparkSession, d: str) -> DataFrame:
    """The choice of least cost over all sources."""
    return rounded(reconcile.choose(Scratch(spark, "lattice").table(_lattice(spark, d), "lattice"), TAU, MU)[0])


@query()
def road_twins(spark: SparkSession, d: str) -> DataFrame:
    """Whether both ways of each street match both ways of the same street; every fifth edge of B runs one way only."""

    def both(df: DataFrame, back) -> DataFrame:
        ways = df.select((F.col("id") * 2).alias("id"), "pts").union(df.where(back).select((F.col("id") * 2 + 1).alias("id"), F.reverse("pts").alias("pts")))
        return Scratch(spark, "ways").table(ways, "ways")

    a, b = both(derived.a_roads(spark, d), F.lit(True)), both(derived.b_roads(spark, d), F.col("id") % 5 != 0)
    b = Scratch(spark, "twins").table(routes.with_twins(b), "twins")
    twin = F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    long = routes.match_routes(a, b, max_distance=RADIUS, step=ROUTE_STEP, max_turn=60.0)[0]
    return rounded(reconcile.twin_consistency(long, a.select("id", twin.alias("twin")), b.select("id", "twin"))[0])


@query()
def road_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.match_routes(derived.a_roads(spark, d), derived.b_roads(spark, d), max_distance=RADIUS, step=10.0)[1]


@query()
def route_edge_usage(spark: SparkSession, d: str) -> DataFrame:
    return routes.edge_usage(_routes(spark, d)[0])


@query()
def route_validation(spark: SparkSession, d: str) -> DataFrame:
    long, summary = _routes(spark, d)
    return routes.validation_report(summary, long)


def _dag(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return dag.match_dag(derived.a_edges(spark, d), derived.b_edges(spark, d), max_distance=12.0, step=15.0, bearing_weight=0.1)


#: A-edges of 90 m are six segments of 15 m; B-edges are cut evenly. The least cost over (source, its segment, B's segment).
DAG_COSTS = f""", sa AS (SELECT id AS a, k AS s, x1 + 15 * k + 7.5::DOUBLE AS x, y1 AS y FROM (SELECT *, unnest(range(6)) AS k FROM ae)),
lb AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM bp),
sb AS (SELECT o, id, k, cuts, x1 + (k + 0.5::DOUBLE) / cuts * (x2 - x1) AS x, y1 + (k + 0.5::DOUBLE) / cuts * (y2 - y1) AS y, {warping_sql.BEARING.format(x1="x1", y1="y1", x2="x2", y2="y2")} AS turn FROM (SELECT *, unnest(range(cuts)) AS k FROM (SELECT *, greatest(1, round_even(l / 15, 0))::BIGINT AS cuts FROM lb))),
b AS (SELECT row_number() OVER (ORDER BY id, k) AS v, lead(id) OVER (ORDER BY id, k) AS then_id, * FROM sb),
arc AS (SELECT v, v + 1 AS w FROM b WHERE id = then_id OR id + 1 = then_id),
near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM ae a JOIN bp b ON b.o BETWEEN a.id - 41 AND a.id + 41 AND least(b.x1, b.x2) <= a.x2 + 27 AND greatest(b.x1, b.x2) >= a.x1 - 27 AND least(b.y1, b.y2) <= a.y1 + 27 AND greatest(b.y1, b.y2) >= a.y1 - 27),
d AS (SELECT sa.a, sa.s, b.v, sqrt((sa.x - b.x) * (sa.x - b.x) + (sa.y - b.y) * (sa.y - b.y)) AS d, least(abs(90.0::DOUBLE - turn), 360.0::DOUBLE - abs(90.0::DOUBLE - turn)) AS t FROM sa JOIN near USING (a) JOIN b ON b.id = near.b),
e AS (SELECT a, s, v, d + 0.1::DOUBLE * t AS c FROM (SELECT *, row_number() OVER (PARTITION BY a, s ORDER BY d, v) AS nth FROM d) WHERE d <= 12 OR nth = 1),
bf AS (
  SELECT a, s, v, c AS cost, 0 AS step FROM e WHERE s = 0
  UNION ALL
  SELECT a, s, v, min(cost), step FROM (
    SELECT a, s, v, cost, step + 1 AS step FROM bf WHERE step < 22
    UNION ALL SELECT e.a, e.s, e.v, cost + e.c, step + 1 FROM bf JOIN e ON e.a = bf.a AND e.s = bf.s + 1 AND e.v = bf.v WHERE step < 22
    UNION ALL SELECT e.a, e.s, e.v, cost + e.c, step + 1 FROM bf JOIN arc ON arc.v = bf.v JOIN e ON e.a = bf.a AND e.v = arc.w AND e.s IN (bf.s, bf.s + 1) WHERE step < 22) GROUP BY ALL)
SELECT a AS source_id, round(min(cost), 6) AS cost FROM bf WHERE s = 5 AND step = 22 GROUP BY a"""


@query(DAG_COSTS)
def match_dag_costs(spark: SparkSession, d: str) -> DataFrame:
    """What the cheapest valid matching of each component (here one source edge) costs (Mode 3)."""
    got = _dag(spark, d)
    return rounded(got["costs"].select(F.explode("sources").alias("source_id"), "cost"))


@query()
def road_dag(spark: SparkSession, d: str) -> DataFrame:
    """Whole networks with forks and blocks (Mode 3)."""
    return dag.match_dag(derived.a_roads(spark, d), derived.b_roads(spark, d), max_distance=12.0, step=15.0, bearing_weight=0.1)["summary"]


#: As DAG_COSTS, each state with its way; then the pairs of the cheapest way, by edge.
DAG_WAYS = DAG_COSTS[: DAG_COSTS.index("\nbf AS (")] + """
bf AS (
  SELECT a, s, v, c AS cost, [{'s': s, 'v': v}] AS way, 0 AS step FROM e WHERE s = 0
  UNION ALL
  SELECT a, s, v, min(cost), arg_min(way, cost), step FROM (
    SELECT a, s, v, cost, way, step + 1 AS step FROM bf WHERE step < 22
    UNION ALL SELECT e.a, e.s, e.v, cost + e.c, way || [{'s': e.s, 'v': e.v}], step + 1 FROM bf JOIN e ON e.a = bf.a AND e.s = bf.s + 1 AND e.v = bf.v WHERE step < 22
    UNION ALL SELECT e.a, e.s, e.v, cost + e.c, way || [{'s': e.s, 'v': e.v}], step + 1 FROM bf JOIN arc ON arc.v = bf.v JOIN e ON e.a = bf.a AND e.v = arc.w AND e.s IN (bf.s, bf.s + 1) WHERE step < 22) GROUP BY a, s, v, step),
best AS (SELECT a, way FROM bf WHERE s = 5 AND step = 22 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cost, 9), v) = 1),
pr AS (SELECT w.a, b.id, w.x.s AS s, d.d, d.t FROM (SELECT a, unnest(way) AS x FROM best) w JOIN b ON b.v = w.x.v JOIN d ON d.a = w.a AND d.s = w.x.s AND d.v = w.x.v),
long AS (SELECT a AS source_id, id AS dest_id, min(s) AS first, count(*) AS n_pairs, avg(d) AS avg_dist_m, avg(t) AS avg_bearing_diff FROM pr GROUP BY a, id)"""


@query(DAG_WAYS + " SELECT source_id, dest_id, row_number() OVER (PARTITION BY source_id ORDER BY first, dest_id)::INT AS seq, n_pairs, round(avg_dist_m, 6) AS avg_dist_m, round(avg_bearing_diff, 6) AS avg_bearing_diff FROM long")
def match_dag_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dag(spark, d)["long"])


#: Stretches of each source by the edge that it follows, from the cheapest ways; A-edges are cut every 15 m from 0.
DAG_PARTS = DAG_WAYS + """,
row AS (SELECT w.a, w.k, w.x.s AS s, w.x.v AS v, b.id, b.k AS piece, l.l / b.cuts AS size, l.l AS whole, d.d, d.t FROM (SELECT a, unnest(way) AS x, generate_subscripts(way, 1) AS k FROM best) w JOIN b ON b.v = w.x.v JOIN lb l ON l.id = b.id JOIN d ON d.a = w.a AND d.s = w.x.s AND d.v = w.x.v),
over AS (SELECT *, min((v = v1)::INT) OVER (PARTITION BY a ORDER BY k) = 1 AS lead, min((v = v2)::INT) OVER (PARTITION BY a ORDER BY k DESC) = 1 AS trail FROM (SELECT *, first_value(v) OVER (PARTITION BY a ORDER BY k) AS v1, first_value(v) OVER (PARTITION BY a ORDER BY k DESC) AS v2 FROM row)),
kinds AS (SELECT *, CASE WHEN lead AND NOT one AND s <> near THEN 'head' WHEN trail AND NOT one AND s <> far THEN 'tail' ELSE 'match' END AS kind FROM (SELECT *, bool_and(lead) OVER (PARTITION BY a) AS one, max(CASE WHEN lead THEN s END) OVER (PARTITION BY a) AS near, min(CASE WHEN trail THEN s END) OVER (PARTITION BY a) AS far FROM over)),
isle AS (SELECT *, sum(new) OVER (PARTITION BY a ORDER BY k)::INT AS part FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY a ORDER BY k) AND id = lag(id) OVER (PARTITION BY a ORDER BY k) THEN 0 ELSE 1 END AS new FROM kinds)),
part AS (SELECT a, part, any_value(kind) AS kind, any_value(id) AS id, any_value(whole) AS whole, max(15.0::DOUBLE * s + 15) AS ends, count(*) AS n_pairs, count(DISTINCT s)::INT AS na, count(DISTINCT piece)::INT AS nb, avg(d) AS d, max(d) AS top, avg(t) AS t, min(piece * size) AS b0, max((piece + 1) * size) AS b1 FROM isle GROUP BY a, part),
stretch AS (SELECT *, to_m - from_m AS len FROM (SELECT *, coalesce(lag(to_m) OVER (PARTITION BY a ORDER BY part), 0.0::DOUBLE) AS from_m FROM (SELECT *, max(ends) OVER (PARTITION BY a ORDER BY part) AS to_m FROM part)))"""


@query(DAG_PARTS + """,
own AS (SELECT a, count(*) FILTER (kind = 'match') AS n_parts, coalesce(sum(len) FILTER (kind = 'head'), 0.0::DOUBLE) AS head, coalesce(sum(len) FILTER (kind = 'tail'), 0.0::DOUBLE) AS tail FROM stretch GROUP BY a)
SELECT source_id, string_agg(dest_id::VARCHAR, ';' ORDER BY first, dest_id) AS dest_ids, count(*) AS n_dest, any_value(n_parts) AS n_parts, sum(n_pairs)::BIGINT AS n_pairs, round(avg(avg_dist_m), 6) AS avg_dist_m, round(avg(avg_bearing_diff), 6) AS avg_bearing_diff, round(any_value(head), 6) AS a_head_m, round(any_value(tail), 6) AS a_tail_m, CASE WHEN count(*) > 1 THEN '1:N_ROUTE' ELSE '1:1' END AS match_type FROM long JOIN own ON own.a = long.source_id GROUP BY source_id""")
def match_dag_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dag(spark, d)["summary"])


@query()
def match_dag_parts(spark: SparkSession, d: str) -> DataFrame:
    """Without a twin: where a target segment lies midway between two source segments, which of them it goes to is a tie."""
    return rounded(_dag(spark, d)["parts"])


@query(""", ends AS (SELECT id, 0 AS k, x1 AS x, y1 AS y FROM bp UNION ALL SELECT id, 1, x2, y2 FROM bp),
here AS (SELECT x, y, count(*) AS n, floor(x / 150) AS cx, floor(y / 150) AS cy FROM ends GROUP BY x, y),
far AS (SELECT a.x, a.y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS gap FROM (SELECT *, cx + unnest([-1, 0, 1]) AS gx FROM here WHERE n = 1) a JOIN here b ON b.cx = a.gx AND b.cy BETWEEN a.cy - 1 AND a.cy + 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.x, a.y)
SELECT (SELECT count(*) FROM bp) AS n_edges, (SELECT count(*) FROM bp WHERE x1 = x2 AND y1 = y2) AS n_degenerate, (SELECT count(*) FROM ends) AS n_endpoints, (SELECT sum(n) FROM here WHERE n > 1)::BIGINT AS exact_shared,
  count(*) FILTER (gap <= 0.05) AS near_0_05, count(*) FILTER (gap <= 0.1) AS near_0_1, count(*) FILTER (gap <= 0.25) AS near_0_25, count(*) FILTER (gap <= 0.5) AS near_0_5, count(*) FILTER (gap <= 1.0) AS near_1, count(*) FILTER (gap <= 2.0) AS near_2,
  round(quantile_cont(gap, 0.5), 6) AS gap_p50, round(quantile_cont(gap, 0.75), 6) AS gap_p75, round(quantile_cont(gap, 0.9), 6) AS gap_p90, round(quantile_cont(gap, 0.95), 6) AS gap_p95 FROM far""")
def network_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.check_network(derived.b_edges(spark, d))[0])


@query(SNAP + """, s AS (SELECT quantile_cont(distance_m, 0.25) AS q1, quantile_cont(distance_m, 0.5) AS med, quantile_cont(distance_m, 0.75) AS q3, quantile_cont(distance_m, 0.95) AS p95 FROM placed),
m AS (SELECT quantile_cont(abs(distance_m - med), 0.5) AS mad FROM placed, s)
SELECT round(q3 + 1.5 * (q3 - q1), 5) AS iqr_fence, round(med + 3 * 1.4826 * mad, 5) AS mad_fence, round(p95, 5) AS p95 FROM s, m""")
def distance_fences(spark: SparkSession, d: str) -> DataFrame:
    s = thresholds.spread(thresholds.counted(Scratch(spark, "points").table(_points(spark, d), "points"), "distance_m"))
    return spark.createDataFrame([(round(thresholds.iqr_fence(s), 5), round(thresholds.mad_fence(s), 5), round(s["p95"], 5))], "iqr_fence double, mad_fence double, p95 double")


#: Every rule of operators/thresholds.py over (metric, v), v being 100 less the value where more is better.
THRESHOLDS = """, x AS (SELECT 'distance_m' AS metric, distance_m AS v, FALSE AS up FROM placed UNION ALL SELECT 'position_pct', 100.0 - position_pct, TRUE FROM placed),
s AS (SELECT metric, any_value(up) AS up, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.975) AS p975, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.995) AS cap, min(v) AS lo, max(v) AS top, stddev_pop(v) AS std FROM x GROUP BY metric),
c AS (SELECT x.metric, least(v, cap) AS v FROM x JOIN s USING (metric)),
z AS (SELECT metric, var_pop(v) AS var, var_samp(v) AS var1, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM c GROUP BY metric),
mad AS (SELECT metric, quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN s USING (metric) GROUP BY metric),
fence AS (SELECT metric, s.med + 3 * CASE WHEN mad > 0 THEN 1.4826 * mad ELSE std END AS mad_fence FROM s JOIN mad USING (metric)),
iqr AS (SELECT metric, mad_fence, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) WHEN mad_fence > q3 THEN mad_fence ELSE p975 END AS iqr_fence FROM s JOIN fence USING (metric)),
bins AS (SELECT metric, k, coalesce(n, 0) / total AS share, lo + (k + 0.5::DOUBLE) * (cap - lo) / 256 AS mid FROM (SELECT metric, lo, cap, n AS total, unnest(range(256)) AS k FROM s) LEFT JOIN (SELECT metric, least(65535, floor((v - lo) / (cap - lo) * 65536))::BIGINT // 256 AS k, count(*)::DOUBLE AS n FROM c JOIN s USING (metric) GROUP BY ALL) USING (metric, k)),
cum AS (SELECT metric, k, mid, sum(share) OVER w AS w, sum(share * mid) OVER w AS m, sum(share * mid) OVER (PARTITION BY metric) AS t FROM bins WINDOW w AS (PARTITION BY metric ORDER BY k ROWS UNBOUNDED PRECEDING)),
otsu AS (SELECT metric, min_by(mid, k) AS otsu FROM (SELECT *, max(g) OVER (PARTITION BY metric) AS best FROM (SELECT *, CASE WHEN w * (1 - w) > 1e-12 THEN (t * w - m) * (t * w - m) / (w * (1 - w)) ELSE -1 END AS g FROM cum)) WHERE g >= best * (1 - 1e-12) GROUP BY metric),
grid AS (SELECT metric, k, lo + (cap - lo) * k / 511 AS g, 0.9::DOUBLE * CASE WHEN z.q3 > z.q1 THEN least(sqrt(var1), (z.q3 - z.q1) / 1.349::DOUBLE) ELSE sqrt(var1) END * power(n, -0.2::DOUBLE) AS h, n FROM (SELECT *, unnest(range(512)) AS k FROM s) JOIN z USING (metric)),
curve AS (SELECT metric, k, g, sum(m * exp(-0.5::DOUBLE * ((g - v) / h) * ((g - v) / h))) / any_value(n * h * sqrt(2 * pi())) AS y FROM grid JOIN (SELECT metric, v, count(*) AS m FROM c GROUP BY ALL) USING (metric) GROUP BY metric, k, g),
peak AS (SELECT metric, min(k) AS mode FROM (SELECT *, max(y) OVER (PARTITION BY metric) AS best FROM curve) WHERE y = best GROUP BY metric),
dip AS (SELECT metric, min_by(g, k) AS valley FROM (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after, max(y) OVER (PARTITION BY metric ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM curve WINDOW w AS (PARTITION BY metric ORDER BY k)) JOIN peak USING (metric) WHERE k > mode AND k < 511 AND y < before AND y <= after AND later >= 1.3 * y GROUP BY metric),
knee AS (SELECT metric, max_by(v, {'d': d, 'v': -v}) AS knee FROM (SELECT metric, v, (row_number() OVER (PARTITION BY metric ORDER BY v) - 1)::DOUBLE / (n - 1) - (v - lo) / (cap - lo) AS d FROM c JOIN s USING (metric)) GROUP BY metric),
em AS (
  SELECT metric, 0 AS step, 0.5::DOUBLE AS p, avg(v) FILTER (v <= med) AS m0, avg(v) FILTER (v > med) AS m1, greatest(var_pop(v) FILTER (v <= med), 1e-3 * any_value(var)) AS v0, greatest(var_pop(v) FILTER (v > med), 1e-3 * any_value(var)) AS v1, '-inf'::DOUBLE AS ll, FALSE AS done FROM c JOIN z USING (metric) GROUP BY metric
  UNION ALL
  SELECT metric, any_value(step) + 1, sum(r) / count(*), sum((1 - r) * v) / sum(1 - r), sum(r * v) / sum(r),
    greatest(sum((1 - r) * v * v) / sum(1 - r) - power(sum((1 - r) * v) / sum(1 - r), 2), 1e-3 * any_value(var)), greatest(sum(r * v * v) / sum(r) - power(sum(r * v) / sum(r), 2), 1e-3 * any_value(var)), sum(lse), abs(sum(lse) - any_value(ll)) < 1e-6
  FROM (SELECT *, top + ln(exp(f0 - top) + exp(f1 - top)) AS lse, exp(f1 - top) / (exp(f0 - top) + exp(f1 - top)) AS r FROM (SELECT *, greatest(f0, f1) AS top FROM (
    SELECT em.*, c.v, var, ln(1 - p + 1e-300) - 0.5 * ln(2 * pi() * v0) - 0.5 * (v - m0) * (v - m0) / v0 AS f0, ln(p + 1e-300) - 0.5 * ln(2 * pi() * v1) - 0.5 * (v - m1) * (v - m1) / v1 AS f1 FROM em JOIN c USING (metric) JOIN z USING (metric) WHERE NOT done AND step < 200))) GROUP BY metric),
mix AS (SELECT metric, done, CASE WHEN m0 <= m1 THEN m0 ELSE m1 END AS good, CASE WHEN m0 <= m1 THEN m1 ELSE m0 END AS bad, CASE WHEN m0 <= m1 THEN v0 ELSE v1 END AS vg, CASE WHEN m0 <= m1 THEN v1 ELSE v0 END AS vb, CASE WHEN m0 <= m1 THEN p ELSE 1 - p END AS pi FROM (SELECT *, max(step) OVER (PARTITION BY metric) AS last FROM em) WHERE step = last),
dens AS (SELECT metric, k, g, good, bad, (1 - pi) / sqrt(vg) * exp(-0.5::DOUBLE * (g - good) * (g - good) / vg) AS a, pi / sqrt(vb) * exp(-0.5::DOUBLE * (g - bad) * (g - bad) / vb) AS b FROM grid JOIN mix USING (metric)),
split AS (SELECT metric, coalesce(min(g) FILTER (g > good AND b / (a + b + 1e-300) >= 0.5), CASE WHEN count(*) FILTER (g >= good AND g <= bad) >= 3 THEN min_by(g, a + b) FILTER (g >= good AND g <= bad) END) AS crossover FROM dens GROUP BY metric),
two AS (SELECT *, abs(bad - good) / sqrt((vg + vb) / 2) AS sep FROM mix),
cut AS (SELECT s.*, iqr_fence, mad_fence, otsu, valley, crossover, knee, sep, pi, done AND sep >= 2 AND pi BETWEEN 0.01 AND 0.45 AS apart FROM s JOIN iqr USING (metric) JOIN otsu USING (metric) LEFT JOIN dip USING (metric) JOIN split USING (metric) JOIN knee USING (metric) JOIN two USING (metric)),
rec AS (SELECT *, CASE WHEN apart OR valley IS NOT NULL THEN coalesce((least(crossover, valley) + greatest(crossover, valley)) / 2, greatest(mad_fence, iqr_fence)) ELSE least(greatest(mad_fence, iqr_fence), p99) END AS raw FROM cut),
shown AS (SELECT *, round(least(greatest(raw, med), top), 3) AS r FROM rec)
SELECT metric, n, CASE WHEN up THEN 'higher' ELSE 'lower' END AS direction,
  {cols},
  CASE WHEN up THEN round(least(100, greatest(0, 100 - r)), 3) ELSE r END AS recommended,
  CASE WHEN apart OR valley IS NOT NULL THEN 'bimodal (' || CASE WHEN apart AND valley IS NOT NULL THEN 'GMM sep=' || printf('%.1f', sep) || ' + KDE valley' WHEN apart THEN 'GMM sep=' || printf('%.1f', sep) || ', P(bad)=' || printf('%.0f', 100 * pi) || '%' ELSE 'KDE valley (GMM sep=' || printf('%.1f', sep) || '<2.0)' END || '): good/bad crossover'
    ELSE 'unimodal (sep=' || printf('%.1f', sep) || '<2.0, no KDE valley): robust MAD/IQR fence' END AS rationale FROM shown""".replace("{cols}", ", ".join(f"CASE WHEN up AND {c} IS NOT NULL THEN round(least(100, greatest(0, 100 - round({c}, 3))), 3) ELSE round({c}, 3) END AS {n}" for c, n in (("iqr_fence", "iqr_fence"), ("mad_fence", "mad_fence"), ("p975", "percentile"), ("otsu", "otsu"), ("valley", "kde_valley"), ("crossover", "gmm_crossover"), ("knee", "kneedle"))))


@query(SNAP + THRESHOLDS)
def distance_thresholds(spark: SparkSession, d: str) -> DataFrame:
    got = thresholds.suggest_thresholds(Scratch(spark, "points").table(_points(spark, d), "points"), metrics={"distance_m": "lower", "position_pct": "higher"})
    cuts = thresholds.METHODS[:-1]
    rows = [(m, v["n"], v["direction"], *(v["methods"][c] for c in cuts), v["recommended"], v["rationale"]) for m, v in got["metrics"].items()]
    return spark.createDataFrame(rows, "metric string, n long, direction string, " + ", ".join(f"{c} double" for c in cuts) + ", recommended double, rationale string")


@query("""
SELECT id, 'shift' AS family, m::DOUBLE AS magnitude, round(x1, 6) AS first_x, round(y1 + m, 6) AS first_y, round(x2, 6) AS last_x, round(y2 + m, 6) AS last_y, 2 AS vertices FROM ae, (VALUES (2), (4), (8)) t(m)
UNION ALL SELECT id, 'longitudinal', m::DOUBLE, round(x1 + m, 6), round(y1, 6), round(x2 + m, 6), round(y2, 6), 2 FROM ae, (VALUES (5), (10)) t(m)
UNION ALL SELECT id, 'crop', m, round(x1 + 45 * m, 6), round(y1, 6), round(x2 - 45 * m, 6), round(y2, 6), 2 FROM ae, (VALUES (0.2::DOUBLE), (0.8::DOUBLE)) t(m)""")
def perturbed_edges(spark: SparkSession, d: str) -> DataFrame:
    p = perturb.sweep(derived.a_edges(spark, d), {"shift": [2, 4, 8], "longitudinal": [5, 10], "crop": [0.2, 0.8]})
    return p.select("id", "family", "magnitude", *_ends(True), F.size("pts").alias("vertices"))


@query(PAIRS + """, deg AS (SELECT id_a, count(*) AS n FROM pairs GROUP BY id_a) SELECT n, count(*) AS sources FROM deg GROUP BY n""")
def candidates_per_source(spark: SparkSession, d: str) -> DataFrame:
    return quality.pair_figures(spark, derived.a_edges(spark, d), derived.b_edges(spark, d), RADIUS)
