"""Mode 1: every A-edge matched to a connected route of B-edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import dtw, route
from roadweave.functions import geometry as G
from roadweave.operators.spatial import within_join
from roadweave.plans.scratch import Scratch, kernel_parts

#: Names of the output columns.
WHOLE = ("dtw_distance", "max_dtw_distance", "min_dtw_distance", "bearing_diff", "part_drift", "part_bearing_diff", "overlap_pct", "matched_len", "route_geom_wkt", "dp_cost")
SUMMARY = ("source_id", "n_edges", "dest_ids", *WHOLE, "match_type")
LONG = ("source_id", "dest_id", *route.MEMBER, "route_match_dist", "n_edges")
KINDS = {"seq": "int", "direction": "string", "n_points": "int", "overlap_pct": "long", "route_geom_wkt": "string"}
#: Sources that one numpy program takes at once.
TOGETHER = 512


@dataclass(frozen=True)
class RouteParameters:
    """max_turn: candidates whose bearing differs more from A's are left out (None: none are); stub_pct, stub_m: see describe."""

    max_distance: float = 25.0
    snap: float = 0.75
    step: float = 10.0
    emission: str = "point"
    bearing_weight: float = 0.0
    alpha: float = 1.0
    beta: float = 1.0
    trim: float = 0.0
    least_gap: float | None = None
    max_turn: float | None = None
    stub_pct: float = 0.0
    stub_m: float = 0.0

    @property
    def costs(self) -> route.Emission:
        return route.emission_of(self.emission, self.bearing_weight, self.alpha, self.beta)


def heading_differs(a: Column, b: Column, limit: float) -> Column:
    """Whether two lines head apart; a closed line has no heading."""
    closed = lambda p: F.element_at(p, 1) == F.element_at(p, -1)
    d = F.abs(G.line_bearing(a) - G.line_bearing(b))
    return (F.least(d, 360.0 - d) > limit) & ~closed(a) & ~closed(b)


def near_edges(a: DataFrame, b: DataFrame, q: RouteParameters) -> DataFrame:
    """(id_a, pts_a, near: the edges within the distance, by id), a source in each row; b may have `twin`, the id of an edge's opposite."""
    near = within_join(a.select("id", "pts"), b.select("id", "pts"), q.max_distance).where((F.size("pts_a") > 1) & (F.size("pts_b") > 1))
    if q.max_turn is not None:
        near = near.where(~heading_differs(F.col("pts_a"), F.col("pts_b"), q.max_turn))
    twin = F.lit(None).cast(dict(b.dtypes)["id"])
    if "twin" in b.columns:
        near, twin = near.join(b.select(F.col("id").alias("id_b"), "twin"), "id_b"), F.col("twin")
    edge = F.struct(F.col("id_b").cast("string").alias("name"), "id_b", "pts_b", twin.alias("twin"))  # by name, so that ties fall the same way each time
    return near.repartition(kernel_parts(a.sparkSession), "id_a").groupBy("id_a").agg(F.min("pts_a").alias("pts_a"), F.array_sort(F.collect_list(edge)).alias("near"))


def _twins(ids: pa.Array, twins: pa.Array, source: np.ndarray) -> np.ndarray | None:
    """The place of each edge's opposite among its own source's edges, or -1."""
    if twins.null_count == len(twins):
        return None
    names = pa.concat_arrays([ids, twins.cast(ids.type)]).dictionary_encode().indices.fill_null(-1).to_numpy()
    n = np.int64(names.max() + 1)
    own, want = source * n + names[: len(ids)], np.where(names[len(ids) :] < 0, -1, source * n + names[len(ids) :])
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own, want, sorter=order), len(order) - 1)
    return np.where(own[order[at]] == want, order[at], -1)


def _problems(parts: Iterator[pa.RecordBatch], q: RouteParameters) -> Iterator[tuple[pa.Array, pa.Array, route.Problem]]:
    """(ids of the sources, ids of the edges, problem) of up to TOGETHER sources at a time."""
    gap = route.gap_of(q.least_gap, q.step, q.costs)
    for whole in parts:
        for at in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(at, TOGETHER)
            near = batch.column("near")
            flat = near.flatten()
            xy_a, bounds_a = dtw.vertices(batch.column("pts_a"))
            xy_b, bounds_b = dtw.vertices(flat.field("pts_b"))
            edges = route.bounds_of(near.value_lengths().to_numpy())
            ids = flat.field("id_b")
            twins = _twins(ids, flat.field("twin"), np.repeat(np.arange(batch.num_rows), np.diff(edges)))
            yield batch.column("id_a"), ids, route.problem(xy_a, bounds_a, xy_b, bounds_b, edges, q.snap, q.step, gap, twins)


def _columns(of: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {KINDS.get(c, 'double')}" if of == "row" else f"{c}:{KINDS.get(c, 'double')}" for c in names)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _members(kind: pa.DataType, ids: pa.Array, bounds: np.ndarray, members: dict) -> pa.Array:
    """A list of members for each route."""
    columns = {**members, "dest_id": ids.take(pa.array(members["edge"])), "direction": np.repeat("forward", len(members["edge"]))}
    struct = pa.StructArray.from_arrays([v.cast(f.type) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in kind.value_type], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct, type=kind)


def match_routes(a: DataFrame, b: DataFrame, parameters: RouteParameters | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """(long, summary): an edge of a route in each row; a source in each row, NO_MATCH where there is no route.

    The candidates of a source meet in one row by one shuffle on its id; routes are found without another, and both tables
    come from the written result. Each source sees only the edges near it, so a task holds a few at a time. A member lies
    from edge_b_from_m to edge_b_to_m along its edge, the whole edge if it is neither first nor last. dp_cost is the sum that
    was minimised; dtw_distance is the mean distance of the route.
    """
    q = parameters or RouteParameters(**more)
    kinds = {"a": dict(a.dtypes)["id"], "b": dict(b.dtypes)["id"]}
    schema = f"source_id {kinds['a']}, edges array<struct<dest_id:{kinds['b']},{_columns('struct', route.MEMBER)}>>, {_columns('row', WHOLE)}"
    target = _arrow(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sources, ids, problem in _problems(parts, q):
            ways = route.ways(problem, q.costs)
            routes, bounds, members, whole = route.describe(problem, q.costs, ways, q.trim, q.stub_pct, q.stub_m)
            if len(routes):
                found = [sources.take(pa.array(ways.source[routes])), _members(target.field("edges").type, ids, bounds, members)]
                yield pa.RecordBatch.from_arrays([*found, *(pa.array(whole[c], target.field(c).type) for c in WHOLE)], schema=target)

    found = Scratch(a.sparkSession, "routes").table(near_edges(a, b, q).mapInArrow(run, schema), "found")
    n = F.size("edges").cast("long")
    e = found.select("source_id", F.col("dtw_distance").alias("route_match_dist"), n.alias("n_edges"), F.explode("edges").alias("e"))
    long = e.select("source_id", "e.*", "route_match_dist", "n_edges").select(*LONG)
    summary = found.select("source_id", n.alias("n_edges"), F.transform("edges", lambda x: x["dest_id"]).alias("dest_ids"), *WHOLE, F.when(n > 1, "1:N_ROUTE").otherwise("1:1").alias("match_type"))
    lost = a.select(F.col("id").alias("source_id")).distinct().join(found.select("source_id"), "source_id", "left_anti")
    lost = lost.select("source_id", F.lit(0).cast("long").alias("n_edges"), F.lit("NO_MATCH").alias("match_type"))
    return long, summary.unionByName(lost, allowMissingColumns=True).select(*SUMMARY)


def route_costs(a: DataFrame, b: DataFrame, parameters: RouteParameters | None = None, **more) -> DataFrame:
    """(source_id, cost): the least cost of each source with edges near, whether or not its way is a route."""
    q = parameters or RouteParameters(**more)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sources, _, problem in _problems(parts, q):
            ways = route.ways(problem, q.costs)
            costs = np.full(len(sources), np.nan)
            costs[ways.source] = ways.cost
            yield pa.RecordBatch.from_arrays([sources, pa.array(costs, pa.float64(), from_pandas=True)], names=["source_id", "cost"])

    return near_edges(a, b, q).mapInArrow(run, f"source_id {dict(a.dtypes)['id']}, cost double")


def route_lattice(a: DataFrame, b: DataFrame, k_max: int = 8, parameters: RouteParameters | None = None, **more) -> DataFrame:
    """The k cheapest different routes of each source, ranked from 0 (equal costs by their edges): (source_id, rank, dp_cost, drift_m, overlap_pct, bearing_diff, a_len, dest_ids, claims).

    For each edge to begin on, the table is filled with its first row open there only, which gives the exact optimum for each
    edge to end on; of ways with the same edges the cheapest counts. Rank 0 is match_routes' route but for ties. Routes that are the best
    for no pair of ends aren't there: this is a cover, not a list of the k best of all. claims: (dest_id, seq, from_m, to_m),
    the parts of B that a route uses; an edge may occur twice in one.
    """
    q = parameters or RouteParameters(**more)
    kinds = {"a": dict(a.dtypes)["id"], "b": dict(b.dtypes)["id"]}
    schema = f"source_id {kinds['a']}, rank int, dp_cost double, drift_m double, overlap_pct long, bearing_diff double, a_len double, claims array<struct<dest_id:{kinds['b']},seq:int,from_m:double,to_m:double>>"
    target = _arrow(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sources, ids, problem in _problems(parts, q):
            ways = route.ways(problem, q.costs, each_entry=True)
            routes, bounds, members, whole = route.describe(problem, q.costs, ways, q.trim, q.stub_pct, q.stub_m)
            kept, ranks = different(ways.source[routes], np.round(ways.cost[routes], route.PLACES), bounds, members["edge"], k_max)
            if len(kept):
                size = np.diff(bounds)[kept]
                pick = route.ranges(bounds[kept], size)
                claims = {"edge": members["edge"][pick], "seq": members["seq"][pick], "from_m": members["edge_b_from_m"][pick], "to_m": members["edge_b_to_m"][pick]}
                columns = {"rank": ranks, "dp_cost": whole["dp_cost"][kept], "drift_m": whole["dtw_distance"][kept], "overlap_pct": whole["overlap_pct"][kept], "bearing_diff": whole["bearing_diff"][kept], "a_len": whole["a_len"][kept]}
                yield pa.RecordBatch.from_arrays([
                    sources.take(pa.array(ways.source[routes][kept])), *(pa.array(v, target.field(c).type) for c, v in columns.items()), _members(target.field("claims").type, ids, route.bounds_of(size), claims),
                ], schema=target)

    found = near_edges(a, b, q).mapInArrow(run, schema)
    return found.select("source_id", "rank", "dp_cost", "drift_m", "overlap_pct", "bearing_diff", "a_len", F.transform("claims", lambda c: c["dest_id"]).alias("dest_ids"), "claims")


def different(source: np.ndarray, cost: np.ndarray, bounds: np.ndarray, edges: np.ndarray, k_max: int) -> tuple[np.ndarray, np.ndarray]:
    """(routes, ranks): of routes in order of source, the k cheapest different sequences of edges; equal costs by their edges."""
    names = [tuple(edges[bounds[k] : bounds[k + 1]].tolist()) for k in range(len(source))]
    order = sorted(range(len(source)), key=lambda k: (source[k], cost[k], names[k]))
    kept, ranks, seen, now = [], [], set(), None
    for k in order:
        if source[k] != now:
            now, seen = source[k], set()
        if names[k] not in seen and len(seen) < k_max:
            kept.append(k)
            ranks.append(len(seen))
            seen.add(names[k])
    return np.array(kept, np.int64), np.array(ranks, np.int64)


def resolve_routes(summary: DataFrame, long: DataFrame | None = None, *, max_match_dist: float | None = None, max_bearing_diff: float | None = None, min_overlap_pct: float | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Routes beyond a limit become NO_MATCH, and their edges go; part_drift and part_bearing_diff stay."""
    fails = F.lit(False)
    for column, limit, worse in (("dtw_distance", max_match_dist, lambda c, v: c > v), ("bearing_diff", max_bearing_diff, lambda c, v: c > v), ("overlap_pct", min_overlap_pct, lambda c, v: c < v)):
        if limit is not None:
            fails = fails | F.coalesce(worse(F.col(column), limit), F.lit(False))
    marked = summary.withColumn("_fails", fails & (F.col("match_type") != "NO_MATCH"))
    blank = {c: F.when(~F.col("_fails"), F.col(c)) for c in ("dest_ids", "dtw_distance", "max_dtw_distance", "min_dtw_distance", "bearing_diff", "overlap_pct", "matched_len", "route_geom_wkt")}
    out = marked.withColumns({**blank, "n_edges": F.when(F.col("_fails"), F.lit(0).cast("long")).otherwise(F.col("n_edges")), "match_type": F.when(F.col("_fails"), "NO_MATCH").otherwise(F.col("match_type"))})
    kept = long.join(marked.where("_fails").select("source_id"), "source_id", "left_anti") if long is not None else None
    return out.select(*summary.columns), kept


def edge_usage(long: DataFrame) -> DataFrame:
    """How much of each B-edge the routes use, and how many sources use it."""
    u = long.groupBy("dest_id").agg(F.sum("edge_matched_len").alias("used_m"), F.min("edge_b_len").alias("b_len_m"), F.countDistinct("source_id").alias("n_sources"))
    return u.withColumn("used_pct", F.when(F.col("b_len_m") > 0, 100.0 * F.col("used_m") / F.col("b_len_m")))


def validation_report(summary: DataFrame, long: DataFrame) -> DataFrame:
    """One row of figures about a run."""
    ok = F.col("match_type") != "NO_MATCH"
    s = summary.agg(
        F.count_if(ok).alias("matched"), F.count_if(~ok).alias("no_match"), F.percentile("overlap_pct", 0.5).alias("median_overlap"), F.avg("overlap_pct").alias("mean_overlap"), F.count_if(F.col("overlap_pct") < 95).alias("covered_below_95"),
        F.percentile("dtw_distance", 0.5).alias("median_drift"), F.percentile("dtw_distance", 0.9).alias("p90_drift"), F.count_if(F.col("dtw_distance") > 10).alias("drift_over_10"), F.count_if(F.col("dtw_distance") > 25).alias("drift_over_25"),
    )
    u = edge_usage(long).agg(F.percentile("used_pct", 0.5).alias("median_usage"), F.count_if(F.col("used_pct") < 95).alias("used_below_95"), F.count_if(F.col("used_pct") > 110).alias("used_over_110"), F.count_if(F.col("n_sources") > 1).alias("contested"))
    return s.withColumn("k", F.lit(1)).join(u.withColumn("k", F.lit(1)), "k").drop("k")


def worst(summary: DataFrame, column: str = "dtw_distance", k: int = 10, largest: bool = True) -> DataFrame:
    """The k matched sources with the largest (or least) value of a column, for a report; ties by id."""
    by = F.desc(column) if largest else F.asc(column)
    return summary.where((F.col("match_type") != "NO_MATCH") & F.col(column).isNotNull()).orderBy(by, "source_id").limit(k)


def swept_routes(a: DataFrame, b: DataFrame, grids: dict[str, list[float]], parameters: RouteParameters | None = None, **more) -> DataFrame:
    """(id, family, magnitude, dest_ids, base_ids): the routes of every perturbed copy of every edge, beside the edge's own.

    All copies are matched in one run; `perturb.first_change` says from which magnitude on a route changes or is lost.
    """
    from roadweave.operators.perturb import sweep

    name = F.concat_ws("|", F.col("id").cast("string"), "family", F.col("magnitude").cast("string"))
    copies = Scratch(a.sparkSession, "sweep").table(sweep(a, grids).withColumn("copy", name), "copies")
    found = match_routes(copies.select(F.col("copy").alias("id"), "pts"), b, parameters, **more)[1].select(F.col("source_id").alias("copy"), "dest_ids")
    own = match_routes(a, b, parameters, **more)[1].select(F.col("source_id").alias("id"), F.col("dest_ids").alias("base_ids"))
    return copies.select("id", "family", "magnitude", "copy").join(found, "copy").join(own, "id").select("id", "family", "magnitude", "dest_ids", "base_ids")


def with_twins(b: DataFrame, decimals: int = 3) -> DataFrame:
    """b with `twin`: the edge that runs the other way between the same ends, of the same length; null where there is none.

    Parallel roads between two junctions differ in length. Where several edges fit, the n-th by id is the n-th one's twin.
    """
    end = lambda k: F.concat_ws(",", *(F.round(F.element_at("pts", k)[c], decimals).cast("string") for c in "xy"))
    e = b.select("id", end(1).alias("_from"), end(-1).alias("_to"), F.round(G.length(F.col("pts")), decimals).alias("_size"))
    e = e.withColumn("_nth", F.row_number().over(Window.partitionBy("_from", "_to", "_size").orderBy("id")))
    back = e.where("_from <> _to").select(F.col("id").alias("twin"), F.col("_to").alias("_from"), F.col("_from").alias("_to"), "_size", "_nth")
    return b.join(e.join(back, ["_from", "_to", "_size", "_nth"], "left").select("id", "twin"), "id")
