"""Mode 3: whole source networks matched at once, one weakly connected component in each row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import batch as many
from roadweave.functions import dag
from roadweave.operators.components import connected_components
from roadweave.operators.spatial import measured, within_join
from roadweave.plans.scratch import Scratch, kernel_parts

PAIR = "source_id {a}, dest_id {b}, a_seq int, place int, b_seq int, dist_m double, turn double, a_from double, a_to double, a_size double, b_from double, b_to double, b_size double"
#: Names of the output columns.
PARTS = ("source_id", "part", "part_type", "dest_id", "a_from_m", "a_to_m", "a_len_m", "a_pct", "n_pairs", "n_a_arcs", "n_b_arcs", "drift_m", "drift_max_m", "bearing_diff_deg", "b_from_m", "b_to_m", "b_len_m", "b_head_m", "b_tail_m")


def components_of(a: DataFrame, decimals: int = 3) -> DataFrame:
    """Adds `component` to edges (id, pts): edges whose vertices meet (rounded alike) share one."""
    key = lambda p: F.concat_ws(",", F.round(p["x"], decimals).cast("string"), F.round(p["y"], decimals).cast("string"))
    ends = a.where(F.size("pts") > 0).withColumn("_u", F.array_min(F.transform("pts", key)))
    # an edge goes by its least vertex; only vertices that edges of different names share join anything
    met = ends.select("_u", F.explode(F.transform("pts", key)).alias("_v"))
    shared = met.groupBy("_v").agg(F.min("_u").alias("_w"), F.max("_u").alias("_x")).where("_w <> _x").select("_v", "_w")
    links = Scratch(a.sparkSession, "dag").table(met.join(shared, "_v").where("_u <> _w").select("_u", "_w").distinct(), "links")
    if links.isEmpty():
        return ends.withColumnRenamed("_u", "component")
    parts = connected_components(links, "_u", "_w")
    return ends.join(parts, F.col("_u") == F.col("node"), "left").withColumn("component", F.coalesce("component", "_u")).drop("_u", "node")


def stretches(pairs: DataFrame) -> DataFrame:
    """Rows of PARTS: stretches of each source edge by the target edge they follow, from rows of PAIR.

    In the order of travel (segment, then place in its run) the rows before the first change of target segment lead, those
    after the last one trail. Of these, source segments other than the one next to the rest overhang: they are the head and
    the tail. What is left falls into islands of one target edge. Stretches lie end to end from the first matched segment on.
    """
    way = Window.partitionBy("source_id").orderBy("a_seq", "place")
    whole = Window.partitionBy("source_id")
    turns = lambda *c: F.coalesce(F.struct(*c) != F.lag(F.struct(*c)).over(way), F.lit(False))
    p = pairs.withColumn("_turn", turns("dest_id", "b_seq").cast("int")).withColumn("_next", turns("a_seq").cast("int"))
    p = p.withColumn("_turns", F.sum("_turn").over(way)).withColumn("_all", F.sum("_turn").over(whole))
    lead, trail, one = F.col("_turns") == 0, F.col("_turns") == F.col("_all"), F.col("_all") == 0  # one target segment: nothing overhangs
    p = p.withColumn("_near", F.max(F.when(lead, F.col("a_seq"))).over(whole)).withColumn("_far", F.min(F.when(trail, F.col("a_seq"))).over(whole))
    p = p.withColumn("head", lead & ~one & (F.col("a_seq") != F.col("_near"))).withColumn("tail", trail & ~one & (F.col("a_seq") != F.col("_far")))
    p = p.withColumn("part_type", F.when(F.col("head"), "head").when(F.col("tail"), "tail").otherwise("match"))
    mine = F.struct("part_type", "dest_id")
    p = p.withColumn("new", F.coalesce(mine != F.lag(mine).over(way), F.lit(True)).cast("int"))
    p = p.withColumn("part", F.sum("new").over(way).cast("int")).withColumn("begins", F.first("a_from").over(way))
    s = p.groupBy("source_id", "part").agg(
        *(F.first(c).alias(c) for c in ("part_type", "dest_id", "begins", "a_size", "b_size")), F.max("a_to").alias("ends"), F.count("*").cast("int").alias("n_pairs"), F.sum(F.greatest("new", "_next")).cast("int").alias("n_a_arcs"), F.countDistinct("b_seq").cast("int").alias("n_b_arcs"),
        F.avg("dist_m").alias("drift_m"), F.max("dist_m").alias("drift_max_m"), F.avg("turn").alias("bearing_diff_deg"), F.min("b_from").alias("b_from_m"), F.max("b_to").alias("b_to_m"),
    )
    along = Window.partitionBy("source_id").orderBy("part")
    s = s.withColumn("a_to_m", F.greatest("begins", F.max("ends").over(along))).withColumn("a_from_m", F.coalesce(F.lag("a_to_m").over(along), "begins"))
    s = s.withColumn("a_len_m", F.col("a_to_m") - F.col("a_from_m")).withColumn("a_pct", F.when(F.col("a_size") > 0, 100.0 * F.col("a_len_m") / F.col("a_size")).otherwise(0.0))
    return s.withColumns({"b_len_m": F.col("b_size"), "b_head_m": F.col("b_from_m"), "b_tail_m": F.col("b_size") - F.col("b_to_m")}).select(*PARTS)


def check_rules(pairs: DataFrame, arcs_a: DataFrame, arcs_b: DataFrame) -> DataFrame:
    """(u, v, rule) of pairs (u, v) that break a rule, as joins; arcs are (tail, head).

    step_back: a predecessor of u lies ahead of v. unfed: v is no continuation of u's run, and some predecessor of u has
    neither v nor a cell before it. stuck: the same for successors.
    """
    p = pairs.select("u", "v").distinct()
    aa, bb = arcs_a.select(F.col("tail").alias("a0"), F.col("head").alias("a1")).distinct(), arcs_b.select(F.col("tail").alias("b0"), F.col("head").alias("b1")).distinct()
    there = p.select(F.col("u").alias("p"), F.col("v").alias("w"))
    back = p.join(aa, p["u"] == aa["a1"]).join(bb, F.col("v") == bb["b0"]).join(there, (F.col("a0") == F.col("p")) & (F.col("b1") == F.col("w")), "left_semi")

    def lacking(u: str, near: str, v: str, cell: str) -> DataFrame:
        steps = p.join(bb, p["v"] == bb[v]).select("u", "v", F.col(cell).alias("w"))  # cells next to v on that side
        ends = p.join(steps.join(there, (F.col("u") == F.col("p")) & (steps["w"] == there["w"]), "left_semi"), ["u", "v"], "left_anti")
        asked = ends.join(aa, ends["u"] == aa[u]).select("u", "v", F.col(near).alias("n"))
        ways = asked.select("u", "v", "n", F.col("v").alias("w")).unionByName(asked.join(bb, asked["v"] == bb[v]).select("u", "v", "n", F.col(cell).alias("w")))
        met = ways.join(there, (F.col("n") == F.col("p")) & (ways["w"] == there["w"]), "left_semi").select("u", "v", "n").distinct()
        return asked.join(met, ["u", "v", "n"], "left_anti")

    named = lambda df, rule: df.select("u", "v", F.lit(rule).alias("rule")).distinct()
    return named(back, "step_back").unionByName(named(lacking("a1", "a0", "b1", "b0"), "unfed")).unionByName(named(lacking("a0", "a1", "b0", "b1"), "stuck"))


def placed_edges(a: DataFrame, decimals: int = 3) -> DataFrame:
    return Scratch(a.sparkSession, "dag").table(components_of(a.where(F.size("pts") > 1), decimals), "placed")


def meetings(placed: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """(component, a, b): the edges of each component of the source and the target edges within reach of it, in one row."""
    near = measured(within_join(placed.select(F.col("component").alias("id"), "pts"), b.select("id", "pts"), reach, exact=False), reach)
    edge, parts = F.struct("id", "pts"), kernel_parts(placed.sparkSession)
    near = near.select(F.col("id_a").alias("component"), F.col("id_b").alias("id"), F.col("pts_b").alias("pts")).repartition(parts, "component")
    own = placed.repartition(parts, "component").groupBy("component").agg(F.array_sort(F.collect_list(edge)).alias("a"))
    return own.join(near.groupBy("component").agg(F.array_sort(F.collect_set(edge)).alias("b")), "component", "left")


def _line(e: dict) -> tuple:
    return e["id"], [(p["x"], p["y"]) for p in e["pts"]]


#: Pairs of segments of both sides (estimated) of components that are taken together, and of one that is taken alone.
TOGETHER, ALONE = 2_000_000, 200_000


class _Side:
    """The edges of a column (component by component) as arrays; `whole` tells rows that have all their numbers."""

    def __init__(self, edges: pa.ListArray, step: float):
        self.counts = edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = edges.flatten()
        self.ids, pts = flat.field("id"), flat.field("pts")
        self.sizes = pts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        p = pts.flatten()
        self.points = np.stack([p.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xy"], axis=1).reshape(-1, 2)
        row = np.repeat(np.arange(len(edges)), self.counts)
        line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        add = lambda at, x=None: np.bincount(at, x, minlength=len(edges))
        self.whole = (add(row[line], ~np.isfinite(self.points).all(1)) == 0) & (add(row, pts.is_null().to_numpy(zero_copy_only=False)) == 0)
        d = np.where(line[1:] == line[:-1], np.hypot(*(self.points[1:] - self.points[:-1]).T), 0.0) if len(line) else np.zeros(0)
        self.stations = add(row[line[1:]], d) / step + add(row[line]) + 2 * self.counts if len(line) else 2.0 * self.counts

    def net(self, step: float, decimals: int) -> many.Nets:
        names = self.ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return many.nets(self.counts, names, self.sizes, self.points, step, decimals)


def _together(rows: pa.RecordBatch, least: int, reach: float, look: bool, radius: float, last: bool, alpha: float, beta: float, weight: float, step: float, decimals: int, most_rows: int, target: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of `match_dag`'s kernel for the components that are solved together, and which those are."""
    a, b = (_Side(rows.column(k), step) for k in "ab")
    x, y = a.net(step, decimals), b.net(step, decimals)
    c = many.candidates(x, y, radius, weight, least, look)
    s = many.solve(x, y, c, alpha, beta, most_rows)
    done = (np.isfinite(s.cost) | (s.none & last)) & (c.farthest <= reach if look else True)
    keep = done[s.owner]
    own, u, v, place = s.owner[keep], s.u[keep], s.v[keep], s.place[keep]
    turn = np.abs(x.bearing[u] - y.bearing[v]) % 360.0
    (a_from, a_to, a_size), (b_from, b_to, b_size) = many.spans(x), many.spans(y)
    pairs = [a.ids.take(pa.array(x.edge[u])), b.ids.take(pa.array(y.edge[v])), x.seq[u], place, y.seq[v], ((x.xy[u] - y.xy[v]) ** 2).sum(1) ** 0.5, np.minimum(turn, 360.0 - turn), a_from[u], a_to[u], a_size[u], b_from[v], b_to[v], b_size[v]]
    kind = target.field("pairs").type.value_type
    pairs = pa.StructArray.from_arrays([(p if isinstance(p, pa.Array) else pa.array(p)).cast(f.type) for p, f in zip(pairs, kind, strict=True)], fields=list(kind))
    at = np.flatnonzero(done)
    lists = lambda counts, values, name: pa.ListArray.from_arrays(pa.array(many.starts(counts).astype(np.int32)), values).cast(target.field(name).type)
    ids = a.ids.take(pa.array(np.flatnonzero(np.repeat(done, a.counts))))
    columns = [rows.column("component").take(pa.array(at)), pa.array(s.cost[at], mask=s.none[at]), pa.array(np.full(len(at), f"NoMatching: {dag.NOTHING}", object), mask=~s.none[at], type=pa.string()), pa.array(np.zeros(len(at), bool)), lists(a.counts[at], ids, "sources"), lists(np.bincount(own, minlength=len(done))[at], pairs, "pairs")]
    return pa.RecordBatch.from_arrays([k.cast(f.type) for k, f in zip(columns, target, strict=True)], schema=target), done


def plan_dag(a: DataFrame, b: DataFrame, max_distance: float = 20.0, bearing_weight: float = 2.0, step: float = 5.0, decimals: int = 3, k_min: int = 1, most_rows: int = 2_000_000) -> DataFrame:
    """(component, n_edges, vertices, profile_rows, elimination_rows, engine): what matching each component may need, before any is matched.

    The rows are bounds from the source's shape and the numbers of candidates; components without edges near, or with a
    cycle, have no engine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                got = {"component": row["component"], "n_edges": len(row["a"]), "vertices": None, "profile_rows": None, "elimination_rows": None, "engine": None}
                rows.append(got)
                try:
                    x, y = (dag.segment_net([_line(e) for e in row[k] or ()], step, decimals) for k in "ab")
                    dag.order_of(x)
                    got |= dag.plan(x, dag.candidates(x, y, max_distance, bearing_weight, k_min), most_rows)
                except ValueError:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("component", pa.string()), ("n_edges", pa.int64()), ("vertices", pa.int64()), ("profile_rows", pa.float64()), ("elimination_rows", pa.float64()), ("engine", pa.string())])
    return meetings(placed_edges(a, decimals), b, max_distance + step).mapInArrow(run, "component string, n_edges long, vertices long, profile_rows double, elimination_rows double, engine string")


def match_dag(a: DataFrame, b: DataFrame, max_distance: float = 20.0, alpha: float = 1.0, beta: float = 1.0, bearing_weight: float = 2.0, step: float = 5.0, decimals: int = 3, radii: tuple[float, ...] = (1.0,), k_min: int = 1, most_rows: int = 2_000_000, max_seconds: float | None = None, any_distance: bool = False) -> dict[str, DataFrame]:
    """{"long", "summary", "parts", "pairs", "costs", "errors"}: matches by edge pair, by source, by stretch and by segment, each component's cost, and components that have none.

    A component meets the B-edges near it in one row; a component without a valid matching at `max_distance` is tried at
    that times each of `radii`, then reported. Components are independent, so the total cost is that of the whole network.
    `most_rows` bounds a task's memory, not what is matched; `max_seconds`, if given, ends a component with an error.

    A source vertex without k_min targets within the radius takes the nearest k_min. They are sought among the edges within
    the reach of its component; with `any_distance` components that may have nearer ones beyond it look again, four times
    as far, until none has: then the nearest are the nearest at whatever distance, as long as there are k_min at all.
    """
    kinds = {"a": dict(a.dtypes)["id"], "b": dict(b.dtypes)["id"]}
    placed, reach = placed_edges(a, decimals), max_distance * max(radii) + step
    short = lambda s: s.format(**kinds).replace(", ", ",").replace(" ", ":")
    schema = f"component string, cost double, error string, far boolean, sources array<{kinds['a']}>, pairs array<struct<{short(PAIR)}>>"

    def run(batches: Iterator[pa.RecordBatch], reach: float, look: bool) -> Iterator[pa.RecordBatch]:
        """Components that are alike are solved together, the others one by one."""
        for batch in batches:
            sides = [_Side(batch.column(k), step) for k in "ab"]
            work = sides[0].stations * sides[1].stations
            light = np.flatnonzero(sides[0].whole & sides[1].whole & (work <= ALONE) & (sides[1].counts > 0)) if max_seconds is None else np.zeros(0, np.int64)
            alone = np.ones(batch.num_rows, bool)
            group = np.cumsum(work[light]) // TOGETHER
            for part in np.split(light, np.flatnonzero(np.diff(group)) + 1) if len(light) else ():
                solved, done = _together(batch.take(pa.array(part)), k_min, reach, look, max_distance * radii[0], len(radii) == 1, alpha, beta, bearing_weight, step, decimals, most_rows, target)
                alone[part[done]] = False
                yield solved
            yield from one_by_one([batch.filter(pa.array(alone))] if alone.any() else [], reach, look)

    def one_by_one(batches: Iterable[pa.RecordBatch], reach: float, look: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                got = {"component": row["component"], "cost": None, "error": "no edge is near", "far": look and not row["b"], "sources": [e["id"] for e in row["a"]], "pairs": []}
                rows.append(got)
                for grow in radii if row["b"] else ():
                    try:
                        x, y = dag.segment_net([_line(e) for e in row["a"]], step, decimals), dag.segment_net([_line(e) for e in row["b"]], step, decimals)
                        if look and dag.farthest(x, y, k_min) > reach:  # an edge that wasn't met is farther than the reach
                            got |= {"far": True}
                            break
                        cost, runs = dag.match_runs(x, y, max_distance * grow, alpha, beta, bearing_weight, k_min, most_rows, max_seconds)
                    except ValueError as e:
                        got["error"] = f"{type(e).__name__}: {e}"
                        continue
                    (at_a, size_a), (at_b, size_b) = dag.spans(x), dag.spans(y)
                    pairs = []
                    for u, v, place in ((u, v, k) for u, cells in enumerate(runs) for k, v in enumerate(cells)):
                        turn = abs(x.bearing[u] - y.bearing[v]) % 360.0
                        (af, at), (bf, bt) = at_a[u], at_b[v]
                        pairs.append({"source_id": x.road[u], "dest_id": y.road[v], "a_seq": x.seq[u], "place": place, "b_seq": y.seq[v], "dist_m": float(((x.xy[u] - y.xy[v]) ** 2).sum() ** 0.5), "turn": float(min(turn, 360.0 - turn)), "a_from": af, "a_to": at, "a_size": size_a[x.road[u]], "b_from": bf, "b_to": bt, "b_size": size_b[y.road[v]]})
                    got |= {"cost": cost, "error": None, "pairs": pairs}
                    break
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    scratch = Scratch(a.sparkSession, "dag")
    names = ["found-0"]
    found = scratch.table(meetings(placed, b, reach).mapInArrow(lambda it, r=reach: run(it, r, any_distance), schema), "found-0")
    if any_distance:
        x0, y0, x1, y1 = (F.expr(f"{f}({f.replace('min', 'array_min').replace('max', 'array_max')}(transform(pts, p -> p.{c})))") for f, c in (("min", "x"), ("min", "y"), ("max", "x"), ("max", "y")))
        corners = a.select("pts").union(b.select("pts")).where(F.size("pts") > 0).agg(x0, y0, x1, y1).first()
        span = sum(corners[k + 2] - corners[k] for k in (0, 1)) if corners[0] is not None else 0.0  # nothing is farther apart
        rest = found.where("far").select("component")
        while not rest.isEmpty():
            reach, look = 4 * reach, 4 * reach < span
            more = meetings(placed.join(rest, "component"), b, reach)
            names.append(f"found-{len(names)}")
            more = scratch.table(more.mapInArrow(lambda it, r=reach, k=look: run(it, r, k), schema), names[-1])
            rest = more.where("far").select("component")
        found = scratch.read(found.schema, *names).where("not far")
    pairs = found.select(F.explode("pairs").alias("p")).select("p.*")
    parts = stretches(pairs)
    long = pairs.groupBy("source_id", "dest_id").agg(F.min("a_seq").alias("s"), F.count("*").alias("n_pairs"), F.avg("dist_m").alias("avg_dist_m"), F.avg("turn").alias("avg_bearing_diff"))
    long = long.withColumn("seq", F.row_number().over(Window.partitionBy("source_id").orderBy("s", "dest_id"))).drop("s").select("source_id", "dest_id", "seq", "n_pairs", "avg_dist_m", "avg_bearing_diff")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("dest_id").cast("string").alias("d")))), lambda x: x["d"]), ";")
    whole = long.groupBy("source_id").agg(ids.alias("dest_ids"), F.countDistinct("dest_id").alias("n_dest"), F.sum("n_pairs").alias("n_pairs"), F.avg("avg_dist_m").alias("avg_dist_m"), F.avg("avg_bearing_diff").alias("avg_bearing_diff"))
    over = lambda kind: F.coalesce(F.sum(F.when(F.col("part_type") == kind, F.col("a_len_m"))), F.lit(0.0))
    ends = parts.groupBy("source_id").agg(F.count_if(F.col("part_type") == "match").alias("n_parts"), over("head").alias("a_head_m"), over("tail").alias("a_tail_m"))
    whole = whole.join(ends, "source_id", "left").withColumn("match_type", F.when(F.col("n_dest") > 1, "1:N_ROUTE").otherwise("1:1"))
    whole = whole.select("source_id", "dest_ids", "n_dest", "n_parts", "n_pairs", "avg_dist_m", "avg_bearing_diff", "a_head_m", "a_tail_m", "match_type")
    ok = found.where("error is null")
    return {"long": long, "summary": whole, "parts": parts, "pairs": pairs, "costs": ok.select("component", "cost", "sources"), "errors": found.where("error is not null").select("component", "sources", "error")}
