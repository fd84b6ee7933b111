"""Which of its candidate routes each source takes, so that few metres of B are used twice.

A source takes one of its candidates (route_lattice) or none. A candidate costs the distance from B summed along A, with tau
metres for each metre of A that it leaves out: a_len * (o * drift + (1 - o) * tau), o being its overlap; none costs
a_len * tau. Each metre of B that k chosen routes use costs mu * (k - 1) more. The sum is minimised exactly:

* claims: the parts of B's edges that candidates use, keyed by source, rank and place in the route;
* atoms: the pieces between the ends of claims on an edge, by lead() over all ends, with the candidates that cover each;
* persistency: candidates that no best choice needs go, by joins; what is left of a source with one candidate is settled;
* components of sources that share an atom, and in each a branch and bound whose bound prices every atom at what is already
  chosen, so that it never exceeds the cost.

Everything but the last is DataFrame work. Components are those of the pruned candidates, and settled sources only leave
their use of B behind, as a price, so they join no components together. A component with more than `most` open sources is
split: blocks of `most` sources are solved exactly with the others as they are, again and again, until no block gets cheaper
(no block can then be bettered; marked `exact` = false). A component is one task's work: its candidates and atoms, not its
geometry, must fit in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.components import connected_components
from roadweave.plans.scratch import Scratch, kernel_parts

#: Metres below which two ends of claims are one, and below which costs are equal.
SAME = 1e-9
NONE = -1


def assignment_cost(tau: float) -> Column:
    o = F.least(F.lit(1.0), F.col("overlap_pct") / 100.0)
    return F.col("a_len") * (o * F.col("drift_m") + (1.0 - o) * tau)


def candidates(lattice: DataFrame, tau: float) -> DataFrame:
    """(source_id, rank, cost, claimed, claims): every candidate and the choice of none (rank NONE, without claims)."""
    claimed = F.aggregate("claims", F.lit(0.0), lambda s, c: s + c["to_m"] - c["from_m"])
    routes = lattice.select("source_id", F.col("rank").cast("int").alias("rank"), assignment_cost(tau).alias("cost"), claimed.alias("claimed"), "claims")
    none = lattice.groupBy("source_id").agg(F.max("a_len").alias("a_len")).select("source_id", F.lit(NONE).alias("rank"), (F.col("a_len") * tau).alias("cost"), F.lit(0.0).alias("claimed"), F.array().cast(dict(lattice.dtypes)["claims"]).alias("claims"))
    return routes.unionByName(none)


def claims_of(cands: DataFrame) -> DataFrame:
    """(source_id, rank, dest_id, seq, from_m, to_m) of claims of some length; an edge may occur twice in a route."""
    return cands.select("source_id", "rank", F.explode("claims").alias("c")).select("source_id", "rank", "c.dest_id", "c.seq", "c.from_m", "c.to_m").where(F.col("to_m") > F.col("from_m") + SAME)


def atoms_of(claims: DataFrame) -> DataFrame:
    """(dest_id, lo_m, hi_m): the pieces of each edge between neighbouring ends of claims."""
    ends = claims.select("dest_id", F.explode(F.array("from_m", "to_m")).alias("lo_m")).distinct()
    return ends.withColumn("hi_m", F.lead("lo_m").over(Window.partitionBy("dest_id").orderBy("lo_m"))).where(F.col("hi_m") > F.col("lo_m") + SAME)


def covers(claims: DataFrame, atoms: DataFrame) -> DataFrame:
    """(dest_id, lo_m, width, source_id, rank): who may use each atom that at least two sources may use.

    A claim's atoms are those that begin within it: an equi-join on the edge with a range on it. A route that is twice on an
    atom covers it once.
    """
    met = claims.join(atoms, "dest_id").where((F.col("lo_m") >= F.col("from_m") - SAME) & (F.col("lo_m") < F.col("to_m") - SAME))
    met = met.select("dest_id", "lo_m", (F.col("hi_m") - F.col("lo_m")).alias("width"), "source_id", "rank").distinct()
    shared = met.groupBy("dest_id", "lo_m").agg((F.max("source_id") != F.min("source_id")).alias("shared")).where("shared").select("dest_id", "lo_m")
    return met.join(shared, ["dest_id", "lo_m"])


def prune(cands: DataFrame, tau: float, mu: float) -> DataFrame:
    """Candidates without those that some best choice can do without, and `least`, whether one is its source's cheapest.

    A penalty never falls when a claim is added, so none is as good as a candidate of no lower cost; and whoever changes to
    the source's cheapest adds at most mu times the metres that one claims. Both leave the least sum as it is.
    """
    by = Window.partitionBy("source_id")
    own = F.struct("cost", "rank")
    none = F.max(F.when(F.col("rank") == NONE, F.col("cost"))).over(by)
    kept = cands.withColumn("_none", none).where((F.col("rank") == NONE) | (F.col("cost") < F.col("_none") - SAME))
    kept = kept.withColumn("_best", F.min(F.struct("cost", "rank", "claimed")).over(by))
    kept = kept.where((own == F.struct(F.col("_best.cost").alias("cost"), F.col("_best.rank").alias("rank"))) | (F.col("cost") <= F.col("_best.cost") + mu * F.col("_best.claimed") + SAME))
    return kept.withColumn("least", F.col("rank") == F.col("_best.rank")).drop("_none", "_best")


def probe(lattice: DataFrame, tau: float, mu: float) -> DataFrame:
    """One row of figures that say whether a solve is worth running: how many sources are settled by persistency alone.

    frozen: sources with one candidate left, or whose candidates share no atom with another source's (those take their
    cheapest); open sources and the couplings between them are what a solve would be about.
    """
    scratch = Scratch(lattice.sparkSession, "probe")
    cands = scratch.table(candidates(lattice, tau), "candidates")
    left = scratch.table(prune(cands, tau, mu), "left")
    claims = claims_of(left)
    shared = scratch.table(covers(claims, atoms_of(claims)), "shared")
    state = _state(left, shared)
    n = state.agg(F.count("*").alias("sources"), F.count_if("settled").alias("settled"), F.count_if(~F.col("settled") & ~F.col("coupled")).alias("uncoupled"), F.count_if(~F.col("settled") & F.col("coupled")).alias("active"))
    c = cands.agg(F.count("*").alias("candidates"))
    p = left.agg(F.count("*").alias("candidates_left"))
    s = shared.groupBy("dest_id", "lo_m").agg(F.max("width").alias("width")).agg(F.count("*").alias("shared_atoms"), F.coalesce(F.sum("width"), F.lit(0.0)).alias("shared_m"))
    out = beside(n, c, p, s)
    frozen = F.col("settled") + F.col("uncoupled")
    return out.withColumn("frozen_pct", F.when(F.col("sources") > 0, 100.0 * frozen / F.col("sources")))


def beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = rows[0].withColumn("_k", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def _state(left: DataFrame, shared: DataFrame) -> DataFrame:
    """(source_id, settled, coupled): whether one candidate is left, and whether any shares an atom with another source."""
    coupled = shared.select("source_id").distinct().withColumn("_c", F.lit(True))
    return left.groupBy("source_id").agg((F.count("*") == 1).alias("settled")).join(coupled, "source_id", "left").select("source_id", "settled", F.coalesce("_c", F.lit(False)).alias("coupled"))


def choose(lattice: DataFrame, tau: float, mu: float, most: int = 24, pruned: bool = True) -> tuple[DataFrame, DataFrame]:
    """(choices, atoms paid for): the choice of least cost for all sources together.

    choices: (source_id, rank, cost, exact), rank NONE for none; atoms: (dest_id, lo_m, hi_m, routes, paid) of every piece of
    B that several chosen routes use. `pruned`: whether persistency comes first (it changes the work, not the least cost).
    """
    spark = lattice.sparkSession
    scratch = Scratch(spark, "choose")
    cands = scratch.table(candidates(lattice, tau), "candidates")
    best = F.row_number().over(Window.partitionBy("source_id").orderBy("cost", "rank")) == 1
    left = scratch.table(prune(cands, tau, mu) if pruned else cands.withColumn("least", best), "left")
    claims = claims_of(left)
    shared = scratch.table(covers(claims, atoms_of(claims)), "shared")
    state = scratch.table(_state(left, shared), "state")
    alone = left.join(state.where("settled or not coupled"), "source_id").where("least").select("source_id", "rank", "cost", F.lit(True).alias("exact"))
    open_ = state.where("not settled and coupled").select("source_id")
    # what settled sources use is a price for the others
    fixed = shared.join(state.where("settled").select("source_id"), "source_id").groupBy("dest_id", "lo_m").agg(F.countDistinct("source_id").alias("used"))
    moving = scratch.table(shared.join(open_, "source_id").join(fixed, ["dest_id", "lo_m"], "left").withColumn("used", F.coalesce("used", F.lit(0))), "moving")
    home = moving.groupBy("dest_id", "lo_m").agg(F.min("source_id").alias("u"))
    groups = connected_components(scratch.table(moving.join(home, ["dest_id", "lo_m"]).select("u", F.col("source_id").alias("v")).distinct(), "couplings"))
    groups = groups.select(F.col("node").alias("source_id"), F.col("component").alias("group"))
    atom = F.struct(F.concat_ws("/", F.col("dest_id").cast("string"), F.format_number("lo_m", 9)).alias("atom"), "width", "used")
    uses = moving.groupBy("source_id", "rank").agg(F.collect_list(atom).alias("atoms"))
    rows = left.join(groups, "source_id").join(uses, ["source_id", "rank"], "left").select("group", "source_id", "rank", "cost", F.coalesce("atoms", F.array().cast(dict(uses.dtypes)["atoms"])).alias("atoms"))
    kinds = dict(left.dtypes)

    def solve(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        return pack(table, mu, most)

    rows = rows.repartition(kernel_parts(spark), "group")
    solved = rows.groupBy("group").applyInPandas(solve, f"source_id {kinds['source_id']}, rank int, cost double, exact boolean")
    choices = scratch.table(alone.unionByName(solved), "choices")
    used = claims_of(cands.join(choices.select("source_id", "rank"), ["source_id", "rank"]))
    pieces = atoms_of(used)
    paid = covers(used, pieces).groupBy("dest_id", "lo_m").agg((F.first("lo_m") + F.max("width")).alias("hi_m"), F.countDistinct("source_id").alias("routes"), F.max("width").alias("width"))
    paid = paid.where("routes > 1").select("dest_id", "lo_m", "hi_m", "routes", (mu * F.col("width") * (F.col("routes") - 1)).alias("paid"))
    return choices, paid


def pack(table: pd.DataFrame, mu: float, most: int = 24) -> pd.DataFrame:
    """The cheapest choice of one component: (source_id, rank, cost, exact)."""
    names = {a: k for k, a in enumerate(dict.fromkeys(x["atom"] for row in table["atoms"] for x in row))}
    width, used = np.zeros(len(names)), np.zeros(len(names), np.int64)
    for row in table["atoms"]:
        for x in row:
            width[names[x["atom"]]], used[names[x["atom"]]] = x["width"], x["used"]
    options, sources = [], []
    for s, mine in table.sort_values(["source_id", "cost", "rank"], kind="stable").groupby("source_id", sort=True):
        sources.append(s)
        options.append([(float(c), int(r), np.array(sorted(names[x["atom"]] for x in a), np.int64)) for c, r, a in zip(mine["cost"], mine["rank"], mine["atoms"], strict=True)])
    if len(sources) <= most:
        picks, exact = cheapest(options, width, used, mu)
    else:
        picks, exact = in_rounds(options, width, used, mu, most), False
    chosen = [o[p] for o, p in zip(options, picks, strict=True)]
    return pd.DataFrame({"source_id": sources, "rank": np.array([c[1] for c in chosen], np.int32), "cost": [c[0] for c in chosen], "exact": exact})


def in_rounds(options: list, width: np.ndarray, used: np.ndarray, mu: float, most: int) -> list[int]:
    """Blocks of sources, each solved with the others as they are, until no block gets cheaper; those with most candidates first."""
    picks, count, better = settle(options, width, used, mu), used.copy(), True
    for o, p in zip(options, picks, strict=True):
        count[o[p][2]] += 1
    order = sorted(range(len(options)), key=lambda k: -len(options[k]))
    while better:
        better = False
        for block in (order[at : at + most] for at in range(0, len(order), most)):
            some, before = [options[k] for k in block], [picks[k] for k in block]
            for o, p in zip(some, before, strict=True):
                count[o[p][2]] -= 1
            now, _ = cheapest(some, width, count, mu)
            if total(some, now, width, count, mu) < total(some, before, width, count, mu) - SAME:
                better = True
                for k, p in zip(block, now, strict=True):
                    picks[k] = p
            for k in block:
                count[options[k][picks[k]][2]] += 1
    return picks


def settle(options: list, width: np.ndarray, used: np.ndarray, mu: float) -> list[int]:
    """A choice that no single source can make cheaper, from everyone's cheapest candidate."""
    picks, count, moved = [0] * len(options), used.copy(), True
    for o in options:
        count[o[0][2]] += 1
    while moved:
        moved = False
        for k, o in enumerate(options):
            count[o[picks[k]][2]] -= 1
            prices = [c + mu * float(width[a][count[a] > 0].sum()) for c, _, a in o]
            j = int(np.argmin(prices))
            if prices[j] < prices[picks[k]] - SAME:
                picks[k], moved = j, True
            count[o[picks[k]][2]] += 1
    return picks


def total(options: list, picks: list[int], width: np.ndarray, used: np.ndarray, mu: float) -> float:
    """What a choice costs: its candidates, and every metre of an atom for each use beyond the first."""
    count = used.copy()
    for o, p in zip(options, picks, strict=True):
        count[o[p][2]] += 1
    return sum(o[p][0] for o, p in zip(options, picks, strict=True)) + mu * float((width * (np.maximum(count - 1, 0) - np.maximum(used - 1, 0))).sum())


def cheapest(options: list, width: np.ndarray, used: np.ndarray, mu: float, nodes: int = 100_000) -> tuple[list[int], bool]:
    """(picks, whether they are proven): branch and bound, sources with the largest gaps between candidates first.

    The bound of the rest takes each source's cheapest candidate at the prices of what is chosen so far, which later choices
    can only raise. After `nodes` steps the best choice so far stands, unproven.
    """
    order = sorted(range(len(options)), key=lambda k: (-(options[k][1][0] - options[k][0][0]) if len(options[k]) > 1 else -np.inf, k))
    count, picks, left = used.copy(), [0] * len(options), nodes
    best = settle(options, width, used, mu)
    top = total(options, best, width, used, mu)
    price = lambda a: mu * float(width[a][count[a] > 0].sum())

    def go(depth: int, spent: float) -> None:
        nonlocal best, top, left
        left -= 1
        if depth == len(order):
            if spent < top - SAME:
                best, top = picks.copy(), spent
            return
        if left < 0 or spent + sum(min(c + price(a) for c, _, a in options[k]) for k in order[depth:]) >= top - SAME:
            return
        k = order[depth]
        for cost, j in sorted((c + price(a), j) for j, (c, _, a) in enumerate(options[k])):
            if spent + cost >= top - SAME:
                break
            a = options[k][j][2]
            picks[k] = j
            count[a] += 1
            go(depth + 1, spent + cost)
            count[a] -= 1

    go(0, 0.0)
    return best, left >= 0


def resolve_network(lattice: DataFrame, long: DataFrame, tau: float, mu: float, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """(claims of the chosen routes, issues): what match_routes gave per source, decided for all sources together.

    issues: `reselected` (another route than the cheapest), `dropped` (no route, though there were candidates) and
    `route_conflict` (a piece of B that several chosen routes still use), each with what it concerns.
    """
    choices, paid = choose(lattice, tau, mu, most)
    kept = lattice.join(choices.where(F.col("rank") != NONE).select("source_id", "rank"), ["source_id", "rank"])
    now = claims_of(kept.select("source_id", "rank", "claims"))
    before = long.select("source_id").distinct()
    source = F.col("source_id").cast("string")
    issues = choices.where(F.col("rank") > 0).select(F.lit("reselected").alias("issue"), source.alias("about"), F.col("rank").cast("double").alias("figure"))
    issues = issues.unionByName(choices.where(F.col("rank") == NONE).join(before, "source_id").select(F.lit("dropped").alias("issue"), source.alias("about"), F.col("cost").alias("figure")))
    return now, issues.unionByName(paid.select(F.lit("route_conflict").alias("issue"), F.concat_ws(":", F.col("dest_id").cast("string"), F.round("lo_m", 3).cast("string"), F.round("hi_m", 3).cast("string")).alias("about"), F.col("paid").alias("figure")))


def mirrored(long: DataFrame, a_twins: DataFrame, b_twins: DataFrame) -> DataFrame:
    """(source_id, dest_id, from_m, to_m, seq, n_edges): what each route says about its source's twin.

    a_twins, b_twins: (id, twin). Every member turns to its edge's twin, read from the other end; dest_id is null where that
    edge runs one way only.
    """
    m = long.select("source_id", "dest_id", "seq", "n_edges", "edge_b_from_m", "edge_b_to_m", "edge_b_len")
    m = m.join(a_twins.where("twin is not null").select(F.col("id").alias("source_id"), F.col("twin").alias("_other")), "source_id")
    m = m.join(b_twins.select(F.col("id").alias("dest_id"), F.col("twin").alias("_back")), "dest_id", "left")
    return m.select(F.col("_other").alias("source_id"), F.col("_back").alias("dest_id"), (F.col("edge_b_len") - F.col("edge_b_to_m")).alias("from_m"), (F.col("edge_b_len") - F.col("edge_b_from_m")).alias("to_m"), (F.col("n_edges") - 1 - F.col("seq")).cast("int").alias("seq"), "n_edges")


def twin_consistency(long: DataFrame, a_twins: DataFrame, b_twins: DataFrame, slack: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, proposals): whether both directions of a road were matched to both directions of the same road.

    pairs: a row for each twin pair of sources with a route on either side (source_id the smaller): own_m and twin_m, the
    metres of B of each, shared_m, those of the one that the other's mirror covers, and a status: `consistent` (all but
    `slack` metres on both sides), `partial`, `contradiction` (nothing shared), `one_sided`, and `one_way` where a member's
    edge has no twin, so that the two can't agree. It's a check, not a constraint: what is left is what a map has wrong.
    proposals: of each one-sided pair that could agree, the mirrored route of the side without one: (source_id, dest_id, seq,
    from_m, to_m).
    """
    spark = long.sparkSession
    scratch = Scratch(spark, "twins")
    back = scratch.table(mirrored(long, a_twins, b_twins), "mirrored")
    own = scratch.table(long.select("source_id", "dest_id", F.col("edge_b_from_m").alias("from_m"), F.col("edge_b_to_m").alias("to_m")), "own")
    size = lambda df, name: df.groupBy("source_id").agg(F.sum(F.col("to_m") - F.col("from_m")).alias(name))
    said = back.groupBy("source_id").agg(F.sum(F.col("to_m") - F.col("from_m")).alias("twin_m"), F.bool_or(F.col("dest_id").isNull()).alias("one_way"))
    both = own.join(back.select("source_id", "dest_id", F.col("from_m").alias("f"), F.col("to_m").alias("t")), ["source_id", "dest_id"])
    shared = both.groupBy("source_id").agg(F.sum(F.greatest(F.lit(0.0), F.least("to_m", "t") - F.greatest("from_m", "f"))).alias("shared_m"))
    pair = a_twins.where("twin is not null").select(F.col("id").alias("source_id"), F.col("twin").alias("twin_id"))
    rows = pair.join(size(own, "own_m"), "source_id", "left").join(said, "source_id", "left").join(shared, "source_id", "left").where("own_m is not null or twin_m is not null")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rows = rows.join(mine_is_one_way(long, b_twins), "source_id", "left")
    status = (
        F.when(F.col("one_way") | F.coalesce("own_one_way", F.lit(False)), "one_way")
        .when(F.col("own_m").isNull() | F.col("twin_m").isNull(), "one_sided")
        .when(F.coalesce("shared_m", F.lit(0.0)) <= SAME, "contradiction")
        .when(F.greatest("own_m", "twin_m") - F.col("shared_m") <= slack, "consistent")
        .otherwise("partial")
    )
    marked = scratch.table(rows.withColumn("status", status), "pairs")
    pairs = marked.where(F.col("source_id") < F.col("twin_id")).select("source_id", "twin_id", zero("own_m"), zero("twin_m"), zero("shared_m"), "status")
    lost = marked.where((F.col("status") == "one_sided") & F.col("own_m").isNull()).select("source_id")
    return pairs, back.join(lost, "source_id").select("source_id", "dest_id", "seq", "from_m", "to_m")


def mine_is_one_way(long: DataFrame, b_twins: DataFrame) -> DataFrame:
    """(source_id, own_one_way): whether a member of the source's own route has no twin."""
    m = long.select("source_id", "dest_id").join(b_twins.select(F.col("id").alias("dest_id"), "twin"), "dest_id", "left")
    return m.groupBy("source_id").agg(F.bool_or(F.col("twin").isNull()).alias("own_one_way"))
