"""Warping of polylines against the small directed graphs of edges near them (Mode 1), many sources in one numpy program.

The states of a source's graph are the places of its B-edges (point emission) or the arcs between them (segment emission). A
row of the table holds the least cost of every state for one step of A; within a row costs spread along the graph until none
falls, which is exact on cycles too. All sources of a batch are one graph without arcs between them, so a step of all is a
few array operations. Values of one source never depend on the others in its batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from roadweave.functions.dtw import bearing, turn

INF = float("inf")
START, STAY, BOTH, RIDE = 0, 1, 2, 3
STITCH = 0.5  # shorter arcs only connect
SAME = 1e-9
#: Decimals to which costs are compared.
PLACES = 9
#: Cells (steps x states) of tables that are filled at once; a source with more is filled alone.
CELLS = 4_000_000


# ------------------------------------------------------------------ ragged arrays


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def bounds_of(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of slices, of empty ones 0."""
    out = np.zeros(len(bounds) - 1)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][some])
    return out


def first_least(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the first least value of each slice; no slice is empty."""
    low = np.minimum.reduceat(values, bounds[:-1])
    hit = np.flatnonzero(values == np.repeat(low, np.diff(bounds)))
    return hit[np.searchsorted(hit, bounds[:-1])]


def running(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running sums within each slice, each by itself: lines of about one length are added side by side."""
    out, size = np.zeros(len(values)), np.diff(bounds)
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for k in np.unique(kind[size > 0]):
        lines = np.flatnonzero((kind == k) & (size > 0))
        at = ranges(bounds[lines], size[lines])
        row, column = np.repeat(np.arange(len(lines)), size[lines]), at - np.repeat(bounds[lines], size[lines])
        table = np.zeros((len(lines), 1 << int(k)))
        table[row, column] = values[at]
        out[at] = np.cumsum(table, axis=1)[row, column]
    return out


# ------------------------------------------------------------------ lines


@dataclass
class Lines:
    """Places of many lines: coordinates, whether each is a vertex, its arc length, and where each line begins."""

    xy: np.ndarray
    node: np.ndarray
    at: np.ndarray
    bounds: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return self.at[self.bounds[1:] - 1]


def _steps(xy: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distance of each place from the one before on its line, 0 for the first."""
    d = np.zeros(len(xy))
    d[1:] = np.hypot(*(xy[1:] - xy[:-1]).T)
    d[bounds[:-1][np.diff(bounds) > 0]] = 0.0
    return d


def enriched(xy: np.ndarray, bounds: np.ndarray, others: np.ndarray, which: tuple[np.ndarray, np.ndarray], step: float | None, least_gap: float = 0.0) -> Lines:
    """Lines with the feet of other points and with even fill; which: first and number of each line's points in `others`.

    A line has its vertices, the others' feet strictly inside it, and even fill wherever a gap exceeds `step`. Places closer
    than SAME are one, a vertex if any is. With `least_gap`, an added place stays where it is that far from the vertices on
    both sides and from the last place that stayed.
    """
    n = len(bounds) - 1
    at = running(_steps(xy, bounds), bounds)
    end = at[bounds[1:] - 1]
    # feet: every point of a line against each of its segments
    segments, points = np.diff(bounds) - 1, which[1]
    line = np.repeat(np.arange(n), points)
    point = ranges(which[0], points)
    size = segments[line]
    k = ranges(bounds[line], size)
    p, a, d = others[np.repeat(point, size)], xy[k], xy[k + 1] - xy[k]
    square = (d * d).sum(-1)
    t = np.clip(np.divide(((p - a) * d).sum(-1), square, out=np.zeros(len(k)), where=square > 0), 0.0, 1.0)
    if len(k):
        near = first_least(((a + t[:, None] * d - p) ** 2).sum(-1), bounds_of(size[size > 0]))
        foot = at[k[near]] + t[near] * (at[k[near] + 1] - at[k[near]])
        line = line[size > 0]
        inner = (foot > SAME) & (foot < end[line] - SAME)
        foot, line = foot[inner], line[inner]
    else:
        foot, line = np.empty(0), np.empty(0, np.int64)
    of = np.concatenate((np.repeat(np.arange(n), np.diff(bounds)), line))
    s = np.concatenate((at, foot))
    vertex = np.concatenate((np.arange(len(at)), np.full(len(foot), -1)))
    order = np.lexsort((s, of))
    of, s, vertex = of[order], s[order], vertex[order]
    if step:
        gap = np.zeros(len(s))
        gap[:-1] = np.where(of[1:] == of[:-1], s[1:] - s[:-1], 0.0)
        pieces = np.maximum(np.ceil(gap / step), 1).astype(np.int64)
        if (pieces > 1).any():
            before = np.repeat(np.arange(len(s)), pieces - 1)
            share = (ranges(np.ones(len(s), np.int64), pieces - 1)) / pieces[before]
            of, s, vertex = np.concatenate((of, of[before])), np.concatenate((s, s[before] + gap[before] * share)), np.concatenate((vertex, np.full(len(before), -1)))
            order = np.lexsort((s, of))
            of, s, vertex = of[order], s[order], vertex[order]
    # equal places are runs
    new = np.append(True, (of[1:] != of[:-1]) | (s[1:] - s[:-1] > SAME))
    run = np.flatnonzero(new)
    node = np.maximum.reduceat(vertex, run) >= 0
    last = np.maximum.accumulate(vertex)[np.append(run[1:], len(s)) - 1]  # the vertex at or before each run
    of, s = of[run], s[run]
    if least_gap > 0:
        nth, where = np.cumsum(node), s[node]
        back, ahead = s - where[nth - 1], where[np.minimum(nth, len(where) - 1)] - s
        wide = np.flatnonzero(~node & (back >= least_gap) & (ahead >= least_gap))
        keep = node.copy()
        place = of[wide] * (2.0 * end.max(initial=0.0) + 4.0 * least_gap) + s[wide]  # in order over all lines, lines being far apart
        then, j = np.searchsorted(place, place + least_gap), 0
        while j < len(wide):
            keep[wide[j]] = True
            j = int(then[j])
        of, s, node, last = of[keep], s[keep], node[keep], last[keep]
    follows = np.minimum(last + 1, bounds[1:][of] - 1)
    span = at[follows] - at[last]
    share = np.divide(s - at[last], span, out=np.zeros(len(s)), where=span > 0)
    return Lines(xy[last] + share[:, None] * (xy[follows] - xy[last]), node, s, bounds_of(np.bincount(of, minlength=n)))


# ------------------------------------------------------------------ graphs


@dataclass
class Problem:
    """Sources with the graphs of the edges near them.

    Edges, states and arcs of a source lie together. A state is a place of an edge, an arc goes from a place to one that may
    follow it: the next of its edge, or the start of another edge within `snap` of its end that isn't its twin.
    """

    a: Lines
    edges: np.ndarray  # bounds of each source's edges
    b: Lines  # places of the edges
    owner: np.ndarray  # the edge of each place
    length: np.ndarray  # of each edge
    arcs: np.ndarray  # (arc, 2)
    arc_bounds: np.ndarray

    @property
    def places(self) -> np.ndarray:
        return self.b.bounds[self.edges]


def problem(xy_a: np.ndarray, bounds_a: np.ndarray, xy_b: np.ndarray, bounds_b: np.ndarray, edges: np.ndarray, snap: float, step: float | None, least_gap: float, twins: np.ndarray | None = None) -> Problem:
    """edges: bounds of each source's edges among the lines of b; twins: an edge's opposite among the same lines, or -1.

    Every source has at least one edge, and every line at least one vertex.
    """
    per = np.diff(edges)
    source = np.repeat(np.arange(len(per)), per)
    b = enriched(xy_b, bounds_b, xy_a, (bounds_a[source], np.diff(bounds_a)[source]), step, least_gap)
    vertices = bounds_b[edges]
    a = enriched(xy_a, bounds_a, xy_b, (vertices[:-1], np.diff(vertices)), step, least_gap)
    starts, ends = b.bounds[:-1], b.bounds[1:] - 1
    size = np.diff(b.bounds) - 1
    tail = ranges(starts, size)
    inner = np.stack((tail, tail + 1), axis=1)
    u = np.repeat(np.arange(len(starts)), per[source])
    w = ranges(edges[source], per[source])
    other = u != w
    if twins is not None:
        other &= twins[u] != w
    u, w = u[other], w[other]
    meet = ((b.xy[ends[u]] - b.xy[starts[w]]) ** 2).sum(-1) <= snap * snap
    arcs = np.concatenate((inner, np.stack((ends[u[meet]], starts[w[meet]]), axis=1)))
    of = np.concatenate((np.repeat(source, size), source[u[meet]]))
    order = np.lexsort((arcs[:, 1], arcs[:, 0], of))
    lengths = running(_steps(xy_b, bounds_b), bounds_b)[bounds_b[1:] - 1]
    return Problem(a, edges, b, np.repeat(np.arange(len(starts)), np.diff(b.bounds)), lengths, arcs[order], bounds_of(np.bincount(of, minlength=len(per))))


@dataclass
class Ways:
    """Ways through the tables of sources: the source of each, its cost, and its steps (row of A, state, move)."""

    source: np.ndarray
    entry: np.ndarray
    cost: np.ndarray
    bounds: np.ndarray
    row: np.ndarray
    state: np.ndarray
    move: np.ndarray


@dataclass
class Emission:
    """What a step costs: the distance of places, or of the middles of segments and their turn."""

    by_segment: bool = False
    weight: float = 0.0
    alpha: float = 1.0
    beta: float = 1.0


def _states(q: Problem, e: Emission) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the states of all sources: bounds, edge, host, middle or place, heading, and the moves between them."""
    if not e.by_segment:
        return q.places, q.owner, np.ones(len(q.owner), bool), q.b.xy, np.zeros(0), q.arcs
    u, v = q.b.xy[q.arcs[:, 0]], q.b.xy[q.arcs[:, 1]]
    first = np.searchsorted(q.arcs[:, 0], q.arcs[:, 1])  # places of a source lie together, so arcs are in order of their tails
    size = np.searchsorted(q.arcs[:, 0], q.arcs[:, 1], "right") - first
    moves = np.stack((np.repeat(np.arange(len(q.arcs)), size), ranges(first, size)), axis=1)
    return q.arc_bounds, q.owner[q.arcs[:, 0]], np.hypot(*(v - u).T) >= STITCH, (u + v) / 2, bearing(u, v), moves


def ways(q: Problem, e: Emission, each_entry: bool = False, tables: list | None = None) -> Ways:
    """The cheapest way of each source; with `each_entry`, of each edge to begin on and each edge to end on.

    `tables` gets what was filled: (sources, costs, moves).
    """
    bounds, owner, host, centre, heading, moves = _states(q, e)
    rows = np.diff(q.a.bounds) - e.by_segment
    n_states = np.diff(bounds)
    per = np.diff(q.edges) if each_entry else np.ones(len(rows), np.int64)
    source = np.repeat(np.arange(len(rows)), per)
    entry = ranges(q.edges[:-1], per) if each_entry else np.full(len(source), -1)
    fits = (rows[source] > 0) & (n_states[source] > 0)
    source, entry = source[fits], entry[fits]
    order = np.argsort(-rows[source], kind="stable")  # so that the sources that still have rows are the first ones
    source, entry = source[order], entry[order]
    move_bounds = np.searchsorted(moves[:, 0], bounds)
    out = []
    at = 0
    while at < len(source):
        cells = np.cumsum(n_states[source[at:]]) * rows[source[at]]
        end = at + max(1, int(np.searchsorted(cells, CELLS, "right")))
        out.append(_filled(q, e, source[at:end], entry[at:end], rows, bounds, owner, host, centre, heading, moves, move_bounds, each_entry, tables))
        at = end
    if not out:
        none = np.zeros(0, np.int64)
        return Ways(none, none, np.zeros(0), np.zeros(1, np.int64), none, none, none)
    whole = Ways(*(np.concatenate([getattr(w, c) for w in out]) for c in ("source", "entry", "cost")), np.zeros(1, np.int64), *(np.concatenate([getattr(w, c) for w in out]) for c in ("row", "state", "move")))
    size = np.concatenate([np.diff(w.bounds) for w in out])
    begin = np.cumsum(size) - size
    order = np.lexsort((np.round(whole.cost, PLACES), whole.source))
    pick = ranges(begin[order], size[order])
    return Ways(whole.source[order], whole.entry[order], whole.cost[order], bounds_of(size[order]), whole.row[pick], whole.state[pick], whole.move[pick])


def _filled(q: Problem, e: Emission, source, entry, rows, bounds, owner, host, centre, heading, moves, move_bounds, each_entry, tables) -> Ways:
    """Tables of sources in order of falling rows, and their cheapest ways."""
    size, count = np.diff(bounds)[source], rows[source]
    state = ranges(bounds[source], size)  # of each column
    mine = bounds_of(size)
    shift = np.repeat(mine[:-1] - bounds[source], np.diff(move_bounds)[source])
    k = ranges(move_bounds[source], np.diff(move_bounds)[source])
    src, dst = moves[k, 0] + shift, moves[k, 1] + shift
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    into = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.empty(0, np.int64)
    heads = dst[into]
    first_row = np.repeat(q.a.bounds[source], size)
    xy, hosts, towards = centre[state], host[state], heading[state] if e.by_segment else None
    n, m = int(count[0]), len(state)
    active = mine[np.searchsorted(-count, -np.arange(n), "left")]  # columns of the sources with more rows than i
    cost, move, back = np.full((n, m), INF), np.zeros((n, m), np.int8), np.full((n, m), -1, np.int32)

    def emission(i: int, c: int) -> np.ndarray:
        p = q.a.xy[first_row[:c] + i]
        if not e.by_segment:
            return np.hypot(p[:, 0] - xy[:c, 0], p[:, 1] - xy[:c, 1])
        to = q.a.xy[first_row[:c] + i + 1]
        mid = (p + to) / 2
        d = np.hypot(mid[:, 0] - xy[:c, 0], mid[:, 1] - xy[:c, 1])
        if e.weight > 0:
            d = d + e.weight * turn(bearing(p, to), towards[:c])
        return np.where(hosts[:c], d, 0.0)

    def cheapest(values: np.ndarray, arcs: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
        c = values[src[:arcs]]
        near = first_least(c, np.append(into[:groups], arcs))
        return c[near], src[near]

    for i in range(n):
        c = int(active[i])
        arcs = int(np.searchsorted(dst, c))
        groups = int(np.searchsorted(into, arcs))
        here, cell, h = emission(i, c), cost[i], heads[:groups]
        if i == 0:
            open_ = hosts[:c]
            if each_entry:
                open_ = open_ & (owner[state[:c]] == np.repeat(entry, size)[:c])
            cell[:c] = np.where(open_, here, INF)
        else:
            cell[:c] = np.where(hosts[:c], e.beta * here + cost[i - 1, :c], INF)
            move[i, :c], back[i, :c] = STAY, np.arange(c)
            if groups:
                low, best = cheapest(cost[i - 1], arcs, groups)
                new = here[h] + low
                less = (new < cell[h]) & hosts[h]
                cell[h[less]], move[i, h[less]], back[i, h[less]] = new[less], BOTH, best[less]
        while groups:
            low, best = cheapest(cell, arcs, groups)
            new = low + e.alpha * here[h]
            less = new < cell[h]
            if not less.any():
                break
            cell[h[less]], move[i, h[less]], back[i, h[less]] = new[less], RIDE, best[less]
    if tables is not None:
        tables.append((source, cost, move))
    # ways back, all at once
    final = cost[np.repeat(count, size) - 1, np.arange(m)]
    cuts = np.flatnonzero(np.append(True, owner[state][1:] != owner[state][:-1])) if each_entry else mine[:-1]
    if each_entry:
        cuts = np.union1d(cuts, mine[:-1])  # an edge's states lie together
    k = first_least(np.round(final, PLACES), np.append(cuts, m))  # the first of equals in the order of edges
    whose = np.searchsorted(mine, k, "right") - 1
    fine = np.isfinite(final[k])
    k, whose = k[fine], whose[fine]
    total, i = final[k], count[whose] - 1
    way, steps = np.arange(len(k)), []
    while len(k):
        kind = move[i, k]
        steps.append((way, i, state[k], kind))
        on = kind != START
        way, i, k, kind = way[on], i[on], k[on], kind[on]
        k, i = back[i, k].astype(np.int64), i - ((kind == STAY) | (kind == BOTH))
    way, i, s, kind = (np.concatenate([x[c] for x in steps]) if steps else np.zeros(0, np.int64) for c in range(4))
    order = np.lexsort((-np.arange(len(way)), way))
    return Ways(source[whose], entry[whose], total, bounds_of(np.bincount(way, minlength=len(whose))), i[order], s[order], kind[order])


# ------------------------------------------------------------------ routes


def _first(there: np.ndarray, of: np.ndarray, n: int, otherwise: np.ndarray) -> np.ndarray:
    """Index of the first (in order) of the marked rows of each owner, or otherwise."""
    out, k = otherwise.copy(), np.flatnonzero(there)[::-1]
    out[of[k]] = k
    return out


def _ends(short: np.ndarray, lo: np.ndarray, hi: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last group of each way that isn't short; where all are, the last one."""
    k = np.arange(len(short))
    long = ~short & (k >= lo[way]) & (k <= hi[way])
    first = _first(long, way, len(lo), hi)
    last = first.copy()
    k = np.flatnonzero(long)
    last[way[k]] = k
    return first, last


#: What a route's members and a route have, after their ids.
MEMBER = ("seq", "direction", "edge_match_dist_avg", "edge_match_dist_max", "edge_match_dist_min", "edge_a_len", "edge_cover_pct", "edge_matched_len", "edge_b_len", "edge_b_used_pct", "edge_bearing_diff", "n_points", "edge_b_from_m", "edge_b_to_m")
WHOLE = ("dtw_distance", "max_dtw_distance", "min_dtw_distance", "bearing_diff", "part_drift", "part_bearing_diff", "overlap_pct", "matched_len", "route_geom_wkt", "dp_cost", "a_len")


def describe(q: Problem, e: Emission, w: Ways, trim: float = 0.0, stub_pct: float = 0.0, stub_m: float = 0.0) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(ways that are routes, bounds of their members, members, routes): members have `edge` and MEMBER, routes WHOLE.

    Members at either end that are only touched go; so do those beside less than `trim` of A, and stubs: used for less than
    stub_pct of their length and less than stub_m. A way that never walks along B is no route.
    """
    n = len(w.source)
    # the steps as pairs of places
    if e.by_segment:
        size = np.diff(w.bounds) + 1
        bounds = bounds_of(size)
        is_first = np.zeros(bounds[-1], bool)
        is_first[bounds[:-1]] = True
        row, place = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
        row[~is_first], place[~is_first] = w.row + 1, q.arcs[w.state, 1] if len(w.state) else 0
        row[is_first], place[is_first] = w.row[w.bounds[:-1]], q.arcs[w.state[w.bounds[:-1]], 0] if n else 0
    else:
        bounds, row, place = w.bounds, w.row, w.state
    way = np.repeat(np.arange(n), np.diff(bounds))
    pa, pb, owner = q.a.xy[q.a.bounds[w.source][way] + row], q.b.xy[place], q.owner[place]
    step_a, step_b, drift = _steps(pa, bounds), _steps(pb, bounds), np.hypot(*(pa - pb).T)
    cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (way[1:] != way[:-1]))) if len(way) else np.empty(0, np.int64)
    groups = np.append(cut, len(way))
    of = way[cut]
    walked, over = summed(step_b, groups), summed(step_a, groups)
    length = q.length[owner[cut]]
    lo, hi = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), "right") - 1
    used = np.divide(100.0 * walked, length, out=np.zeros(len(cut)), where=length > 0)
    for short in (walked <= SAME, over < trim if trim else None, (used < stub_pct) & (walked < stub_m) if stub_m else None):
        if short is not None and n:
            lo, hi = _ends(short, lo, hi, of)
    begin, end = groups[lo], groups[hi + 1]
    in_route = (np.arange(len(way)) >= begin[way]) & (np.arange(len(way)) < end[way])
    routes = np.flatnonzero(np.bincount(way, np.where(in_route, step_b, 0.0), n) > SAME)
    is_route = np.zeros(n, bool)
    is_route[routes] = True
    total = q.a.length[w.source]
    # members
    g = np.flatnonzero((np.arange(len(cut)) >= lo[of]) & (np.arange(len(cut)) <= hi[of]) & is_route[of])
    b0, e0, gw = groups[g], groups[g + 1], of[g]
    entry, last = place[begin[way]] if n else place, place[end[way] - 1] if n else place
    covered = np.zeros(len(way), bool)
    covered[1:] = (place[1:] != entry[1:]) & (place[:-1] != last[1:]) & (way[1:] == way[:-1])
    a_len = summed(np.where(covered, step_a, 0.0), groups)[g]
    # matched segments: (distance, turn, length of A, unit) of each step of the route but its first place
    if e.by_segment:
        at = np.flatnonzero(~is_first)
        host = np.hypot(*(q.b.xy[q.arcs[w.state, 1]] - q.b.xy[q.arcs[w.state, 0]]).T) >= STITCH if len(w.state) else np.zeros(0, bool)
        fits = host & in_route[at] & is_route[way[at]]
        at, arc, i = at[fits], w.state[fits], w.row[fits]
        p, to, u, v = q.a.xy[q.a.bounds[w.source][way[at]] + i], q.a.xy[q.a.bounds[w.source][way[at]] + i + 1], q.b.xy[q.arcs[arc, 0]], q.b.xy[q.arcs[arc, 1]]
        r_way, r_dist, r_turn, r_len, r_unit = way[at], np.hypot(*((p + to) / 2 - (u + v) / 2).T), turn(bearing(p, to), bearing(u, v)), np.hypot(*(to - p).T), arc
        key = way[at] * np.int64(len(q.length) + 1) + q.owner[q.arcs[arc, 0]]
    else:
        at = np.flatnonzero(in_route & is_route[way] & (np.arange(len(way)) != begin[way])) if n else np.empty(0, np.int64)
        r_way, r_dist, r_turn, r_len, r_unit, key = way[at], drift[at], np.zeros(len(at)), step_a[at], place[at], np.empty(0, np.int64)
    mean = summed(drift, groups)[g] / np.maximum(e0 - b0, 1)
    top, bottom = (f.reduceat(drift, cut)[g] if len(cut) else np.zeros(0) for f in (np.maximum, np.minimum))
    if e.by_segment and len(at):
        keys, inverse = np.unique(key, return_inverse=True)
        own = gw * np.int64(len(q.length) + 1) + owner[b0]
        found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        has = keys[found] == own
        hi_d, lo_d = np.full(len(keys), -INF), np.full(len(keys), INF)
        np.maximum.at(hi_d, inverse, r_dist)
        np.minimum.at(lo_d, inverse, r_dist)
        mean, top, bottom = (np.where(has, x[found], y) for x, y in ((np.bincount(inverse, r_dist) / np.bincount(inverse), mean), (hi_d, top), (lo_d, bottom)))
    several = e0 - b0 > 1
    members = {
        "edge": owner[b0], "seq": g - lo[gw], "edge_match_dist_avg": mean, "edge_match_dist_max": top, "edge_match_dist_min": bottom, "edge_a_len": a_len,
        "edge_cover_pct": np.round(np.divide(100.0 * a_len, total[gw], out=np.zeros(len(g)), where=total[gw] > 0), 1), "edge_matched_len": walked[g], "edge_b_len": length[g],
        "edge_b_used_pct": np.round(np.minimum(100.0, used[g]), 1), "edge_bearing_diff": np.where(several, turn(bearing(pa[b0], pa[e0 - 1]), bearing(pb[b0], pb[e0 - 1])), 0.0),
        "n_points": e0 - b0, "edge_b_from_m": q.b.at[place[b0]], "edge_b_to_m": q.b.at[place[e0 - 1]],
    }
    # routes
    x = len(routes)
    whose = np.full(n, -1)
    whose[routes] = np.arange(x)
    inside = in_route & is_route[way]
    by_place = np.bincount(whose[way[inside]], drift[inside], x) / np.maximum(end[routes] - begin[routes], 1)
    record = np.searchsorted(r_way, routes), np.searchsorted(r_way, routes, "right")
    count = record[1] - record[0]
    heading = turn(bearing(pa[begin[routes]], pa[end[routes] - 1]), bearing(pb[begin[routes]], pb[end[routes] - 1]))
    average, high, low = by_place, np.full(x, -INF), np.full(x, INF)
    if e.by_segment:
        np.maximum.at(high, whose[r_way], r_dist)
        np.minimum.at(low, whose[r_way], r_dist)
        average = np.where(count > 0, np.bincount(whose[r_way], r_dist, x) / np.maximum(count, 1), by_place)
        heading = np.where(count > 0, np.bincount(whose[r_way], r_turn, x) / np.maximum(count, 1), heading)
    plain = count == 0 if e.by_segment else np.ones(x, bool)
    place_high, place_low = np.full(x, -INF), np.full(x, INF)
    np.maximum.at(place_high, whose[way[inside]], drift[inside])
    np.minimum.at(place_low, whose[way[inside]], drift[inside])
    high, low = np.where(plain, place_high, high), np.where(plain, place_low, low)
    # the part within: without the leading run on the first unit and the trailing run on the last, but for one of each
    from_, to_ = record[0].copy(), record[1].copy()
    some = np.flatnonzero(count > 0)
    ends_differ = np.zeros(x, bool)
    ends_differ[some] = r_unit[record[0][some]] != r_unit[record[1][some] - 1]
    if len(r_way):
        r = whose[r_way]
        head, tail = r_unit[np.minimum(record[0], len(r_unit) - 1)][r], r_unit[np.maximum(record[1] - 1, 0)][r]
        lead = _first(r_unit != head, r, x, record[1])
        trail = record[0] - 1
        k = np.flatnonzero(r_unit != tail)
        trail[r[k]] = k
        from_, to_ = np.where(ends_differ, lead - 1, from_), np.where(ends_differ, trail + 2, to_)
        k = np.arange(len(r_way))
        part = (k >= from_[r]) & (k < to_[r])
        n_part = np.maximum(to_ - from_, 1)
        share = np.bincount(r[part], r_len[part], x)
        part_drift, part_turn = np.bincount(r[part], r_dist[part], x) / n_part, np.bincount(r[part], r_turn[part], x) / n_part
    else:
        share, part_drift, part_turn = np.zeros(x), average, heading
    whole = ~ends_differ
    size = total[routes]
    wkt = []
    for p in routes.tolist():
        line = pb[begin[p] : end[p]]
        line = line[np.append(True, (line[1:] != line[:-1]).any(1))]
        wkt.append("LINESTRING (" + ", ".join([f"{a} {b}" for a, b in line.tolist()]) + ")")
    member_bounds = bounds_of(np.bincount(whose[gw], minlength=x))
    return routes, member_bounds, members, {
        "dtw_distance": average, "max_dtw_distance": high, "min_dtw_distance": low, "bearing_diff": heading, "part_drift": np.where(whole, average, part_drift),
        "part_bearing_diff": heading if not e.by_segment else np.where(whole, heading, part_turn), "overlap_pct": np.minimum(100, np.round(np.divide(100.0 * share, size, out=np.zeros(x), where=size > 0))).astype(np.int64),
        "matched_len": summed(walked[g], member_bounds), "route_geom_wkt": wkt, "dp_cost": w.cost[routes], "a_len": size,
    }


# ------------------------------------------------------------------ one source


def one_problem(a, edges: list[tuple], snap: float = 0.75, step: float | None = 10.0, least_gap: float = 0.0, twins: dict | None = None) -> tuple[list, Problem] | None:
    """(ids in their order, the problem) of one source, None where A has no line or no edge has one."""
    a = np.asarray(a, float)
    edges = sorted(((i, np.asarray(p, float)) for i, p in edges if len(p) > 1), key=lambda x: str(x[0]))  # ties fall the same way each time
    if len(a) < 2 or not edges:
        return None
    ids = [i for i, _ in edges]
    place = {i: k for k, i in enumerate(ids)}
    opposite = np.array([place.get((twins or {}).get(i), -1) for i in ids])
    size = np.array([len(p) for _, p in edges])
    return ids, problem(a, np.array([0, len(a)]), np.concatenate([p for _, p in edges]), bounds_of(size), np.array([0, len(ids)]), snap, step, least_gap, opposite)


def emission_of(emission: str, bearing_weight: float = 0.0, alpha: float = 1.0, beta: float = 1.0) -> Emission:
    if emission not in ("point", "segment", "midpoint"):
        raise ValueError(f"unknown emission {emission!r}")
    return Emission(emission != "point", bearing_weight, alpha, beta)


def gap_of(least_gap: float | None, step: float | None, e: Emission) -> float:
    return (step or 0.0) / 2 * e.by_segment if least_gap is None else least_gap


def match_route(a, edges: list[tuple], snap: float = 0.75, step: float | None = 10.0, emission: str = "point", bearing_weight: float = 0.0, alpha: float = 1.0, beta: float = 1.0, trim: float = 0.0, least_gap: float | None = None, debug: bool = False, twins: dict | None = None, stub_pct: float = 0.0, stub_m: float = 0.0) -> dict | None:
    """The best connected route of B-edges for one A-edge: its edges with metrics, and metrics of the whole; None if there is none.

    With `debug` the table of costs, the moves and the way are in it too, and where there is no route the reason.
    """
    e = emission_of(emission, bearing_weight, alpha, beta)
    got = one_problem(a, edges, snap, step, gap_of(least_gap, step, e), twins)
    tables: list = []
    w = ways(got[1], e, tables=tables) if got else None
    if w is None or not len(w.source):
        return {"edges": [], "reason": "A or the edges near it have no length, or no way reaches A's end"} if debug else None
    ids, q = got
    routes, bounds, members, whole = describe(q, e, w, trim, stub_pct, stub_m)
    out = _as_dict(0, ids, bounds, members, whole) if len(routes) else None
    if debug:
        _, cost, move = tables[0]
        out = (out or {"edges": [], "reason": "B is touched, never walked"}) | {"debug": {"final_cost": float(w.cost[0]), "D": cost, "move": move, "path": list(zip(w.row.tolist(), w.state.tolist(), w.move.tolist(), strict=True)), "places": q.a.xy, "graph": q}}
    return out


def _as_dict(k: int, ids: list, bounds: np.ndarray, members: dict, whole: dict) -> dict:
    rows = range(bounds[k], bounds[k + 1])
    plain = lambda v: v.item() if hasattr(v, "item") else v
    edges = [{"dest_id": ids[members["edge"][j]], "direction": "forward", **{c: plain(members[c][j]) for c in MEMBER if c != "direction"}} for j in rows]
    return {"edges": edges, **{c: plain(whole[c][k]) for c in WHOLE}, "cost": plain(whole["dp_cost"][k])}
