"""Mode 3 for many components at once: networks, candidates and both engines of dag.py as arrays over components.

Components whose sources have one shape are solved together, as their factors and profiles then have the same names: each
table has one more axis, and every sum and every choice among equals is taken as dag.py and profile.py take it, so the
matchings are the same ones. What doesn't fit (shapes that few share, large tables, more profiles than a beam holds, no
matching at the radius) is left to them: `solve` says which components it has not solved.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from roadweave.functions import dag, profile

INF = float("inf")
#: Components of one shape from which on they are solved together, and at most so many at once.
FEW, MANY = 3, 1024
#: Cells of a vertex at most; rows of an elimination's table from which on dag.py takes equals in another order.
CELLS, ROWS = 24, 200


@dataclass
class Nets:
    """Segment networks of many components (see dag.segment_net), one after another.

    first: where each component's segments begin; edge: place among the edges of the line whose number it bears.
    """

    first: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    xy: np.ndarray
    bearing: np.ndarray
    length: np.ndarray
    edge: np.ndarray
    seq: np.ndarray
    road: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of consecutive groups."""
    return np.arange(int(counts.sum())) - np.repeat(starts(counts)[:-1], counts)


def _stations(points: np.ndarray, counts: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """dag.stations of many lines, and how many each has."""
    begin, n_out = starts(counts)[:-1], np.zeros(len(counts), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for m in np.unique(counts[counts > 0]):
        lines = np.flatnonzero(counts == m)
        p = points[begin[lines, None] + np.arange(m)]
        d = p[:, 1:] - p[:, :-1]
        at = np.concatenate((np.zeros((len(p), 1)), np.cumsum(np.hypot(d[..., 0], d[..., 1]), axis=1)), axis=1)
        cuts = np.maximum(2, np.rint(at[:, -1] / step).astype(np.int64) + 1)
        for n in np.unique(cuts):
            mine = np.flatnonzero(cuts == n)
            a, q = at[mine], p[mine]
            even = np.arange(n) * (a[:, -1:] / (n - 1))
            even[:, -1] = a[:, -1]
            s = np.sort(np.concatenate((a, even), axis=1), axis=1)
            keep = np.concatenate((np.ones((len(s), 1), bool), np.diff(s, axis=1) > max(step * 1e-3, 1e-9)), axis=1)
            row, col = np.nonzero(keep)
            x = s[row, col]
            j = (a[row] <= x[:, None]).sum(1) - 1
            on = (j == m - 1) | (a[row, j] == x)
            k = np.minimum(j + 1, m - 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                slope = (q[row, k] - q[row, j]) / (a[row, k] - a[row, j])[:, None]
                xy = slope * (x - a[row, j])[:, None] + q[row, j]
            xy[on] = q[row, j][on]
            n_out[lines[mine]] = keep.sum(1)
            found.append((np.repeat(lines[mine], keep.sum(1)), col, xy))
    if not found:
        return np.zeros((0, 2)), n_out
    line, col, xy = (np.concatenate(v) for v in zip(*found, strict=True))
    return xy[np.lexsort((col, line))], n_out


def nets(edges: np.ndarray, names: np.ndarray, counts: np.ndarray, points: np.ndarray, step: float, decimals: int) -> Nets:
    """dag.segment_net of many components: numbers of edges, equal names of edges as equal numbers, numbers of points, points."""
    n = len(edges)
    xy, n_stations = _stations(points, counts, step)
    line = np.repeat(np.arange(len(counts)), n_stations)
    owner = np.repeat(np.arange(n), edges)[line]
    near = np.round(xy, decimals) + 0.0
    order = np.lexsort((near[:, 1], near[:, 0], owner))
    same = (owner[order][1:] == owner[order][:-1]) & (near[order][1:] == near[order][:-1]).all(1) if len(order) > 1 else np.zeros(0, bool)
    group = np.concatenate((np.zeros(min(1, len(order)), np.int64), np.cumsum(~same)))
    node = np.empty(len(order), np.int64)
    node[order] = group
    place = xy[order][np.concatenate((np.ones(min(1, len(order)), bool), ~same))]
    k = np.flatnonzero((line[1:] == line[:-1]) & (node[1:] != node[:-1]))
    u, v, edge = node[k], node[k + 1], line[k]
    _, road = np.unique(owner[k] * (int(names.max(initial=0)) + 1) + names[edge], return_inverse=True)
    seq = np.empty(len(k), np.int64)
    by = np.argsort(road, kind="stable")
    seq[by] = within(np.bincount(road)) if len(k) else seq
    _, first, which = np.unique(u * (len(place) + 1) + v, return_index=True, return_inverse=True)
    last = np.zeros(len(first), np.int64)
    np.maximum.at(last, which.ravel(), np.arange(len(k)))
    kept = np.argsort(first)
    first, last = first[kept], last[kept]
    u, v, mine = u[first], v[first], owner[k][first]
    a, b = place[u].reshape(-1, 2), place[v].reshape(-1, 2)
    d = b - a
    return Nets(starts(np.bincount(mine, minlength=n)), u, v, (a + b) / 2, (np.degrees(np.arctan2(d[:, 0], d[:, 1])) + 360.0) % 360.0, np.hypot(d[:, 0], d[:, 1]), edge[last], seq[last], road[last])


def spans(g: Nets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each segment begins and ends along its edge, and that edge's length."""
    order = np.lexsort((g.seq, g.road))
    kinds, counts = np.unique(g.road, return_counts=True)
    begin, size = starts(counts)[:-1], np.zeros(len(kinds))
    low, high = np.zeros(len(g.seq)), np.zeros(len(g.seq))
    for p in range(int(counts.max(initial=0))):
        r = np.flatnonzero(counts > p)
        k = order[begin[r] + p]
        low[k] = size[r]
        size[r] += g.length[k]
        high[k] = size[r]
    return low, high, size[np.searchsorted(kinds, g.road)]


@dataclass
class Candidates:
    """Cells of each source segment in the order of dag.candidates: counts, and cells and costs one after another."""

    counts: np.ndarray
    cells: np.ndarray
    cost: np.ndarray
    farthest: np.ndarray


def candidates(a: Nets, b: Nets, radius: float, weight: float, least: int, look: bool = False) -> Candidates:
    """dag.candidates of many components, and dag.farthest if `look`."""
    owner, n_b = a.owner, np.diff(b.first)
    each = n_b[owner]
    i = np.repeat(np.arange(len(owner)), each)
    j = np.repeat(b.first[owner], each) + within(each)
    d = b.xy[j] - a.xy[i]
    d = np.hypot(d[:, 0], d[:, 1])
    near = d <= radius
    n_near = np.bincount(i[near], minlength=len(owner))
    few, rank, far = (n_near < least)[i], np.zeros(len(i), np.int64), np.zeros(len(n_b))
    asked = np.arange(len(i)) if look else np.flatnonzero(few)
    asked = asked[np.lexsort((j[asked], d[asked], i[asked]))]
    rank[asked] = within(np.bincount(i[asked], minlength=len(owner)))
    if look:
        at = rank == least - 1
        np.maximum.at(far, owner[i[at]], d[at])
        far[n_b < least] = INF
    keep = np.flatnonzero(np.where(few, rank < least, near))
    if least > 1:
        keep = keep[np.lexsort((np.where(few, rank, j)[keep], i[keep]))]
    i, j, e = i[keep], j[keep], d[keep]
    if weight:
        turn = np.abs(a.bearing[i] - b.bearing[j]) % 360.0
        e = e + weight * np.minimum(turn, 360.0 - turn)
    return Candidates(np.bincount(i, minlength=len(owner)), j, e, far)


@dataclass
class Alike:
    """Components of one shape: for each source segment its cells (-1 where there are fewer) and their costs."""

    before: list[list[int]]
    after: list[list[int]]
    cells: list[np.ndarray]
    cost: list[np.ndarray]
    run: list[np.ndarray]
    b: Nets
    alpha: float
    beta: float

    def ahead(self, u: int, v: int) -> np.ndarray:
        """Which cells of v follow which cells of u, for each component."""
        x, y = self.cells[u][:, :, None], self.cells[v][:, None, :]
        return (x >= 0) & (y >= 0) & (self.b.head[x] == self.b.tail[y])

    def same(self, u: int, v: int) -> np.ndarray:
        x, y = self.cells[u][:, :, None], self.cells[v][:, None, :]
        return (x >= 0) & (x == y)


def _runs(s: Alike, v: int) -> np.ndarray:
    """Cheapest further cover from each entry to each exit (see dag.runs_from)."""
    more = np.where(s.ahead(v, v), (s.alpha * np.where(s.cells[v] >= 0, s.cost[v], 0.0))[:, None, :], INF)
    n, k = s.cells[v].shape
    best = np.full((n, k, k), INF)
    best[:, np.arange(k), np.arange(k)] = np.where(s.cells[v] >= 0, 0.0, INF)
    for _ in range(k):
        was = best.copy()
        for m in range(k):
            np.minimum(best, best[:, :, m, None] + more[:, m, None, :], out=best)
        if (best == was).all():
            break
    return best


def _way(s: Alike, v: int, entry: np.ndarray, leave: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells (their places) of the cheapest run from an entry to an exit, from its end on, -1 before its begin; and where it is clear."""
    n, k = s.cells[v].shape
    one = np.arange(n)
    more = s.alpha * s.cost[v]
    ahead, best = s.ahead(v, v), s.run[v][one, entry]
    clear = np.ones(n, bool)
    at, way = leave.copy(), [leave.copy()]
    for _ in range(k):
        go = (at != entry) & (at >= 0) & clear
        if not go.any():
            return way, clear
        r = one[go]
        w = at[r]
        from_ = ahead[r, :, w] & (best[r] + more[r, w][:, None] == best[r, w][:, None])
        low = np.where(from_, best[r], INF)
        from_ &= low == low.min(1)[:, None]
        m = np.where(from_, s.cells[v][r], np.iinfo(np.int64).max).argmin(1)
        clear[r[~from_.any(1) | ((best[r, m] == best[r, w]) & (m != entry[r]))]] = False
        at = np.full(n, -1)
        at[r] = m
        way.append(at.copy())
    clear &= (at < 0) | (at == entry)
    return way, clear


def _eliminated(s: Alike, most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cost, infinite where there is no matching; entry and exit of each segment; which components are solved) by dag.eliminate, of forests."""
    n, count = len(s.cells[0]), len(s.before)
    factors: list[tuple[tuple[int, ...], np.ndarray]] = []
    for v in range(count):
        k = s.cells[v].shape[1]
        inner = np.full((n, k, 2, k), INF)
        for stalls in (0, 1) if s.before[v] else (0,):
            inner[:, :, stalls] = ((s.beta if stalls else 1.0) * s.cost[v])[:, :, None] + s.run[v]
        factors.append(((2 * v, 2 * v + 1), inner.reshape(n, 2 * k, k)))
        for u in s.before[v]:
            ahead = s.ahead(u, v).swapaxes(1, 2)
            link = np.stack((ahead, ahead | s.same(u, v).swapaxes(1, 2)), axis=2).reshape(n, 2 * k, -1)
            factors.append(((2 * v, 2 * u + 1), np.where(link, 0.0, INF)))
    size = {2 * v: 2 * s.cells[v].shape[1] for v in range(count)} | {2 * v + 1: s.cells[v].shape[1] for v in range(count)}
    live = dict(enumerate(factors))
    of: dict[int, set[int]] = defaultdict(set)
    for k, (names, _) in live.items():
        for x in names:
            of[x].add(k)
    solved, total, steps, fresh = np.ones(n, bool), np.zeros(n), [], len(factors)
    width = lambda x: len({m for k in of[x] for m in live[k][0]})
    heap = [(width(x), x) for x in of]
    heapq.heapify(heap)
    done: set[int] = set()
    while heap:
        w, x = heapq.heappop(heap)
        if x in done:
            continue
        if w != (now := width(x)):
            heapq.heappush(heap, (now, x))
            continue
        done.add(x)
        mine = list(of[x])
        names = tuple(dict.fromkeys(m for k in mine for m in live[k][0] if m != x)) + (x,)
        if np.prod([float(size[m]) for m in names]) > most_rows:
            return total, np.zeros((n, count)), np.zeros((n, count)), np.zeros(n, bool)
        tables = [_spread(live[k], names) for k in mine]
        # the smallest table first, as dag.eliminate joins them
        turns = np.argsort(np.stack([np.isfinite(live[k][1]).reshape(n, -1).sum(1) for k in mine], axis=1), axis=1, kind="stable")
        table = np.empty((n, *(size[m] for m in names)))
        for turn in np.unique(turns, axis=0) if len(mine) > 2 else turns[:1]:
            rows = np.flatnonzero((turns == turn).all(1)) if len(mine) > 2 else slice(None)
            part = tables[turn[0]][rows]
            for k in turn[1:]:
                part = part + tables[k][rows]
            table[rows] = part
        solved &= np.isfinite(table).reshape(n, -1).sum(1) < ROWS
        pick, low = table.argmin(-1), table.min(-1)
        rest = names[:-1]
        steps.append((x, rest, pick))
        for k in mine:
            for m in live[k][0]:
                of[m].discard(k)
            del live[k]
        if rest:
            live[fresh] = (rest, low)
            for m in rest:
                of[m].add(fresh)
                heapq.heappush(heap, (width(m), m))
            fresh += 1
        else:
            total = total + low
    one, values = np.arange(n), {}
    for x, rest, pick in reversed(steps):
        values[x] = pick[(one, *(values[m] for m in rest))]
    entry, leave = (np.stack([values[2 * v + k] for v in range(count)], axis=1) for k in (0, 1))
    return total, entry // 2, leave, solved


def _spread(factor: tuple[tuple[int, ...], np.ndarray], names: tuple[int, ...]) -> np.ndarray:
    """A factor's table with an axis for each name."""
    own, table = factor
    order = sorted(range(len(own)), key=lambda k: names.index(own[k]))
    table = table.transpose(0, *(k + 1 for k in order))
    at = {names.index(own[k]): table.shape[i + 1] for i, k in enumerate(order)}
    return table.reshape(len(table), *(at.get(k, 1) for k in range(len(names))))


def _profiled(s: Alike, most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `_eliminated`, by profile.solve where its first pass drops nothing."""
    n, count, order = len(s.cells[0]), len(s.before), profile.narrow_order(s.before, s.after)
    ways: dict[tuple[int, int], np.ndarray] = {(u, v): np.where(s.ahead(u, v), 1, np.where(s.same(u, v), 2, 0)).astype(np.int8) for v in range(count) for u in s.before[v]}
    togo, told = [np.zeros(c.shape) for c in s.cells], {}
    for v in reversed(order):
        best = (s.run[v] + togo[v][:, None, :]).min(2)
        for u in s.before[v]:
            told[u, v] = (profile.entered(ways[u, v], s.cost[v][:, None, :], s.beta) + best[:, None, :]).min(2) / len(s.before[v])
            togo[u] = togo[u] + told[u, v]
    left, live, solved = [len(x) for x in s.after], [], np.ones(n, bool)
    who, exits, cost, rest = np.arange(n), np.zeros((n, 0), np.int64), np.zeros(n), np.zeros(n)
    tables = []
    for v in order:
        columns = [live.index(u) for u in s.before[v]]
        if columns:
            code = _coded(who, exits[:, columns], [s.cells[u].shape[1] for u in s.before[v]], n)
            _, keys, which = np.unique(code, return_index=True, return_inverse=True)
            own, first = who[keys], exits[keys][:, columns]
            way = ways[s.before[v][0], v][own, first[:, 0]]
            for k, u in enumerate(s.before[v][1:], 1):
                other = ways[u, v][own, first[:, k]]
                way = np.where((way == 0) | (other == 0), 0, np.maximum(way, other))
            entry = profile.entered(way, s.cost[v][own], s.beta)
        else:
            own, which, entry = np.arange(n), who, s.cost[v]
        low, pick = np.full(entry.shape, INF), np.zeros(entry.shape, np.int64)
        for y in range(entry.shape[1]):
            c = entry[:, y, None] + s.run[v][own, y]
            less = c < low
            low, pick = np.where(less, c, low), np.where(less, y, pick)
        said = sum((told[u, v][who, exits[:, c]] for c, u in zip(columns, s.before[v], strict=True)), np.zeros(len(who)))
        grown, more = cost[:, None] + low[which], (rest - said)[:, None] + togo[v][who]
        row, x = np.nonzero(np.isfinite(grown + more))
        held = np.bincount(who[row], minlength=n)
        g, h = grown[row, x], more[row, x]
        for u in s.before[v]:
            left[u] -= 1
        stay = [c for c, u in enumerate(live) if left[u]]
        new, live = exits[row][:, stay], [live[c] for c in stay]
        if left[v]:
            new = np.concatenate((new, x[:, None]), axis=1)
            live.append(v)
        code = _coded(who[row], new, [s.cells[u].shape[1] for u in live], n)
        by = np.lexsort((g, code))
        keep = by[np.concatenate((np.ones(min(1, len(by)), bool), code[by][1:] != code[by][:-1]))]
        solved &= (held <= most_rows) & (np.bincount(who[row[keep]], minlength=n) <= profile.BEAM)
        keep = keep[solved[who[row[keep]]]]
        tables.append((v, row[keep], pick[which[row[keep]], x[keep]], x[keep]))
        who, exits, cost, rest = who[row[keep]], new[keep], g[keep], h[keep]
    total, entry, leave, at = np.full(n, INF), np.zeros((n, count), np.int64), np.zeros((n, count), np.int64), np.arange(len(who))
    total[who] = cost  # no vertex is live at the end: one profile for each component
    for v, parent, enters, leaves in reversed(tables):
        entry[who, v], leave[who, v] = enters[at], leaves[at]
        at = parent[at]
    return total, entry, leave, solved


def _coded(who: np.ndarray, rows: np.ndarray, sizes: list[int], n: int) -> np.ndarray:
    """Component and row as one number, in their order."""
    if n * np.prod([float(k) for k in sizes]) < 2**62:
        code = who.astype(np.int64)
        for c, k in enumerate(sizes):
            code = code * k + rows[:, c]
        return code
    return np.unique(np.concatenate((who[:, None], rows), axis=1), axis=0, return_inverse=True)[1].ravel()


@dataclass
class Solved:
    """Cost of each component (infinite: not solved here, or `none`: it has no matching), and its pairs: component, segments
    of both sides, place in the run."""

    cost: np.ndarray
    none: np.ndarray
    owner: np.ndarray
    u: np.ndarray
    v: np.ndarray
    place: np.ndarray


def solve(a: Nets, b: Nets, c: Candidates, alpha: float, beta: float, most_rows: int) -> Solved:
    """dag.match_runs of the components whose shape others share."""
    n = len(a.first) - 1
    cost, none = np.full(n, INF), np.zeros(n, bool)
    out: list[tuple[np.ndarray, ...]] = []
    widest = np.zeros(n, np.int64)
    np.maximum.at(widest, a.owner, c.counts)
    begin = starts(c.counts)[:-1]
    shapes: dict[tuple[bytes, bool], list[int]] = defaultdict(list)
    local = _locals(a)
    for k in np.flatnonzero((widest > 0) & (widest <= CELLS) & (np.bincount(a.owner, minlength=n) > 0)):
        shapes[local[a.first[k] : a.first[k + 1]].tobytes()].append(k)
    for shape, own in shapes.items():
        if len(own) < FEW:
            continue
        ends = np.frombuffer(shape, np.int64).reshape(-1, 2)
        tails = defaultdict(list)
        for k, t in enumerate(ends[:, 0].tolist()):
            tails[t].append(k)
        net = dag.Net(np.zeros((len(ends), 2)), [list(tails[h]) for h in ends[:, 1].tolist()])
        try:
            dag.order_of(net)
        except dag.NotADag:
            continue
        forest = max(map(len, net.before), default=0) <= 1
        for k in range(0, len(own), MANY):
            part = np.array(own[k : k + MANY])
            s = _alike(a, b, c, net, part, begin, forest, alpha, beta)
            if not forest and profile.predicted_rows(net.before, net.after, [x.shape[1] for x in s.cells]) > 1e6 * most_rows:
                continue  # dag.plan may take the other engine
            with np.errstate(invalid="ignore"):
                total, entry, leave, ok = (_eliminated if forest else _profiled)(s, most_rows)
                nothing = ok & np.isinf(total)
                ok, found = ok & ~nothing, []
                for v in range(len(net.after)):
                    e, x = (np.where(ok, t[:, v], 0).astype(np.int64) for t in (entry, leave))
                    way, clear = _way(s, v, e, x)
                    ok = ok & clear
                    found.append(np.stack(way, axis=1))
            cost[part[ok]] = total[ok]
            none[part[nothing]] = True
            for v, way in enumerate(found):
                r, back = np.nonzero((way >= 0) & ok[:, None])
                long = (way >= 0).sum(1)
                out.append((part[r], a.first[part[r]] + v, s.cells[v][r, way[r, back]], long[r] - 1 - back))
    if not out:
        return Solved(cost, none, *(np.zeros(0, np.int64) for _ in range(4)))
    owner, u, v, place = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((place, u))
    return Solved(cost, none, owner[order], u[order], v[order], place[order])


def _locals(a: Nets) -> np.ndarray:
    """(tail, head) of each segment, nodes numbered as they appear in their component."""
    nodes = np.stack((a.tail, a.head), axis=1).ravel()
    _, first, which = np.unique(nodes, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    number = rank[which.ravel()]
    low = np.full(len(a.first) - 1, np.iinfo(np.int64).max)
    owner = np.repeat(a.owner, 2)
    np.minimum.at(low, owner, number)
    return np.ascontiguousarray((number - low[owner]).reshape(-1, 2))


def _alike(a: Nets, b: Nets, c: Candidates, net: dag.Net, part: np.ndarray, begin: np.ndarray, forest: bool, alpha: float, beta: float) -> Alike:
    cells, cost = [], []
    for v in range(len(net.after)):
        i = a.first[part] + v
        k = np.arange(int(c.counts[i].max()))
        there = k < c.counts[i][:, None]
        at = np.where(there, begin[i][:, None] + k, 0)
        x, price = np.where(there, c.cells[at], -1), np.where(there, c.cost[at], INF)
        if forest:  # dag.eliminate takes equals in the order of their names as text
            name = np.where(there, (x - b.first[part][:, None]).astype("U20"), "~")
            order = np.argsort(name, axis=1, kind="stable")
            x, price = np.take_along_axis(x, order, 1), np.take_along_axis(price, order, 1)
        cells.append(x)
        cost.append(price)
    s = Alike(net.before, net.after, cells, cost, [], b, alpha, beta)
    s.run.extend(_runs(s, v) for v in range(len(cells)))
    return s
