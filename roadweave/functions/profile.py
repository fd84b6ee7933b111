"""Least-cost warping of a directed acyclic network, one vertex after another, with a cost for each profile.

A profile says where the live vertices of the source exit: those that are done but have a successor that isn't. Vertices are
taken in an order that keeps few of them live; a vertex is discharged once its last successor is done, and profiles that
then say the same are one, the cheapest. At a vertex that every way passes, one column is left.

Every profile has a bound of what is still to come: each vertex to come counts for its predecessors in equal parts, at the
best it can do for each of them alone. A first pass keeps the BEAM most promising profiles; if it never had to drop any, it
is the answer, else its cost is the limit of a second pass that drops what can't be as cheap, and nothing else.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np

INF = float("inf")
BEAM = 256
#: Slack in comparisons of sums that are taken in different orders.
SLACK = 1e-9


class TooManyProfiles(ValueError):
    """More profiles than allowed are live at once."""


@dataclass
class Steps:
    """A network's vertices in the order of their steps, and what each needs.

    cells: target cells; run: cheapest further cover from an entry to an exit; after: exits of a predecessor by which a cell
    may be entered ahead (1) or by a stall only (2); togo: bound of what follows each exit; said: a successor's part of it.
    """

    order: list[int]
    before: list[list[int]]
    cells: list[np.ndarray]
    cost: list[np.ndarray]
    run: list[np.ndarray]
    after: dict[tuple[int, int], np.ndarray]
    beta: float
    togo: list[np.ndarray]
    said: dict[tuple[int, int], np.ndarray]


def narrow_order(before: list[list[int]], after: list[list[int]]) -> list[int]:
    """A topological order in which each next vertex leaves as few live ones as it can, the latest ready of equals."""
    waits, left = [len(b) for b in before], [len(a) for a in after]
    ready = [v for v, n in enumerate(waits) if not n][::-1]
    out = []
    while ready:
        best, at = None, 0
        for k in range(len(ready) - 1, max(-1, len(ready) - 65), -1):  # the latest; an order is only better or worse, never wrong
            v = ready[k]
            grows = bool(after[v]) - sum(left[u] == 1 for u in before[v])
            if best is None or grows < best:
                best, at = grows, k
        v = ready.pop(at)
        out.append(v)
        for u in before[v]:
            left[u] -= 1
        for w in after[v]:
            waits[w] -= 1
            if not waits[w]:
                ready.append(w)
    return out


def entered(way: np.ndarray, cost: np.ndarray, beta: float) -> np.ndarray:
    """Cost of entering each cell: way 0 not at all, 1 from ahead (a price of either kind), 2 by a stall."""
    return np.where(way == 1, min(1.0, beta) * cost, np.where(way == 2, beta * cost, INF))


def through(entry: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least cost, entry) of each exit, for rows of costs of entries."""
    low, pick = np.full((len(entry), run.shape[1]), INF), np.zeros((len(entry), run.shape[1]), np.int32)
    for y in range(len(run)):
        c = entry[:, y, None] + run[y]
        less = c < low
        low, pick = np.where(less, c, low), np.where(less, y, pick)
    return low, pick


def prepare(before: list[list[int]], after: list[list[int]], cost: list[dict[int, float]], run_of, b_before: list[list[int]], beta: float) -> Steps:
    """run_of(v, cell): {exit: cost} of runs of v that enter at a cell."""
    cells = [np.array(list(c), np.int64) for c in cost]
    place = [{x: k for k, x in enumerate(c)} for c in cost]
    price = [np.array(list(c.values())) for c in cost]
    run = []
    for v, c in enumerate(cost):
        r = np.full((len(c), len(c)), INF)
        for y, k in place[v].items():
            for x, more in run_of(v, y).items():
                r[k, place[v][x]] = more
        run.append(r)
    ways: dict[tuple[int, int], np.ndarray] = {}
    for v in range(len(cost)):
        for u in before[v]:
            way = np.zeros((len(cells[u]), len(cells[v])), np.int8)
            for y, k in place[v].items():
                if y in place[u]:
                    way[place[u][y], k] = 2
                for x in b_before[y]:
                    if x in place[u]:
                        way[place[u][x], k] = 1
            ways[u, v] = way
    order = narrow_order(before, after)
    togo, said = [np.zeros(len(c)) for c in cells], {}
    for v in reversed(order):
        best = (run[v] + togo[v]).min(1, initial=INF)  # what an entry leads to
        for u in before[v]:
            said[u, v] = (entered(ways[u, v], price[v], beta) + best).min(1, initial=INF) / len(before[v])
            togo[u] = togo[u] + said[u, v]
    return Steps(order, before, cells, price, run, ways, beta, togo, said)


def solve(s: Steps, after: list[list[int]], most_rows: int = 2_000_000, until: float | None = None, beam: int = BEAM) -> tuple[float, list[tuple[int, int]], int]:
    """(cost, entry and exit of each vertex as places among its cells, largest number of profiles); no matching: cost INF."""
    cost, ends, most, cut = _pass(s, after, most_rows, until, INF, beam)
    if not cut:
        return cost, ends, most
    exact, better, most, _ = _pass(s, after, most_rows, until, cost, None)
    return (exact, better, most) if exact <= cost else (cost, ends, most)


def _pass(s: Steps, after: list[list[int]], most_rows: int, until: float | None, limit: float, beam: int | None) -> tuple[float, list, int, bool]:
    left = [len(a) for a in after]
    live: list[int] = []
    exits, cost, togo = np.zeros((1, 0), np.int32), np.zeros(1), np.zeros(1)
    tables, most, cut = [], 1, False
    for v in s.order:
        if until is not None and time.monotonic() > until:
            raise TimeoutError("the time allowed is over")
        columns = [live.index(u) for u in s.before[v]]
        if columns:
            keys, which = _numbered(exits[:, columns], [len(s.cells[u]) for u in s.before[v]])
            first = exits[keys][:, columns]
            way = s.after[s.before[v][0], v][first[:, 0]]
            for k, u in enumerate(s.before[v][1:], 1):
                other = s.after[u, v][first[:, k]]
                way = np.where((way == 0) | (other == 0), 0, np.maximum(way, other))
            low, pick = through(entered(way, s.cost[v], s.beta), s.run[v])
        else:
            which = np.zeros(len(exits), np.int64)
            low, pick = through(s.cost[v][None], s.run[v])
        # what a profile has still to come: its live vertices less what was said about v, and v's own
        said = sum((s.said[u, v][exits[:, c]] for c, u in zip(columns, s.before[v], strict=True)), np.zeros(len(exits)))
        grown, rest = cost[:, None] + low[which], (togo - said)[:, None] + s.togo[v][None]
        row, x = np.nonzero(grown + rest <= limit + SLACK * (1 + abs(limit)) if np.isfinite(limit) else np.isfinite(grown + rest))
        if not len(row):
            return INF, [], most, cut
        if len(row) > most_rows:
            raise TooManyProfiles(f"more than {most_rows} profiles")
        g, h = grown[row, x], rest[row, x]
        for u in s.before[v]:
            left[u] -= 1
        stay = [c for c, u in enumerate(live) if left[u]]
        new = exits[row][:, stay]
        live = [live[c] for c in stay]
        if left[v]:
            new = np.concatenate((new, x[:, None].astype(np.int32)), axis=1)
            live.append(v)
        order = np.argsort(g, kind="stable")
        keep, _ = _numbered(new[order], [len(s.cells[u]) for u in live])
        keep = order[keep]
        if beam is not None and len(keep) > beam:
            keep, cut = keep[np.argpartition((g + h)[keep], beam)[:beam]], True
        most = max(most, len(keep))
        exits, cost, togo = new[keep], g[keep], h[keep]
        tables.append((v, row[keep].astype(np.int32), pick[which[row[keep]], x[keep]], x[keep].astype(np.int32)))
    ends: list = [None] * len(s.cells)
    at = int(cost.argmin())
    total = float(cost[at])
    for v, parent, entry, leave in reversed(tables):
        ends[v] = int(entry[at]), int(leave[at])
        at = int(parent[at])
    return total, ends, most, cut


def _numbered(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each different row, which of these each row is)."""
    if not rows.shape[1]:
        return np.zeros(min(1, len(rows)), np.int64), np.zeros(len(rows), np.int64)
    if np.prod([float(n) for n in sizes]) < 2**62:
        key = np.zeros(len(rows), np.int64)
        for c, n in enumerate(sizes):
            key = key * n + rows[:, c]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
    else:
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def predicted_rows(before: list[list[int]], after: list[list[int]], sizes: list[int]) -> float:
    """No table of profiles, before any are merged or dropped, has more rows: from the order and the numbers of cells alone."""
    left, live, most = [len(a) for a in after], [], 1.0
    for v in narrow_order(before, after):
        most = max(most, float(np.prod([float(sizes[u]) for u in live])) * sizes[v])
        for u in before[v]:
            left[u] -= 1
        live = [u for u in live if left[u]] + ([v] if left[v] else [])
    return most
