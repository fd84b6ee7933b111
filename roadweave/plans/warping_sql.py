"""DuckDB forms of warping, for comparison: one cell a row, diagonals by recursion."""

from __future__ import annotations


def _segments(t: str, side: str) -> str:
    """Segments with their lengths and starts along the line, and vertices with theirs, of {t}{side}(p, k, x, y)."""
    own, w = f"{t}{side}", "OVER (PARTITION BY p ORDER BY k)"
    return f"""
{own}s AS (SELECT p, k, x AS x1, y AS y1, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS l FROM (SELECT *, lead(x) {w} AS x2, lead(y) {w} AS y2 FROM {own}) WHERE x2 IS NOT NULL),
{own}g AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s0 FROM {own}s),
{own}v AS (SELECT v.p, v.k, v.x, v.y, coalesce(g.s0 + g.l, 0.0) AS s FROM {own} v LEFT JOIN {own}g g ON g.p = v.p AND g.k = v.k - 1),
{own}n AS (SELECT p, sum(l) AS size FROM {own}s GROUP BY p)"""


def _feet(t: str, line: str, points: str) -> str:
    """{t}{line}f(p, k, s, x, y): the nearest place on a line of each vertex of the other, the first of equals."""
    return f"""
{t}{line}f AS (
  SELECT p, k, s0 + t * l AS s, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM (
    SELECT *, row_number() OVER (PARTITION BY p, k ORDER BY (x1 + t * (x2 - x1) - px) * (x1 + t * (x2 - x1) - px) + (y1 + t * (y2 - y1) - py) * (y1 + t * (y2 - y1) - py), sk) AS nth FROM (
      SELECT v.p, v.k, v.x AS px, v.y AS py, g.k AS sk, g.x1, g.y1, g.x2, g.y2, g.l, g.s0,
        CASE WHEN g.l > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((v.x - g.x1) * (g.x2 - g.x1) + (v.y - g.y1) * (g.y2 - g.y1)) / (g.l * g.l))) ELSE 0.0 END AS t
      FROM {t}{points} v JOIN {t}{line}g g ON g.p = v.p)) WHERE nth = 1)"""


def _pool(t: str, side: str) -> str:
    return f"""
{t}{side}p AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY s, o) - 1 AS i, s, x, y FROM (
    SELECT *, s - lag(s) OVER (PARTITION BY p ORDER BY s, o) AS gap FROM (
      SELECT v.p, k AS o, s, x, y FROM {t}{side}v v JOIN {t}0 z ON z.p = v.p WHERE s >= start_{side}
      UNION ALL SELECT f.p, 1000 + k, s, x, y FROM {t}{side}f f JOIN {t}0 z ON z.p = f.p WHERE s >= start_{side})) WHERE gap IS NULL OR gap > 1e-3)"""


BEARING = "((degrees(atan2({x2} - {x1}, {y2} - {y1})) + 360.0::DOUBLE) % 360.0::DOUBLE)"


def turn(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), 360.0::DOUBLE - abs({a} - {b}))"


def warp(t: str) -> str:
    """CTEs from {t}a and {t}b (pair p, vertex k from 0, x, y) to {t}m (p, dtw, mx, mn, bearing, overlap, matched)."""
    return f"""{_segments(t, "a")},{_segments(t, "b")},{_feet(t, "a", "b")},{_feet(t, "b", "a")},
{t}0 AS (
  SELECT p, CASE WHEN ona > 1e-3 AND onb <= 1e-3 THEN ona WHEN onb > 1e-3 AND ona <= 1e-3 THEN 0.0 WHEN ona > onb THEN ona ELSE 0.0 END AS start_a,
    CASE WHEN onb > 1e-3 AND ona <= 1e-3 THEN onb WHEN ona > 1e-3 AND onb <= 1e-3 THEN 0.0 WHEN onb > ona THEN onb ELSE 0.0 END AS start_b
  FROM (SELECT a.p, a.s AS ona, b.s AS onb FROM {t}af a JOIN {t}bf b ON a.p = b.p WHERE a.k = 0 AND b.k = 0)),{_pool(t, "a")},{_pool(t, "b")},
{t}c AS (SELECT a.p, a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM {t}ap a JOIN {t}bp b ON a.p = b.p),
{t}d AS (
  SELECT p, i, j, d AS cost, 1 AS n, d AS hi, d AS lo, 0 AS age FROM {t}c WHERE i = 0 AND j = 0
  UNION ALL
  SELECT * FROM (
    SELECT c.p, c.i, c.j, c.d + w.cost, w.n + 1, greatest(w.hi, c.d), least(w.lo, c.d), 0 FROM (
      SELECT *, row_number() OVER (PARTITION BY p, i, j ORDER BY cost, way) AS nth FROM (
        SELECT p, i + 1 AS i, j, cost, n, hi, lo, 0 AS way FROM {t}d WHERE age = 0
        UNION ALL SELECT p, i, j + 1, cost, n, hi, lo, 1 FROM {t}d WHERE age = 0
        UNION ALL SELECT p, i + 1, j + 1, cost, n, hi, lo, 2 FROM {t}d WHERE age = 1)) w
    JOIN {t}c c ON c.p = w.p AND c.i = w.i AND c.j = w.j WHERE w.nth = 1
    UNION ALL SELECT p, i, j, cost, n, hi, lo, 1 FROM {t}d WHERE age = 0)),
{t}e AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY p ORDER BY cost, o DESC) AS nth FROM (
      SELECT d.*, z.ni, z.nj, unnest(CASE WHEN d.i = ni AND d.j = nj THEN [d.j, 1000 + d.i] WHEN d.i = ni THEN [d.j] ELSE [1000 + d.i] END) AS o
      FROM {t}d d JOIN (SELECT p, max(i) AS ni, max(j) AS nj FROM {t}c GROUP BY p) z ON z.p = d.p WHERE d.age = 0 AND (d.i = ni OR d.j = nj))) WHERE nth = 1),
{t}l AS (SELECT a.p, {BEARING.format(x1="a.x", y1="a.y", x2="a2.x", y2="a2.y")} AS ba, {BEARING.format(x1="b.x", y1="b.y", x2="b2.x", y2="b2.y")} AS bb
  FROM {t}a a JOIN {t}b b ON b.p = a.p AND b.k = 0 JOIN (SELECT p, max_by(x, k) AS x, max_by(y, k) AS y FROM {t}a GROUP BY p) a2 ON a2.p = a.p JOIN (SELECT p, max_by(x, k) AS x, max_by(y, k) AS y FROM {t}b GROUP BY p) b2 ON b2.p = a.p WHERE a.k = 0),
{t}m AS (
  SELECT l.p, coalesce(e.cost / e.n, 'inf'::DOUBLE) AS dtw, coalesce(e.hi, 'inf'::DOUBLE) AS mx, coalesce(e.lo, 'inf'::DOUBLE) AS mn,
    CASE WHEN e.n > 1 THEN {turn(BEARING.format(x1="a0.x", y1="a0.y", x2="a1.x", y2="a1.y"), BEARING.format(x1="b0.x", y1="b0.y", x2="b1.x", y2="b1.y"))} ELSE {turn("l.ba", "l.bb")} END AS bearing,
    coalesce(least(100, greatest(0, round_even(100.0::DOUBLE * greatest(0.0, a1.s - z.start_a) / nullif(n.size, 0), 0))), 0)::BIGINT AS overlap, coalesce(greatest(0.0, a1.s - z.start_a), 0.0) AS matched
  FROM {t}l l LEFT JOIN {t}e e ON e.p = l.p LEFT JOIN {t}0 z ON z.p = l.p LEFT JOIN {t}an n ON n.p = l.p
  LEFT JOIN {t}ap a0 ON a0.p = l.p AND a0.i = 0 LEFT JOIN {t}ap a1 ON a1.p = e.p AND a1.i = e.i LEFT JOIN {t}bp b0 ON b0.p = l.p AND b0.i = 0 LEFT JOIN {t}bp b1 ON b1.p = e.p AND b1.i = e.j)"""


def both_ways(t: str) -> str:
    """As `warp`, of pairs (p) drawn in any direction: {t}u has A, {t}w has B turned to A, {t}x the other way round."""
    flip = "CASE WHEN sqrt((a0.x - b1.x) * (a0.x - b1.x) + (a0.y - b1.y) * (a0.y - b1.y)) + sqrt((a1.x - b0.x) * (a1.x - b0.x) + (a1.y - b0.y) * (a1.y - b0.y)) < sqrt((a0.x - b0.x) * (a0.x - b0.x) + (a0.y - b0.y) * (a0.y - b0.y)) + sqrt((a1.x - b1.x) * (a1.x - b1.x) + (a1.y - b1.y) * (a1.y - b1.y)) THEN"
    ends = lambda of, n: f"(SELECT p, max_by(x, k) AS x, max_by(y, k) AS y, max(k) AS last FROM {of} GROUP BY p) {n}"
    def turned(of: str, to: str) -> str:  # noqa: E306
        return f"SELECT v.p, {flip} b1.last - v.k ELSE v.k END AS k, v.x, v.y FROM {of} v JOIN {ends(to, 'a1')} ON a1.p = v.p JOIN {ends(of, 'b1')} ON b1.p = v.p JOIN {to} a0 ON a0.p = v.p AND a0.k = 0 JOIN {of} b0 ON b0.p = v.p AND b0.k = 0"
    return f"""
{t}1a AS (SELECT * FROM {t}a), {t}1b AS ({turned(f"{t}b", f"{t}a")}),
{t}2a AS (SELECT * FROM {t}b), {t}2b AS ({turned(f"{t}a", f"{t}b")}),{warp(f"{t}1")},{warp(f"{t}2")}"""


def places(t: str, step: float, same: float = 1e-9) -> str:
    """Of pairs {t}a, {t}b (p, k, x, y): {t}bq (p, i, pos, x, y), each B line with the feet of A's vertices and even fill; {t}am (a, i, pos, x, y), each A line with the feet of all its B vertices and fill.

    Needs ra (p, id_a, id_b).
    """

    def filled(name: str, rows: str, key: str) -> str:
        """Places {key}, s, x, y in order, no two alike, and more between those farther apart than a step."""
        w = f"OVER (PARTITION BY {key} ORDER BY s)"
        return f"""
{name}0 AS (SELECT {key}, s, x, y FROM (SELECT *, s - lag(s) {w} AS gap FROM ({rows})) WHERE gap IS NULL OR gap > {same}),
{name}1 AS (SELECT *, greatest(1, coalesce(ceil((s2 - s) / {step}), 1))::BIGINT AS parts FROM (SELECT *, lead(s) {w} AS s2, lead(x) {w} AS x2, lead(y) {w} AS y2 FROM {name}0)),
{name} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY s, r) - 1 AS i, s + CASE WHEN r = 0 THEN 0 ELSE (s2 - s) * r / parts END AS pos, CASE WHEN r = 0 THEN x ELSE x + (x2 - x) * r / parts END AS x, CASE WHEN r = 0 THEN y ELSE y + (y2 - y) * r / parts END AS y FROM (SELECT *, unnest(range(parts)) AS r FROM {name}1))"""

    inside = lambda side: f"SELECT f.p, f.s, f.x, f.y FROM {t}{side}f f JOIN {t}{side}n z ON z.p = f.p WHERE f.s > {same} AND f.s < z.size - {same}"
    of_b = f"SELECT p, s, x, y FROM {t}bv UNION ALL {inside('b')}"
    of_a = f"SELECT DISTINCT id_a AS a, s, x, y FROM ra JOIN (SELECT p, s, x, y FROM {t}av UNION ALL {inside('a')}) USING (p)"
    return f"""{_segments(t, "a")},{_segments(t, "b")},{_feet(t, "a", "b")},{_feet(t, "b", "a")},{filled(f"{t}bq", of_b, "p")},{filled(f"{t}am", of_a, "a")}"""
