"""Hard-negative mining by a two-dimensional block matrix product.

Scores of a stated query set (the anchors) against all rows are a product of two integer matrices. Rows are dealt into
panels of about PANEL rows, anchors into panels of about ANCHORS; each panel is cut into `depth` chunks of dimensions. An
anchor panel and a row panel meet once for each chunk and give a partial tile of scores; the partial tiles of a pair of
panels are added, and a whole tile is reduced at once to its best rows, so no score outlives its tile. Panels meet at places
for a group of anchor panels and a group of row panels, all chunks of both, so that the partial tiles of a pair are made,
and added, in one task, and only rows that are still among the best leave it. Vectors of more than WIDE dimensions would
fill such a task: their chunks meet one by one, and their partial tiles are added by a shuffle on the pair. The best of all
tiles are taken by Spark's own limited windows.

Two products: the first meets panels of one label only and gives each anchor's positives; the second meets all rows and
keeps, for each anchor and positive, the best rows of other labels in the positive's window of scores.

Scale: labels with more than PANEL / 4 rows have panels of their own, others share panels by hash, so a label of any size is
many panels. Nothing is broadcast: an anchor panel is sent once to each group of row panels (GROUP bytes), a row panel once
to each group of anchor panels. Work grows with anchors x rows, as all scores are asked for; of most scores it is a product
and two comparisons: a score counts only from the worst of the best so far on, which tightens as panels go by. A task holds
a group of each side, a tile, and the best rows of a panel's anchors.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; rows without vec_id
are no anchors, keep their label and come last among equal scores; repeated ids are rows of their own (an anchor leaves out
only its own row), told apart in ties by their place in the table; missing components of shorter vectors, and all of an
empty one, are 0; components are cut off at +-sqrt(2^63 / (100 x dimensions)) steps, so that no score overflows (some
1.5e5 at 64 dimensions); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.plans.scratch import kernel_parts

from ._kit import Batches, Scratch

PANEL, ANCHORS = 2048, 512
#: Bytes of a group of row panels, anchor panels in a group, dimensions up to which all chunks of a pair meet in one task.
GROUP, ANCHOR_GROUP, WIDE = 24 << 20, 32, 4096
#: Fixed values of the score windows, in hundredths of the positive's score.
LOW, SCALE, HIGH = 30, 100, 90
#: Score of rows that aren't eligible; below every score.
NEVER = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, steps: int = 256) -> DataFrame:
    """(row, id, label, q) of the rows that take part; q are whole steps."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(steps)) * v.cast("double")))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < math.inf))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("q"))


def homes(rows: DataFrame, panel: int) -> DataFrame:
    """(label, home, parts): a label of many rows is at home alone, in several parts; others share homes of one part."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    alone = F.col("n") > panel // 4  # smaller ones fill a panel evenly
    small = sizes.where(~alone).agg(F.sum("n")).first()[0] or 0
    shared = F.concat(F.lit("shared-"), F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(small / panel)))).cast("string"))
    return sizes.select("label", F.when(alone, F.concat(F.lit("label-"), F.col("label").cast("string"))).otherwise(shared).alias("home"), F.when(alone, F.ceil(F.col("n") / panel)).otherwise(1).cast("long").alias("parts"))


PANELS = "home string, part long, chunk int, rows binary, ids binary, unnamed binary, labels binary, panel binary, width int, wanted binary"


KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def arrow_schema(columns: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def narrow(a: np.ndarray) -> bytes:
    """The numbers in the narrowest integers that hold them, the first byte being their size."""
    top = int(np.abs(a).max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + a.astype(kind).tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int8)[1:].view(f"<i{b[0]}").astype(np.int64)


def matrix(q: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of length d, filled up with zeros, cut off where a score could overflow."""
    size = pa.compute.list_value_length(q).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(q), d), np.int64)
    most = math.isqrt((2**63 - 1) // (SCALE * max(d, 1)))
    out[np.arange(d) < size[:, None]] = np.clip(q.flatten().to_numpy(zero_copy_only=False), -most, most).astype(np.int64)
    return out


def _panel_maker(d: int, depth: int) -> Callable:
    """Panels of a group of rows, one for each chunk of dimensions; rows in the order that breaks ties."""
    cuts = np.linspace(0, d, depth + 1).astype(int)

    def make(group: pa.Table) -> pa.Table:
        row = group["row"].to_numpy()
        unnamed = group["id"].is_null().to_numpy()
        ids = group["id"].fill_null(0).to_numpy()
        order = np.lexsort((row, ids, unnamed))
        q = matrix(group["q"].combine_chunks(), d)[order]
        wanted = b""
        if "wanted" in group.column_names:  # scores and rows of each anchor's positives, after their number
            lists = [group["wanted"][int(k)].as_py() for k in order]
            wanted = np.array([v for w in lists for v in (len(w), *(x for p in w for x in (p["score"], p["row"])))], np.int64).tobytes()
        one = {
            "home": group["home"][0].as_py(), "part": group["part"][0].as_py(), "rows": row[order].astype(np.int64).tobytes(), "ids": ids[order].astype(np.int64).tobytes(),
            "unnamed": unnamed[order].astype(np.int8).tobytes(), "labels": group["label"].to_numpy()[order].astype(np.int64).tobytes(), "wanted": wanted,
        }
        return pa.Table.from_pylist([one | {"chunk": k, "panel": narrow(q[:, cuts[k] : cuts[k + 1]].ravel()), "width": int(cuts[k + 1] - cuts[k])} for k in range(depth)], schema=schema)

    schema = arrow_schema(PANELS)
    return make


def panels(rows: DataFrame, d: int, depth: int) -> DataFrame:
    """Panels of rows (row, id, label, q, home, part, and wanted where scores are asked for), a group for each home and part."""
    return rows.groupBy("home", "part").applyInArrow(_panel_maker(d, depth), PANELS)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer scores of all pairs of rows; in floating point where every sum is a whole number below 2^53."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


PARTIAL = "a_home string, a_part long, home string, part long, chunk int, tile binary, a_rows binary, a_ids binary, a_labels binary, wanted binary, rows binary, ids binary, unnamed binary, labels binary"


def _multiply(parts: Batches) -> Batches:
    """Partial tiles of pairs of panels; what names their rows goes with the first chunk."""
    schema = arrow_schema(PARTIAL)
    names = ("a_rows", "a_ids", "a_labels", "wanted", "rows", "ids", "unnamed", "labels")
    for batch in parts:
        for k in range(batch.num_rows):
            x = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            a, b = (wide(x[c]).reshape(-1, x["width"]) if x["width"] else np.zeros((len(x[n]) // 8, 0), np.int64) for c, n in (("a_panel", "a_rows"), ("panel", "rows")))
            first = {c: x[c] if x["chunk"] == 0 else b"" for c in names}
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in ("a_home", "a_part", "home", "part", "chunk")} | first | {"tile": narrow(product(a, b).ravel())}], schema=schema)


def partial_tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every anchor panel against every row panel of its meeting place (column `meet`), for each chunk."""
    a = anchors.select("meet", "chunk", "wanted", *(F.col(c).alias(f"a_{c}") for c in ("home", "part", "panel", "rows", "ids", "labels")))
    met = a.join(rows.drop("wanted"), ["meet", "chunk"])
    met = met.select("a_home", "a_part", "home", "part", "chunk", "a_panel", "panel", "width", "a_rows", "a_ids", "a_labels", "wanted", "rows", "ids", "unnamed", "labels")
    return met.mapInArrow(_multiply, PARTIAL)


def tiles(group: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sum of a pair's partial tiles, and its rows' names."""
    whole = sum(wide(t.as_py()) for t in group["tile"])
    first = group.filter(pa.compute.equal(group["chunk"], 0)).to_pylist()[0]
    names = {c: np.frombuffer(first[c], np.int8 if c == "unnamed" else np.int64) for c in ("a_rows", "a_ids", "a_labels", "wanted", "rows", "ids", "unnamed", "labels")}
    return whole.reshape(len(names["a_rows"]), len(names["rows"])), names


FOUND = "anchor_row long, anchor_id long, positive_row long, positive_score long, row long, id long, score long"


def _found(n: dict[str, np.ndarray], anchor: np.ndarray, place: np.ndarray, score: np.ndarray, positive: np.ndarray | None = None, positive_score: np.ndarray | None = None) -> pa.Table:
    nothing = np.zeros(len(anchor), np.int64)
    return pa.table({
        "anchor_row": n["a_rows"][anchor], "anchor_id": n["a_ids"][anchor], "positive_row": nothing if positive is None else positive, "positive_score": nothing if positive_score is None else positive_score,
        "row": n["rows"][place], "id": pa.array(n["ids"][place], mask=n["unnamed"][place] > 0), "score": score,
    })


def _best_alike(k: int) -> Callable:
    def reduce(group: pa.Table) -> pa.Table:
        s, n = tiles(group)
        s = np.where((n["a_labels"][:, None] == n["labels"]) & (n["a_rows"][:, None] != n["rows"]), s, NEVER)
        order = np.argsort(-(s + 1), axis=1, kind="stable")[:, :k]  # NEVER + 1 can be negated
        best = np.take_along_axis(s, order, 1)
        anchor, at = np.nonzero(best != NEVER)
        return _found(n, anchor, order[anchor, at], best[anchor, at])

    return reduce


def _best_in_windows(k: int) -> Callable:
    def reduce(group: pa.Table) -> pa.Table:
        s, n = tiles(group)
        s = np.where(n["a_labels"][:, None] != n["labels"], s, NEVER)
        order = np.argsort(-(s + 1), axis=1, kind="stable")
        ranked = np.take_along_axis(s, order, 1)
        w, at = n["wanted"], 0
        anchors, scores, rows = [], [], []
        for a in range(len(n["a_rows"])):
            m = int(w[at])
            pairs = w[at + 1 : at + 1 + 2 * m].reshape(m, 2)
            anchors += [a] * m
            scores += pairs[:, 0].tolist()
            rows += pairs[:, 1].tolist()
            at += 1 + 2 * m
        anchors, scores, rows = (np.array(v, np.int64) for v in (anchors, scores, rows))
        # a window is a run of the ranked scores: after those above it, as long as they reach its foot
        descending = -(ranked + 1)
        top, foot = (HIGH * scores) // SCALE, -((-LOW * scores) // SCALE)  # whole scores at most and at least
        begin = np.array([np.searchsorted(descending[a], -(t + 1), "left") for a, t in zip(anchors, top, strict=True)], np.int64)
        place = begin[:, None] + np.arange(k)
        there = place < s.shape[1]
        place = np.minimum(place, s.shape[1] - 1)
        got = ranked[anchors[:, None], place]
        p, j = np.nonzero(there & (got >= foot[:, None]) & (got <= top[:, None]) & (got != NEVER))
        return _found(n, anchors[p], order[anchors[p], place[p, j]], got[p, j], rows[p], scores[p])

    return reduce


class _Best:
    """The first k rows of each pair (an anchor and what it asks for), in order: score, then id, rows without one last, then row."""

    def __init__(self, pairs: int, k: int, low: np.ndarray):
        self.k, self.low = k, low  # the least score that still counts
        self.pair, self.score, self.unnamed, self.id, self.row = (np.zeros(0, np.int64) for _ in range(5))
        self.more: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, pair: np.ndarray, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Rows wait until they are a fair part of what is held; until then `low` says a little less than it could."""
        self.more.append((pair, score, unnamed, ids, row))
        self.waiting += len(pair)
        if 4 * self.waiting > max(len(self.pair), 1024):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        new = [np.concatenate([a, *b]).astype(np.int64) for a, *b in zip((self.pair, self.score, self.unnamed, self.id, self.row), *self.more, strict=True)]
        self.more, self.waiting = [], 0
        order = np.lexsort((new[4], new[3], new[2], -new[1], new[0]))
        own = new[0][order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rank = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
        self.pair, self.score, self.unnamed, self.id, self.row = (x[order[rank < self.k]] for x in new)
        last = order[rank == self.k - 1]
        self.low[new[0][last]] = np.maximum(self.low[new[0][last]], new[1][last])


def scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sum of the partial tiles of all chunks, exact: in the narrowest kind that holds every sum of magnitudes."""
    most = sum(x.shape[1] * int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) for x, y in zip(a, b, strict=True))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    whole = np.zeros((len(a[0]), len(b[0])), kind)
    for x, y in zip(a, b, strict=True):
        whole += x.astype(kind) @ y.astype(kind).T
    return whole


#: Rows of a panel after which the best so far are looked at again, while they are few.
SLICES = (64, 256, 1024)


def _whole_panels(table: pa.Table) -> list[dict]:
    """Panels with their chunks side by side."""
    found: dict[tuple, dict] = {}
    for k in range(table.num_rows):
        x = {c: table[c][k].as_py() for c in table.column_names}
        p = found.setdefault((x["home"], x["part"]), {"chunks": {}} | {c: np.frombuffer(x[c], np.int8 if c == "unnamed" else np.int64) for c in ("rows", "ids", "unnamed", "labels", "wanted")})
        p["chunks"][x["chunk"]] = (x["panel"], x["width"])
    return list(found.values())


def _chunks(panel: dict) -> list[np.ndarray]:
    """The numbers of each chunk, in the narrow integers that they came in."""
    n = len(panel["rows"])
    return [np.frombuffer(b, np.int8)[1:].view(f"<i{b[0]}").reshape(n, width) if width else np.zeros((n, 0), np.int8) for b, width in (panel["chunks"][k] for k in sorted(panel["chunks"]))]


def _best_of_groups(k: int, alike: bool) -> Callable:
    """The first k rows of each anchor (`alike`: of its label), or of each anchor and positive, among a group of row panels."""

    def reduce(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        blocks = [(p, _chunks(p)) for p in _whole_panels(rows)]
        out = []
        for n in _whole_panels(anchors):
            of = len(n["rows"])
            if alike:
                anchor, positive, positive_score = np.arange(of), np.zeros(of, np.int64), np.zeros(of, np.int64)
                top, low = np.full(of, np.iinfo(np.int64).max), np.full(of, NEVER + 1)
            else:
                w, at, per = n["wanted"], 0, []
                while at < len(w):
                    per.append(int(w[at]))
                    at += 1 + 2 * per[-1]
                per = np.array(per, np.int64)
                anchor = np.repeat(np.arange(of), per)
                pairs = np.delete(w, np.cumsum(1 + 2 * per) - 1 - 2 * per).reshape(-1, 2)
                positive_score, positive = pairs[:, 0], pairs[:, 1]
                top, low = (HIGH * positive_score) // SCALE, -((-LOW * positive_score) // SCALE)  # whole scores at most and at least
            best, a = _Best(len(anchor), k, low.copy()), _chunks(n)
            begin = np.searchsorted(anchor, np.arange(of + 1))
            asks = np.flatnonzero(np.diff(begin))
            least, upper = np.zeros(of, np.int64), np.zeros(of, np.int64)
            if len(asks):
                upper[asks] = np.maximum.reduceat(top, begin[asks])
            for p, b in blocks:
                use = asks  # a panel of one label is met only by anchors that it can answer
                if len(p["labels"]) and (p["labels"] == p["labels"][0]).all():
                    use = asks[(n["labels"][asks] == p["labels"][0]) == alike]
                if not len(use):
                    continue
                mine = [x[use] for x in a]
                cut = [0, *(x for x in SLICES if x < len(p["rows"])), len(p["rows"])] if len(best.score) < k * len(anchor) else [0, len(p["rows"])]
                for f, e in zip(cut, cut[1:], strict=False):
                    s = scores(mine, [x[f:e] for x in b])
                    least[asks] = np.minimum.reduceat(best.low, begin[asks])
                    hold = (lambda v: v.astype(s.dtype)) if s.dtype == np.int64 else (lambda v, m=2 ** (24 if s.dtype == np.float32 else 53): np.clip(v, -m, m).astype(s.dtype))  # noqa: B023
                    i, j = np.divmod(np.flatnonzero((s >= hold(least[use])[:, None]) & (s <= hold(upper[use])[:, None])), e - f)
                    own, there = use[i], f + j
                    same = n["labels"][own] == p["labels"][there]
                    keep = same & (n["rows"][own] != p["rows"][there]) if alike else ~same
                    i, j, own, there = i[keep], j[keep], own[keep], there[keep]
                    score = s[i, j].astype(np.int64)
                    each = (begin[1:] - begin[:-1])[own]
                    pair = np.repeat(begin[:-1][own], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                    score, there = np.repeat(score, each), np.repeat(there, each)
                    keep = (score >= best.low[pair]) & (score <= top[pair])
                    pair, score, there = pair[keep], score[keep], there[keep]
                    best.add(pair, score, p["unnamed"][there], p["ids"][there], p["rows"][there])
            best.settle()
            own = anchor[best.pair]
            out.append(pa.table({
                "anchor_row": n["rows"][own], "anchor_id": n["ids"][own], "positive_row": positive[best.pair], "positive_score": positive_score[best.pair],
                "row": best.row, "id": pa.array(best.id, mask=best.unnamed > 0), "score": best.score,
            }))
        return pa.concat_tables(out) if out else arrow_schema(FOUND).empty_table()

    return reduce


def _met(anchors: DataFrame, rows: DataFrame, reduce: Callable) -> DataFrame:
    """Groups of anchor panels and of row panels that meet (columns `meet` and `group`), each pair in one task."""
    parts = kernel_parts(anchors.sparkSession)
    names = ["meet", "group", *(c.split()[0] for c in PANELS.split(", "))]
    a, b = (x.select(*(F.col(c).alias(c) for c in names)).repartition(parts, "meet", "group").groupBy("meet", "group") for x in (anchors, rows))
    return a.cogroup(b).applyInArrow(reduce, FOUND)


def _groups(panels: int, dimensions: int, panel: int, others: int, parts: int) -> int:
    """Groups of row panels: GROUP bytes in each at most (two bytes a number), and enough of them for all tasks."""
    fits = max(1, GROUP // max(1, 2 * dimensions * panel))
    return max(1, math.ceil(panels / fits), min(panels, math.ceil(2 * parts / max(1, others))))


def _added(partial: DataFrame, reduce: Callable) -> DataFrame:
    """Partial tiles added by a shuffle on their pair of panels, and reduced."""
    pair = ["a_home", "a_part", "home", "part"]
    return partial.repartition(kernel_parts(partial.sparkSession), *pair).groupBy(*pair).applyInArrow(reduce, FOUND)


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k of each group, with their rank; Spark drops rows beyond k before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, depth: int = 2, panel: int = PANEL, per_anchor_panel: int = ANCHORS, wide: int = WIDE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    is_anchor: a condition on `id` that tells the anchors. Ranks count the negatives of an anchor and positive from 1.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.table(quantised(vectors), "rows")
    d = rows.agg(F.max(F.size("q"))).first()[0] or 0
    home = scratch.table(homes(rows, panel), "homes")
    part = lambda n: F.pmod(F.xxhash64("row"), n)
    at_home = rows.join(home, "label").withColumn("part", part(F.col("parts")))
    blocks = scratch.table(panels(at_home, d, depth), "panels")
    n_panels, tasks = blocks.where("chunk = 0").count(), kernel_parts(spark)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)

    anchors = at_home.where(is_anchor).drop("part", "parts")
    n = scratch.table(anchors.groupBy("home").agg(F.ceil(F.count("*") / per_anchor_panel).alias("cut")), "anchor-homes")
    of_label = panels(anchors.join(n, "home").withColumn("part", part(F.col("cut"))), d, depth)
    within = home.groupBy("home").agg(F.first("parts").alias("parts"))
    if d <= wide:
        # a home's row panels in groups, its anchor panels in groups; each group of the one meets each of the other
        most = _groups(n_panels, d, panel, 1, tasks)
        sizes = within.join(n, "home").select("home", F.least("parts", F.ceil(F.col("parts") * most / max(1, n_panels))).alias("of_rows"), F.ceil(F.col("cut") / ANCHOR_GROUP).alias("of_anchors"))
        named = lambda k: F.concat_ws("/", "home", k.cast("string"))
        left = of_label.join(sizes, "home").withColumn("group", F.pmod("part", "of_anchors")).withColumn("meet", F.explode(F.transform(upto(F.col("of_rows")), named)))
        right = blocks.join(sizes, "home").withColumn("meet", named(F.pmod("part", "of_rows"))).withColumn("group", F.explode(upto(F.col("of_anchors"))))
        alike = _met(left, right, _best_of_groups(n_positives, True))
    else:
        meet = F.explode(F.transform(upto(F.col("parts")), lambda k: F.concat_ws("/", "home", k.cast("string"))))
        alike = _added(partial_tiles(of_label.join(within, "home").withColumn("meet", meet), blocks.withColumn("meet", F.concat_ws("/", "home", F.col("part").cast("string")))), _best_alike(n_positives))
    positives = scratch.table(_best(alike, n_positives, "anchor_row"), "positives")

    wanted = positives.groupBy("anchor_row").agg(F.collect_list(F.struct("score", "row")).alias("wanted"))
    groups = max(1, math.ceil(wanted.count() / per_anchor_panel))
    asked = rows.join(wanted, F.col("row") == F.col("anchor_row")).select("row", "id", "label", "q", "wanted", F.lit("all").alias("home"), part(F.lit(groups)).alias("part"))
    asked = panels(asked, d, depth)
    if d <= wide:
        of_anchors = math.ceil(groups / ANCHOR_GROUP)
        of_rows = _groups(n_panels, d, panel, of_anchors, tasks)
        left = asked.withColumn("group", F.pmod("part", F.lit(of_anchors))).withColumn("meet", F.explode(upto(F.lit(of_rows))))
        right = blocks.withColumn("meet", F.pmod(F.xxhash64("home", "part"), F.lit(of_rows))).withColumn("group", F.explode(upto(F.lit(of_anchors))))
        other = _met(left, right, _best_of_groups(n_negatives, False))
    else:
        asked = asked.withColumn("meet", F.explode(upto(F.lit(max(1, n_panels)))))
        other = _added(partial_tiles(asked, blocks.withColumn("meet", F.pmod(F.xxhash64("home", "part"), F.lit(max(1, n_panels))))), _best_in_windows(n_negatives))
    best = _best(other, n_negatives, "anchor_row", "positive_row")
    ids = positives.select("anchor_row", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"))
    return best.join(ids, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
