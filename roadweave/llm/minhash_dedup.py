"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of shingles of five words (shorter texts: one shingle of all words). Darts are thrown at
each shingle: a Poisson process over (weight, rank), cut into weight slabs [0, 1), [1, 2), [2, 4), ..., each with arrivals
of its own from hashes of (shingle, slab, number), so the same darts fall in every document. A dart counts where its
weight coordinate is below the shingle's weight; it carries a hashed coordinate, and each coordinate keeps its earliest
dart. Two signatures agree in a coordinate with the probability of the weighted Jaccard similarity. Only about K log K
darts of a document are looked at, whatever its size.

Bands of ROWS coordinates bring documents together. Copies of a shingle set are one class. In every band bucket each
member is paired with the bucket's first class; pairs whose signatures agree enough (ESTIMATE) are verified by exact
similarity on the shingles, and make components. Then classes of a bucket that are still in different components are
paired and verified too, but for pairs that others of their block have joined already. So a bucket of thousands of near copies
costs a pair for each member and has fewer further links than members, and no link that would join two components is left out.

Scale: no list of pairs or links within a group of near copies, no cap on buckets; a bucket above TILE members is dealt as pairs of
tiles, and sketches of a byte for each coordinate are compared where they lie. The only quadratic case is a bucket with
many documents that are pairwise not similar though ROWS coordinates agree.

Classes are named by 128-bit hashes of their shingle sets until the end, so a doc_id that has several texts keeps the
links of each.

Defined results: null, empty and blank texts have no shingles and are classes of their own; repeated rows and copies share
a class; a null doc_id takes part, comes last in order, and names a class only if all its ids are null; one document of each
group, the smallest by doc_id and then by its text's key, is kept with its repeated rows; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.components import connected_components

from ._kit import Batches, Scratch, WordHashes, batches, fresh, id_text, mixed, pieces, text_key, window_hashes

SHINGLE = 5
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: Members of a bucket that a task holds of each side.
TILE = 2048
#: Share of agreeing coordinates below which a pair isn't verified: loses fewer pairs at 0.8 (1.6e-5) than the bands (7.3e-5).
ESTIMATE = 0.64
#: Stands for a null doc_id where texts are looked up.
NO_ID = -(2**63)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, cache: WordHashes, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = mixed(window_hashes(cache.of(words), min(n, len(words))))
    return np.unique(h, return_counts=True)


def uniforms(h: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), of 53 hashed bits."""
    with np.errstate(over="ignore"):
        return ((mixed(h ^ np.uint64(salt * 0xD1342543DE82EF95 & (2**64 - 1))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def darts(h: np.ndarray, weight: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, rank) of the darts with rank up to `until` that hit."""
    got_h, got_r = [], []
    slab, low, high = 0, 0.0, 1.0
    own, w = h, weight
    while len(own):
        live, rank, limit, number = own, np.zeros(len(own)), w, 0
        while len(live):
            columns = int(min(until * (high - low) * 1.1 + 4, 1 + 200_000 / len(live)))
            with np.errstate(over="ignore"):
                key = mixed(live[:, None] + GOLD * (np.arange(columns, dtype=np.uint64) + np.uint64(slab * 1_000_003 + number + 1)))
            ranks = rank[:, None] + np.cumsum(-np.log(uniforms(key, 1)), axis=1) / (high - low)
            hit = ranks <= until
            key, at = key[hit], ranks[hit]
            if limit.min() < high:
                inside = low + uniforms(key, 2) * (high - low) < np.repeat(limit, hit.sum(1))
                key, at = key[inside], at[inside]
            got_h.append(key)
            got_r.append(at)
            more = ranks[:, -1] <= until
            live, rank, limit, number = live[more], ranks[more, -1], limit[more], number + columns
        more = w > high
        own, w = own[more], w[more]
        slab, low, high = slab + 1, high, high * 2
    return np.concatenate(got_h), np.concatenate(got_r)


def signature(h: np.ndarray, weight: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart of each of k coordinates, 32 bits of its hash."""
    out = np.zeros(k, np.uint32)
    total = float(weight.sum())
    if total <= 0:
        return out
    until = (np.log(k) + 3.0) * k / total
    while True:
        dart, rank = darts(h, weight, until)
        place = ((dart >> np.uint64(7)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank))[::-1]
        best = np.full(k, -1)
        best[place[order]] = order  # the earliest is written last
        if (best >= 0).all():
            return (mixed(dart[best]) >> np.uint64(32)).astype(np.uint32)
        until *= 1.6


def signed_rows(weights: str):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("set", pa.binary()), ("size", pa.int64()), ("sketch", pa.binary()), ("bands", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        cache = WordHashes()
        last: dict[bytes, tuple[bytes, bytes]] = {}
        for b in pieces(parts):
            sets, sizes, out = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                h, n = shingles(text, cache)
                n = n if weights == "counts" else np.ones_like(n)
                name = xxhash.xxh3_128_digest(h.tobytes() + n.tobytes()) if len(h) else None
                if name and name not in last:
                    if len(last) > 20_000:
                        last.clear()
                    last[name] = sketch_and_bands(signature(h, n.astype(float)))
                sets.append(name)
                sizes.append(int(n.sum()))
                out.append(last[name] if name else (None, None))
            yield batches({"doc_id": b.column("doc_id"), "key": b.column("key"), "set": sets, "size": sizes, "sketch": [x for x, _ in out], "bands": [y for _, y in out]}, schema)

    return run


def sketch_and_bands(sign: np.ndarray) -> tuple[bytes, bytes]:
    """A byte of each coordinate; a 64-bit hash of each band."""
    rows = sign.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mixed(h * GOLD + rows[:, k].astype(np.uint64))
    return sign.astype(np.uint8).tobytes(), h.tobytes()


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def agreeing(parts: Iterator[pa.RecordBatch]) -> Batches:
    """Pairs whose sketches agree in ESTIMATE of the coordinates."""
    for b in pieces(parts, "sa", rows=8192):
        if b.num_rows:
            ok = pa.array((matrix(b.column("sa"), np.uint8, K) == matrix(b.column("sb"), np.uint8, K)).mean(1) >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], schema=LINK)


BLOCK = "bucket long, i int, j int, tile int, class binary, part binary, main binary, size long, sketch binary, bands binary"
LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])
PAIRS = "a binary, b binary"


def by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each block (bucket, i, j) of a partition sorted by block."""
    held, key = [], None
    for r in parts:
        keys = np.stack([r.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(keys)], strict=True):
            if lo == hi:
                continue
            if key != tuple(keys[lo]):
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                held, key = [], tuple(keys[lo])
            held.append(r.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def open_pairs(key: tuple, t: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): who may link across parts in a block, by sizes and sketches, each pair in the first band that it shares."""
    bucket, i, j = key
    col = lambda c: t.column(c).to_numpy()
    sketch, bands = (matrix(t.column(c), d, w) for c, d, w in (("sketch", np.uint8, K), ("bands", np.int64, BANDS)))
    size, tile = map(col, ("size", "tile"))
    names = [t.column(c).to_pylist() for c in ("class", "part", "main")]
    number = {x: k for k, x in enumerate(sorted(set().union(*names)))}
    cls, part, main = (np.array([number[x] for x in c]) for c in names)
    first = int(np.flatnonzero((bands == bucket).all(0))[0])
    for x in np.flatnonzero(part != main):
        y = np.flatnonzero((tile == (j if tile[x] == i else i)) & (part != part[x]) & ((part == main) | (cls > cls[x])))
        y = y[np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x])]
        y = y[(sketch[y] == sketch[x]).mean(1) >= ESTIMATE]
        y = y[~(bands[y, :first] == bands[x, :first]).any(1)]
        if len(y):
            yield int(x), y


def involved(least: float):
    """The rows of blocks that some open pair needs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for key, t in by_block(parts):
            used = np.zeros(t.num_rows, bool)
            for x, y in open_pairs(key, t, least):
                used[x] = used[y] = True
            if used.any():
                yield from t.filter(pa.array(used)).to_batches()

    return run


def linked(least: float):
    """Pairs of parts of blocks that join them as all open pairs of exact similarity `least` would; rows carry their shingles.

    A pair whose parts are already joined in its block decides nothing and isn't verified, so a block has fewer links than parts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for key, t in by_block(parts):
            part, hashes, counts = (t.column(c).to_pylist() for c in ("part", "hashes", "counts"))
            group = np.unique(np.array(part, object), return_inverse=True)[1]
            pairs = []
            for x, y in open_pairs(key, t, least):
                y = y[group[y] != group[x]]
                while len(y):
                    k, y = y[0], y[1:]
                    if alike(hashes[x], counts[x], hashes[k], counts[k], least):
                        pairs.append((part[x], part[k]))
                        group[group == group[k]] = group[x]
                        y = y[group[y] != group[x]]
            yield batches({"a": [min(p) for p in pairs], "b": [max(p) for p in pairs]}, LINK)

    return run


def stars(links: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of `links` (a, b), where a class b has BANDS heads a at most: each with its least head, and that with the others."""
    least = links.groupBy("b").agg(F.collect_set("a").alias("heads")).withColumn("a", F.array_min("heads"))
    return least.select("a", F.explode(F.concat("heads", F.array("b"))).alias("b")).where("a <> b").distinct()


def alike(ha: bytes, ca: bytes, hb: bytes, cb: bytes, least: float) -> bool:
    x, y = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
    if not ca and not cb:
        both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
        return both >= least * (len(x) + len(y) - both)
    n, m = (np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(h), np.int64) for c, h in ((ca, x), (cb, y)))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both >= least * (int(n.sum()) + int(m.sum()) - both)


def shingle_sets(classes: DataFrame, firsts: DataFrame, texts: DataFrame, weights: str) -> DataFrame:
    """(class, hashes, counts) of the classes; counts is empty where every one is 1. firsts: class, doc_id, key; texts: doc_id, key, text."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("class", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
        cache = WordHashes()
        for b in pieces(parts):
            got = [shingles(t, cache) for t in b.column("text").cast(pa.binary()).to_pylist()]
            plain = [n if weights == "counts" else np.ones_like(n) for _, n in got]
            yield batches({"class": b.column("class"), "hashes": [h.tobytes() for h, _ in got], "counts": [b"" if (n == 1).all() else n.astype(np.uint32).tobytes() for n in plain]}, schema)

    one = classes.distinct().join(firsts, "class")  # a row of the class: its text is read there
    return texts.join(one.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("class", "text").mapInArrow(sets, "class binary, hashes binary, counts binary")


def verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, least: float, weights: str, scratch: Scratch) -> DataFrame:
    """Pairs of classes with the components of those pairs (a: a head, b) whose exact similarity is at least `least`."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Batches:
        for b in parts:
            keep = pa.array([alike(*x, least) for x in zip(*(b.column(c).to_pylist() for c in ("ha", "ca", "hb", "cb")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=LINK)

    known = scratch.table(shingle_sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), firsts, texts, weights), "sets-first")
    left, right = known.toDF("a", "ha", "ca"), known.toDF("b", "hb", "cb")
    found = pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, PAIRS)
    found = scratch.table(stars(found), "links-first")
    scratch.drop("sets-first")
    return found


def near_duplicates(docs: DataFrame, least: float = 0.8, weights: str = "set") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group), kept and key (see _kit.text_key) of each row; weights: "set" (1 each) or "counts"."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = id_text(docs, text_key().alias("key"))
    rows = scratch.table(texts.mapInArrow(signed_rows(weights), "doc_id long, key binary, set binary, size long, sketch binary, bands binary"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    own = rows.where("set is not null").groupBy(F.col("set").alias("class")).agg(*(F.first(c).alias(c) for c in ("size", "sketch", "bands")), F.min(order).alias("first"))
    own = scratch.table(own, "own")
    firsts = own.select("class", "first.doc_id", "first.key")
    texts = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    firsts = firsts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))

    def listed(parts: Iterator[pa.RecordBatch]) -> Batches:
        for b in parts:
            yield batches({"bucket": matrix(b.column("bands"), np.int64, BANDS).ravel(), "class": b.column("class").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))}, pa.schema([("bucket", pa.int64()), ("class", pa.binary())]))

    buckets = own.select("class", "bands").mapInArrow(listed, "bucket long, class binary")
    heads = scratch.table(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("head")).where("n > 1"), "heads")
    crowded = scratch.table(buckets.join(heads, "bucket"), "crowded")

    def similar(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and sketches don't rule out."""
        info = own.select("class", "size", "sketch")
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        p = p.join(info.toDF("a", "na", "sa"), "a").where("na > 0").join(info.toDF("b", "nb", "sb"), "b")
        return p.where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b", "sa", "sb").mapInArrow(agreeing, PAIRS)

    first = scratch.table(similar(crowded.select(F.col("head").alias("a"), F.col("class").alias("b"))), "first")
    links = verified(first, firsts, texts, least, weights, scratch)
    parts = connected_components(links, "a", "b")
    # A head's pairs were tried. What else shares a bucket and is still apart is tried now; the largest part of a bucket
    # meets the others, never itself. No row is made for a pair, only for a member of a block and for a link that joins parts.
    placed = crowded.where("class <> head").join(parts.withColumnRenamed("node", "class"), "class", "left").select("bucket", "n", "class", F.coalesce("component", "class").alias("part"))
    placed = scratch.table(placed, "placed")
    counts = placed.groupBy("bucket", "part").agg(F.count("*").alias("m"))
    open_ = scratch.table(counts.groupBy("bucket").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main"), "open")
    placed = placed.join(open_, "bucket").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("class", "bucket"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumn("i", F.least("tile", "o")).withColumn("j", F.greatest("tile", "o"))
    full = placed.join(own, "class").select("bucket", "i", "j", "tile", "class", "part", "main", "size", "sketch", "bands")
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "class")
    second = scratch.table(dealt(full).mapInArrow(involved(least), BLOCK), "second")
    group = own.select("class", "first").join(parts.withColumnRenamed("node", "class"), "class", "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    if not second.isEmpty():
        known = scratch.table(shingle_sets(second.select("class"), firsts, texts, weights), "sets-second")
        more = dealt(second.join(known, "class").select(*second.columns, "hashes", "counts")).mapInArrow(linked(least), PAIRS)
        whole = connected_components(scratch.table(more.distinct(), "links-second"), "a", "b").toDF("component", "whole")
        group = group.join(whole, "component", "left").select("class", "first", F.coalesce("whole", "component").alias("component"))
    group = scratch.table(group, "groups")
    named = group.groupBy("component").agg(F.min("first").alias("name"))
    by_set = scratch.table(group.join(named, "component").select(F.col("class").alias("set"), "name"), "sets")
    scratch.drop("own", "heads", "crowded", "first", "links-first", "placed", "open", "second", "sets-second", "links-second", "groups")
    out = rows.join(by_set, "set", "left")
    class_id = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id"))
    kept = F.col("name").isNull() | (F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("key") == F.col("name.key")))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "key")


def one_of_each(docs: DataFrame, least: float = 0.8, weights: str = "set") -> DataFrame:
    """The rows of docs, with all their columns, that are kept; of repeated rows (doc_id and text) the first by its other columns.

    Texts move once, by (doc_id, key), to meet what is known of them; repeated rows are told apart where they then lie.
    """
    scratch = Scratch(docs.sparkSession, "one")
    seen = near_duplicates(docs, least, weights).groupBy("doc_id", "key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    seen = scratch.table(seen.where("not kept or n > 1"), "seen")
    i, key, kept, n, place = (fresh(docs, c) for c in ("_one_id", "_one_key", "_one_kept", "_one_n", "_one_place"))
    known = seen.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(i), F.col("key").alias(key), F.col("kept").alias(kept), F.col("n").alias(n))
    rows = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: text_key()}).join(known.hint("merge"), [i, key], "left")
    order = F.when(F.col(n) > 1, F.to_json(F.struct(*(F.col(c) for c in docs.columns))))
    rows = rows.where(F.coalesce(kept, F.lit(True))).withColumn(place, F.row_number().over(Window.partitionBy(i, key).orderBy(order)))
    return rows.where(F.col(place) == 1).select(*docs.columns)
