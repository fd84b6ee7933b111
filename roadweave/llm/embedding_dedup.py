"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

Each distinct vector of a label is rotated pseudo-randomly (sign flips and fast Hadamard transforms, three times); a hash
is the signed axis nearest to the result, a bucket joins HASHES hashes, and the next nearest axes give further probes.
Vectors that share a bucket are compared in double precision, block by block. A pair that meets in several buckets counts
in the first only. Buckets give counts of links and a spanning set of edges, never lists of all pairs.

Scale: equal vectors are collapsed first, and copies are counted from their number. Bucket sizes are counted before any
vector moves; buckets of one are left out, and a bucket above TILE rows is dealt as pairs of tiles over many tasks, so no
task holds more than 2 x TILE of its vectors. The work on a bucket of distinct vectors that are all alike is quadratic in
their number, as exact link counts ask for; what is written stays linear for each pair of tiles.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label,
link with nothing (0 links, a component of their own); vectors of different lengths never link; rows that repeat an id
count as vectors; vectors without an id take part and come last (their component is null if all its ids are, kept is false); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators.components import connected_components

from ._kit import Batches, Scratch, batches, mixed

TABLES, HASHES, PROBES = 6, 2, 2
TILE = 1024
#: Stands for a null vec_id, last in order.
LAST = 2**63 - 1
PAIRS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_codes(x: np.ndarray, salt: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(row, table x (1 + probes)) 64-bit buckets; salt: a value of each row that keeps labels apart."""
    n, d = x.shape
    size = 1 << max(1, int(d - 1).bit_length())
    base = np.zeros((n, size))
    base[:, :d] = x
    draw = np.random.default_rng(seed)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        home, second, gap = [], [], []
        for _ in range(hashes):
            y = base
            for _ in range(3):
                y = hadamard(y * draw.choice((-1.0, 1.0), size))
            best = np.argpartition(-np.abs(y), 2, axis=1)[:, :3] if size > 3 else np.argsort(-np.abs(y), axis=1)[:, :3]
            value = np.take_along_axis(y, best, 1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            axis = (2 * best + (value < 0)).astype(np.uint64)
            home.append(axis[:, 0])
            for k in range(1, axis.shape[1]):  # next axes of this hash, nearest first over all hashes
                second.append((len(home) - 1, axis[:, k]))
                gap.append(np.abs(value[:, 0]) - np.abs(value[:, k]))
        def code(parts, t=t):  # noqa: E306
            h = salt.astype(np.uint64) + np.uint64(t * 0x51ED2701)
            for p in parts:
                h = mixed(h * np.uint64(0x100000001B3) + p)
            return h
        out[:, t, 0] = code(home)
        options = np.stack([code([alt if k == j else home[k] for k in range(hashes)]) for j, alt in second], axis=1)
        nearest = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")[:, :probes]
        got = np.take_along_axis(options, nearest, 1)
        out[:, t, 1:] = np.pad(got, ((0, 0), (0, probes - got.shape[1])), mode="edge") if got.shape[1] < probes else got
    return out.reshape(n, -1).view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(parts: Iterator[pa.RecordBatch]) -> Batches:
    schema = pa.schema([("rep", pa.int64()), ("codes", pa.list_(pa.int64()))])
    for b in parts:
        size = b.column("size").to_numpy()
        salt = b.column("salt").to_numpy()
        rep = b.column("rep").to_numpy()
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            x = unit(matrix(b.column("x").take(pa.array(at))))
            yield batches({"rep": rep[at], "codes": list(bucket_codes(x, salt[at]))}, schema)


def link_blocks(least: float):
    """Counts of links and spanning edges of each block (bucket, i, j); rows come sorted by block."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def block(bucket: int, own: bool, rep: np.ndarray, n: np.ndarray, first: np.ndarray, x: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
        a, b = (np.arange(len(rep)), np.arange(len(rep))) if own else (np.flatnonzero(first), np.flatnonzero(~first))
        u = unit(x)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        step = max(1, (1 << 22) // max(1, len(b)))
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            i, j = np.nonzero(u[rows] @ u[b].T >= least)
            i, j = rows[i], b[j]
            i, j = (i[i < j], j[i < j]) if own else (i, j)
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                new = np.ones(len(p), bool)
                for t in range(codes.shape[1]):  # a pair counts in its least shared bucket
                    live = np.flatnonzero(new & (codes[p, t] < bucket))
                    new[live[(codes[p[live], t][:, None] == codes[q[live]]).any(1)]] = False
                links += np.bincount(p[new], weights=n[q[new]], minlength=len(rep)).astype(np.int64)
                links += np.bincount(q[new], weights=n[p[new]], minlength=len(rep)).astype(np.int64)
            while len(i):  # least labels within the block
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (before == root).all():
                    break
        return {"rep": rep, "links": links, "root": rep[root]}

    return schema, block


def grouped(least: float):
    """Runs link_blocks over partitions whose rows are sorted by (bucket, i, j)."""
    schema, block = link_blocks(least)

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Batches:
            t = pa.Table.from_batches(held).combine_chunks()
            bucket, i, j = key
            col = lambda c: t.column(c).to_numpy()
            chunk = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
            codes = chunk("codes").flatten().to_numpy().reshape(t.num_rows, -1)
            sizes = col("size")
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                x = matrix(chunk("x").take(pa.array(at)))
                yield batches(block(bucket, i == j, col("rep")[at], col("n")[at], (col("tile") == i)[at], x, codes[at]), schema)

        for b in parts:
            keys = np.stack([b.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(keys)], strict=True):
                if lo == hi:
                    continue
                if key != tuple(keys[lo]):
                    if held:
                        yield from flush()
                    held, key = [], tuple(keys[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()

    return run


def link_vectors(vectors: DataFrame, least: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    big = F.array_max(F.transform("x", F.abs))
    sound = F.col("label").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull()) & (big > 0) & (big < float("inf")) & ~F.exists("x", F.isnan)
    v = v.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), F.md5(F.concat_ws("|", "label", F.array_join(F.transform("x", lambda c: (c + 0.0).cast("string")), ",")))))
    members = scratch.table(v.select("vec_id", "vector"), "members")
    reps = members.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    reps = v.where("vector is not null").join(reps, ["vector", "vec_id"]).dropDuplicates(["vector"])
    rep = F.monotonically_increasing_id()  # names a distinct vector, from this table's writing on
    reps = scratch.table(reps.select(rep.alias("rep"), "vector", "vec_id", "n", "x", F.size("x").alias("size"), F.xxhash64("label").alias("salt")), "reps")
    codes = scratch.table(reps.select("rep", "x", "size", "salt").mapInArrow(hashed, "rep long, codes array<long>"), "codes")
    places = codes.select("rep", F.explode(F.array_distinct("codes")).alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("in")).where("in > 1").select("bucket", F.ceil(F.col("in") / tile).cast("int").alias("tiles"))
    sizes = scratch.table(sizes, "sizes")
    places = places.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep", "bucket"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = places.withColumn("o", other).select("rep", "bucket", "tile", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"))
    full = dealt.join(reps.select("rep", "n", "x", "size"), "rep").join(codes, "rep").select("bucket", "i", "j", "tile", "rep", "n", "size", "x", "codes")
    blocks = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    found = scratch.table(blocks.mapInArrow(grouped(least), "rep long, links long, root long").where("links > 0 or root <> rep"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # Components are of distinct vectors, so an id that has several keeps the links of each.
    parts = connected_components(found.where("root <> rep").select("rep", "root").distinct(), "rep", "root")
    whole = reps.select("vector", "vec_id", "n", "rep").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = scratch.table(whole.select("vector", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    names = whole.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    whole = whole.join(names, "component").select("vector", "n_links", "component_id")
    out = members.join(scratch.table(whole, "whole"), "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.select(F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "n_links", F.nullif("component_id", F.lit(LAST)).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
