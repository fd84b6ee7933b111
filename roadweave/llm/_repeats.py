"""What the two exact substring operators share: a bucketed text table, and which anchors of a corpus occur twice.

Text moves once: it is dealt by key into buckets and written, so that later joins by key leave it where it is. Everything
else travels as packets: packed numpy columns of a whole stretch of documents, one row for each bucket of hashes. Within a
stretch equal entries are settled on the spot and sent once, so a passage that a third of all documents hold reaches a
bucket once for each stretch, not once for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.plans.scratch import freed

from ._kit import Batches, Scratch, batches, mixed, pieces

#: Bytes of text that a worker gathers before it sends packets.
STRETCH = 12 << 20
#: Buckets of hashes for each partition, so that partitions come out alike; more would make more and smaller packets.
FINER = 4
#: Marks that a worker gathers from its buckets before it sends them.
TOGETHER = 1 << 20
#: A null doc_id, last in order.
LAST = 2**63 - 1
MARKS = "dest int, keys binary, counts binary, at binary"
MARKS_ARROW = pa.schema([("dest", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])


def parts_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class TextTable:
    """Distinct (doc_id, text) rows, bucketed by (doc_id, h); the table goes with the block that it is made for."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.spark, self.scratch, self.n = docs.sparkSession, scratch, parts_of(docs.sparkSession)
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
        self.name = f"roadweave_texts_{uuid.uuid4().hex}"

    def __enter__(self) -> TextTable:
        try:
            dealt = self.rows.repartition(self.n, "doc_id", "h")
            with freed(self.spark):
                dealt.write.option("path", f"{self.scratch.base}/texts").option("compression", "zstd").bucketBy(self.n, "doc_id", "h").sortBy("doc_id", "h").saveAsTable(self.name)
            self.table = self.spark.table(self.name)
        except BaseException:
            self.__exit__()
            raise
        return self

    def __exit__(self, *error) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("texts")


def stretches(parts: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ()) -> Iterator[tuple[list, list, list[bytes], list]]:
    """doc_ids, hashes, texts and further columns of about STRETCH bytes at a time."""
    ids, hs, texts, more, size = [], [], [], [[] for _ in columns], 0
    for b in pieces(parts):
        ids += b.column("doc_id").to_pylist()
        hs += b.column("h").to_pylist()
        new = b.column("text").to_pylist()
        texts += new
        for m, c in zip(more, columns, strict=True):
            m += b.column(c).to_pylist()
        size += sum(map(len, new))
        if size >= STRETCH:
            yield ids, hs, texts, more
            ids, hs, texts, more, size = [], [], [], [[] for _ in columns], 0
    if ids:
        yield ids, hs, texts, more


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and its entries in order."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    yield from zip(used.tolist(), np.split(order, first[1:]) if len(used) else (), strict=True)


def marks_of(doc: np.ndarray, at: np.ndarray, keys: np.ndarray, n: int) -> dict[str, list]:
    """Rows of MARKS: marked places, those of a document together, documents dealt to n parts by key.

    doc: each place's document, a row of keys (doc_id, h); at: int32, or more than one for each place.
    """
    out: dict[str, list] = {f.name: [] for f in MARKS_ARROW}
    if not len(doc):
        return out
    used, doc = np.unique(doc, return_inverse=True)
    key = keys[used]
    dest = (mixed(key[:, 0].astype(np.uint64) ^ mixed(key[:, 1].astype(np.uint64))) % np.uint64(n)).astype(np.int64)
    rank = np.empty(len(key), np.int64)
    rank[np.argsort(dest, kind="stable")] = np.arange(len(key))
    order = np.argsort(rank[doc], kind="stable")
    at = at.astype(np.int32)[order]
    by_rank = np.argsort(rank)
    counts = np.bincount(rank[doc], minlength=len(key)).astype(np.int32)
    parts, start = np.unique(dest[by_rank], return_index=True)
    first = np.concatenate(([0], np.cumsum(counts)))
    for d, lo, hi in zip(parts.tolist(), start, np.append(start[1:], len(key)), strict=True):
        for name, v in zip(out, (d, key[by_rank[lo:hi]].tobytes(), counts[lo:hi].tobytes(), at[first[lo] : first[hi]].tobytes()), strict=True):
            out[name].append(v)
    return out


def gathered(marks: DataFrame, n: int, width: int = 1) -> DataFrame:
    """(doc_id, h, marks): all places of each document; width: numbers for each place."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("marks", pa.binary())])
        held: dict[tuple[int, int], list[bytes]] = {}
        dest = None

        def flush() -> pa.RecordBatch:
            return batches({"doc_id": [k[0] for k in held], "h": [k[1] for k in held], "marks": [b"".join(v) for v in held.values()]}, schema)

        for b in parts:
            for r in b.to_pylist():
                if r["dest"] != dest and held:
                    yield flush()
                    held.clear()
                dest = r["dest"]
                ends = np.cumsum(np.frombuffer(r["counts"], np.int32)) * 4 * width
                start = 0
                for key, end in zip(np.frombuffer(r["keys"], np.int64).reshape(-1, 2).tolist(), ends.tolist(), strict=True):
                    held.setdefault(tuple(key), []).append(r["at"][start:end])
                    start = end
        if held:
            yield flush()

    return marks.repartition(n, "dest").sortWithinPartitions("dest").mapInArrow(run, "doc_id long, h long, marks binary")


#: kind 0: entries of a bucket of hashes; kind 1: places that are settled already, bucket being their part; kind 2: entries of another sort.
PACKET = "bucket int, kind int, at binary, docs binary, hashes binary, checks binary, own binary"
PACKET_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("at", "docs", "hashes", "checks", "own"))])


def add(rows: dict[str, list], *cells) -> None:
    for name, v in zip(rows, cells, strict=True):
        rows[name].append(v)


def add_settled(rows: dict[str, list], marks: dict[str, list]) -> None:
    for d, keys, counts, at in zip(*marks.values(), strict=True):
        add(rows, d, 1, at, keys, None, None, counts)


def packets(doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None, multi: np.ndarray, keys: np.ndarray, n: int, settled: dict) -> pa.RecordBatch:
    """Entries (document, place, hash, check, whether the stretch holds it twice), and places that are settled already."""
    rows: dict[str, list] = {f.name: [] for f in PACKET_ARROW}
    add_entries(rows, 0, doc, at, hashes, checks, multi, keys, n)
    add_settled(rows, settled)
    return batches(rows, PACKET_ARROW)


def add_entries(rows: dict[str, list], kind: int, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None, multi: np.ndarray, keys: np.ndarray, n: int) -> None:
    for b, k in by_bucket(bucket_of(hashes, FINER * n)):
        used, local = np.unique(doc[k], return_inverse=True)
        add(rows, b, kind, at[k].astype(np.int32).tobytes(), keys[used].tobytes(), hashes[k].tobytes(), checks[k].tobytes() if checks is not None else b"", (local.astype(np.int32) << 1 | multi[k]).astype(np.int32).tobytes())


def grouped_packets(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], pa.RecordBatch | None]]:
    """The packets (not of kind 1) of each bucket of a partition sorted by bucket, and settled rows, as rows of MARKS, as they come."""
    held, bucket = [], None
    for b in parts:
        done = b.filter(pa.compute.equal(b.column("kind"), 1)) if b.num_rows else b
        if done.num_rows:
            yield [], pa.RecordBatch.from_arrays([done.column(c) for c in ("bucket", "docs", "own", "at")], schema=MARKS_ARROW)
        for r in b.filter(pa.compute.not_equal(b.column("kind"), 1)).to_pylist():
            if r["bucket"] != bucket and held:
                yield held, None
                held = []
            bucket = r["bucket"]
            held.append(r)
    if held:
        yield held, None


def unpacked(held: list[dict]) -> dict[str, np.ndarray]:
    keys = [np.frombuffer(r["docs"], np.int64).reshape(-1, 2) for r in held]
    own = [np.frombuffer(r["own"], np.int32) for r in held]
    start = np.cumsum([0, *map(len, keys)])
    own = np.concatenate([o.astype(np.int64) + (2 * s) for o, s in zip(own, start, strict=False)])
    key = np.concatenate(keys)
    out = {"at": np.concatenate([np.frombuffer(r["at"], np.int32) for r in held]), "hash": np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held]), "doc": own >> 1, "multi": (own & 1).astype(bool), "key": key}
    if held[0]["checks"]:
        out["check"] = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in held])
    return out


#: The part of rows that tell of hot hashes: `at` has the hashes, `counts` how often they occur.
HOT_ROWS = -1


def exchange(rows: DataFrame, n: int, resolve: Callable[[dict[str, np.ndarray]], np.ndarray], hot: int | None = None) -> DataFrame:
    """Rows of MARKS from packets: resolve says which entries of a bucket are marked. With `hot`, checks are counts, and hashes that occur more often are told too."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for held, done in grouped_packets(parts):
            if done is not None:
                yield done
                continue
            e = unpacked(held)
            hit = resolve(e)
            if hot is not None:
                own, which = np.unique(e["hash"], return_inverse=True)
                total = np.bincount(which, weights=e["check"]).astype(np.int64)
                if (total > hot).any():
                    yield batches({"dest": [HOT_ROWS], "keys": [b""], "counts": [total[total > hot].tobytes()], "at": [own[total > hot].tobytes()]}, MARKS_ARROW)
            if hit.any():
                used, doc = np.unique(e["doc"][hit], return_inverse=True)
                waiting.append((e["key"][used], doc.ravel(), e["at"][hit]))
                if sum(len(w[1]) for w in waiting) >= TOGETHER:
                    yield sent(waiting)
                    waiting.clear()
        if waiting:
            yield sent(waiting)

    def sent(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """The marks of several buckets, a row for each part that they go to; a key's copies in several packets are one document."""
        before = np.cumsum([0, *(len(w[0]) for w in waiting)])
        keys, doc = np.unique(np.concatenate([w[0] for w in waiting]), axis=0, return_inverse=True)
        at = np.concatenate([w[1] + b for w, b in zip(waiting, before, strict=False)])
        return batches(marks_of(doc.ravel()[at], np.concatenate([w[2] for w in waiting]), keys, n), MARKS_ARROW)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)


def twice(e: dict[str, np.ndarray]) -> np.ndarray:
    """Entries whose hash occurs elsewhere."""
    return elsewhere(e["hash"]) & ~e["multi"]  # those are settled where they were found


def elsewhere(*keys: np.ndarray) -> np.ndarray:
    """Entries whose keys all occur elsewhere too."""
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(order), bool)
    out[order] = hit
    return out


def repeated_anchors(texts: DataFrame, n: int, anchors: Callable[[bytes], tuple[np.ndarray, np.ndarray]], hot: int | None = None) -> DataFrame:
    """Rows of MARKS: the anchor places whose hash occurs twice or more in the corpus; with `hot`, rows of hot hashes too."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for ids, hs, raw, _ in stretches(parts):
            doc, at, hashes = [], [], []
            for d, t in enumerate(raw):
                a, h = anchors(t)
                doc.append(np.full(len(a), d, np.int32))
                at.append(a)
                hashes.append(h)
            doc, at, hashes = np.concatenate(doc), np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            s = hashes[order]
            new = np.append(True, s[1:] != s[:-1]) if len(s) else np.empty(0, bool)
            size = np.diff(np.append(np.flatnonzero(new), len(s)))
            many = np.repeat(size > 1, size)
            keys = np.array([ids, hs], np.int64).T
            settled = marks_of(doc[order[many]], at[order[many]], keys, n)
            k = order[new]
            counts = None if hot is None else np.minimum(size, 2**32 - 1).astype(np.uint32)
            yield packets(doc[k], at[k], hashes[k], counts, many[new].astype(np.int32), keys, n, settled)

    return exchange(texts.mapInArrow(run, PACKET), n, twice, hot)


def hot_hashes(marks: DataFrame, most: int) -> np.ndarray:
    """The sorted hashes that rows of MARKS tell of, the `most` commonest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for b in parts:
            for at, counts in zip(b.column("at").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield batches({"hash": np.frombuffer(at, np.int64), "n": np.frombuffer(counts, np.int64)}, pa.schema([("hash", pa.int64()), ("n", pa.int64())]))

    told = marks.where(F.col("dest") == HOT_ROWS).select("at", "counts").mapInArrow(run, "hash long, n long")
    return np.sort(told.orderBy(F.desc("n"), "hash").limit(most).select("hash").toArrow().column("hash").to_numpy().view(np.uint64))


def marked(places: bytes, size: int) -> np.ndarray:
    """Mask of the marked places."""
    out = np.zeros(size, bool)
    out[np.frombuffer(places, np.int32)] = True
    return out
