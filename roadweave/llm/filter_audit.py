"""Filter interaction audit: what each of five filters removes in each of their 120 orders, by first-failure lookup.

A document's failures are five bits. For a mask and an order, the step of the first failing filter is looked up in a table
of 32 x 120 that is made once; np.bincount adds up (part, label, order, step) of a batch in one go, and each task sends one
small array of sums for each part it has seen, which Spark adds up. Which filter removes a document, which failures come too
late (redundant), and the sum of removals over all orders (the Shapley value times 120) all follow from these counts.

Filters: A under 200 words; B under half of the words distinct; C over 2 % of the code points in A-Z; D holds one of
#$%&*|; E the same text stands at a smaller doc_id somewhere in the table. A to D are told from each whole text where it is
read, once; E from the least doc_id of each SHA-256, so only ids, masks and hashes are written and shuffled. Rows of one
text are summed before they meet; the least id goes back by a join on the hash, which adaptive execution splits where one
text has very many rows. A part is never gathered: a task holds at most PARTS of them, and sends what it has when there are more.

Defined results: a null text is the empty text (fails A, nothing else unless repeated; 0 words are not under half distinct);
a null source is part ''; a row without doc_id has no label and never fails E, as no id is smaller;
rows that repeat one doc_id are documents of their own and not copies of each other, unless a smaller id has their text;
a document with several label rows is good or toxic if any says so; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kit import Batches, Scratch, batches, id_text, pieces

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
#: Parts that a task adds up at once, before it sends its sums.
PARTS = 256
#: Rows of a lookup at once: 120 steps each.
ROWS = 1 << 14
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
MARKS = np.frombuffer(b"#$%&*|", np.uint8)

#: For each mask and order the step (from 0) of the first failing filter; STEPS where none fails.
_PLACE = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
FIRST = np.array([[min([p for k, p in enumerate(places) if mask >> k & 1], default=STEPS) for places in _PLACE.tolist()] for mask in range(1 << STEPS)], np.int64)
#: For each order and step the filter.
AT = np.argsort(_PLACE, axis=1)
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: bytes) -> int:
    """Bits of the filters that one text decides: A, B, C, D."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, points = int(counts[65:91].sum()), len(text) - int(counts[128:192].sum())
    return (n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * upper > MOST_UPPER * points) << 2 | bool(counts[MARKS].any()) << 3


def _judge(parts: Batches) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("hash", pa.binary())])
    for b in pieces(parts):
        texts = [t.as_buffer() for t in b.column("text").cast(pa.large_binary())]
        yield batches({"doc_id": b.column("doc_id"), "part": b.column("part"), "mask": [own_failures(t.to_pybytes()) for t in texts], "hash": [hashlib.sha256(t).digest() for t in texts]}, schema)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document; the lowest bit is A."""
    rows = id_text(docs.withColumn("part", F.coalesce(F.col("source").cast("string"), F.lit(""))), "part")
    judged = Scratch(docs.sparkSession, "audit").table(rows.mapInArrow(_judge, "doc_id long, part string, mask int, hash binary"), "judged")
    again = judged.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("hash", "least")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return judged.join(again, "hash", "left").select("doc_id", "part", (F.col("mask") + F.when(late, 1 << 4).otherwise(0)).alias("mask"))


def sums(mask: np.ndarray, label: np.ndarray, part: np.ndarray, n_parts: int) -> np.ndarray:
    """(part, order, step, SUMS) of documents with these masks, labels (1: good, 2: toxic, 3: both) and parts."""
    by = np.zeros((n_parts, 4, len(ORDERS), STEPS + 1), np.int64)
    fails = np.zeros((n_parts, 1 << STEPS), np.int64)
    offset = np.arange(len(ORDERS)) * (STEPS + 1)
    for at in range(0, len(mask), ROWS):
        m, group = mask[at : at + ROWS], part[at : at + ROWS] * 4 + label[at : at + ROWS]
        cell = (group[:, None] * len(ORDERS)) * (STEPS + 1) + offset + FIRST[m]
        by += np.bincount(cell.ravel(), minlength=by.size).reshape(by.shape)
        fails += np.bincount(part[at : at + ROWS] << STEPS | m, minlength=fails.size).reshape(fails.shape)
    gone, masks = by.sum(1), np.arange(1 << STEPS)
    removed = gone[..., :STEPS]
    kept = gone.sum(2, keepdims=True) - np.cumsum(removed, axis=2)
    failing = np.stack([fails[:, masks >> f & 1 == 1].sum(1) for f in range(STEPS)], axis=1)
    alone = fails[:, 1 << np.arange(STEPS)]
    shapley = np.zeros((n_parts, STEPS), np.int64)
    for f in range(STEPS):
        shapley[:, f] = np.where(AT == f, removed, 0).sum((1, 2))
    good, toxic = by[:, 1] + by[:, 3], by[:, 2] + by[:, 3]
    return np.stack([kept, removed, failing[:, AT] - removed, alone[:, AT], good[..., :STEPS], toxic[..., :STEPS], shapley[:, AT]], axis=-1)


def _accumulate(batch_iter: Batches) -> Batches:
    schema = pa.schema([("part", pa.string()), ("place", pa.int32()), *((c, pa.int64()) for c in SUMS)])
    seen: dict[str, int] = {}
    total = np.zeros((PARTS, len(ORDERS), STEPS, len(SUMS)), np.int64)

    def sent() -> Iterator[pa.RecordBatch]:
        for name, k in seen.items():
            cells = total[k].reshape(-1, len(SUMS))
            yield batches({"part": [name] * len(cells), "place": np.arange(len(cells), dtype=np.int32), **dict(zip(SUMS, cells.T, strict=True))}, schema)
        seen.clear()
        total[:] = 0

    for b in batch_iter:
        names = b.column("part").dictionary_encode()
        own, codes = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        mask, label = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "label"))
        for at in range(0, len(own), PARTS):
            some = own[at : at + PARTS]
            if len(seen.keys() | set(some)) > PARTS:
                yield from sent()
            here = (codes >= at) & (codes < at + PARTS)
            found = sums(mask[here], label[here], codes[here] - at, len(some))
            total[[seen.setdefault(n, len(seen)) for n in some]] += found
    yield from sent()


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of SUMS."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    label = F.coalesce(F.col("good").cast("int") + 2 * F.col("toxic").cast("int"), F.lit(0))
    rows = failures(docs).join(known, "doc_id", "left").select("part", "mask", label.alias("label"))
    parts = rows.mapInArrow(_accumulate, "part string, place int, " + ", ".join(f"{c} long" for c in SUMS))
    total = parts.groupBy("part", "place").agg(*(F.sum(c).alias(c) for c in SUMS))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("place") / STEPS) + 1).cast("int"))
    return total.select("part", order.alias("filter_order"), (F.col("place") % STEPS + 1).cast("int").alias("step"), *SUMS)
