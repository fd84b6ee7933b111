"""Exact removal of repeated word windows by difference-cover anchors.

COVER is a difference cover modulo PERIOD: any two places have a shift below PERIOD that brings both to cover places. So
two equal windows of `window` words share an aligned anchor of window - PERIOD + 1 words at cover places, and hashing
anchors at cover places only (4 of 13) misses no match. Anchors that occur once in the corpus are out; those that occur
twice or more extend to the windows around them, and windows are matched by 96-bit hashes of all their words. A window is
marked unless it is the first of its sequence in the order (doc_id, start); every word in a marked window goes.

Scale: see _repeats. Copies of a whole text are told by its hash before anything is hashed by word, and only the first
takes part.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; repeated rows of one
doc_id and text are one document and get equal results; a null doc_id comes last in order; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kit import Batches, Scratch, WordHashes, batches, covered, mixed, pieces, window_hashes
from ._repeats import LAST, PACKET, TextTable, exchange, gathered, marked, marks_of, packets, repeated_anchors, stretches

PERIOD, COVER = 13, (0, 1, 3, 9)
ON_COVER = np.isin(np.arange(PERIOD), COVER)


def cover_anchors(window: int):
    """Places (words) and hashes of the anchors of a text."""
    cache = WordHashes()
    size = window - PERIOD + 1

    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(words) < window:
            return np.empty(0, np.int32), np.empty(0, np.uint64)
        h = mixed(window_hashes(cache.of(words), size))
        at = np.flatnonzero(ON_COVER[np.arange(len(h)) % PERIOD]).astype(np.int32)
        return at, h[at]

    return of


def later(e: dict[str, np.ndarray]) -> np.ndarray:
    """Entries that aren't the first of their sequence; a row that is there twice is the same entry."""
    doc_id, text = e["key"][e["doc"]].T
    return not_first(e["hash"], e["check"], doc_id, text, e["at"])


def not_first(hashes: np.ndarray, checks: np.ndarray, *places: np.ndarray) -> np.ndarray:
    order = np.lexsort((*places[::-1], checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.empty(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.empty(0, np.int64)
    out = np.zeros(len(h), bool)
    out[order] = np.logical_or.reduce([p[order] != p[order][first] for p in places])
    return out


def candidate_windows(texts: DataFrame, n: int, window: int) -> DataFrame:
    """Packets of the windows that hold a repeated anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        cache = WordHashes()
        for ids, hs, raw, (marks,) in stretches(parts, ("marks",)):
            doc, at, hashes, checks = [], [], [], []
            for d, (t, m) in enumerate(zip(raw, marks, strict=True)):
                h = cache.of(t.split())
                k = marked(m, len(h))
                w = len(h) - window + 1
                # window p holds the anchors at p ... p + PERIOD - 1
                sums = np.concatenate(([0], np.cumsum(k)))
                p = np.flatnonzero(sums[PERIOD : PERIOD + w] - sums[:w] > 0)
                doc.append(np.full(len(p), d, np.int32))
                at.append(p.astype(np.int32))
                hashes.append(mixed(window_hashes(h, window)[p]))
                checks.append((mixed(window_hashes(h, window, 0xC2B2AE3D27D4EB4F)[p]) >> np.uint64(32)).astype(np.uint32))
            doc, at, hashes, checks = map(np.concatenate, (doc, at, hashes, checks))
            keys = np.array([ids, hs], np.int64).T
            again = not_first(hashes, checks, keys[doc, 0], keys[doc, 1], at)
            k = np.flatnonzero(~again)
            yield packets(doc[k], at[k], hashes[k], checks[k], np.zeros(len(k), np.int32), keys, n, marks_of(doc[again], at[again], keys, n))

    return texts.mapInArrow(run, PACKET)


def facts(parts: Iterator[pa.RecordBatch]) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("text_sha", pa.binary()), ("all_sha", pa.string())])
    for b in pieces(parts):
        texts = b.column("text").to_pylist()
        words = [t.split() for t in texts]
        yield batches({"doc_id": b.column("doc_id"), "h": b.column("h"), "n_words": list(map(len, words)), "text_sha": [hashlib.sha256(t).digest() for t in texts], "all_sha": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]}, schema)


def remove_repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    def cut(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("cut", pa.int64()), ("cut_sha", pa.string())])
        for b in pieces(parts):
            out = []
            for text, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                words = text.split()
                gone = covered(np.flatnonzero(marked(m, len(words))), window, len(words))
                out.append((int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()))
            yield batches({"doc_id": b.column("doc_id"), "h": b.column("h"), "cut": [n for n, _ in out], "cut_sha": [s for _, s in out]}, schema)

    scratch = Scratch(docs.sparkSession, "windows")
    with TextTable(docs, scratch) as t:
        known = scratch.table(t.table.mapInArrow(facts, "doc_id long, h long, n_words long, text_sha binary, all_sha string"), "facts")
        first = known.groupBy("text_sha").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("text_sha", "f.doc_id", "f.h")
        firsts = scratch.table(known.where(F.col("n_words") >= window).join(first, ["text_sha", "doc_id", "h"]).select("doc_id", "h").distinct(), "firsts")
        reps = t.table.join(firsts, ["doc_id", "h"])
        anchors = scratch.table(gathered(repeated_anchors(reps, t.n, cover_anchors(window)), t.n), "anchors")
        windows = candidate_windows(t.table.join(anchors, ["doc_id", "h"]), t.n, window)
        marks = scratch.table(gathered(exchange(windows, t.n, later), t.n), "marks")
        trimmed = scratch.table(t.table.join(marks, ["doc_id", "h"]).mapInArrow(cut, "doc_id long, h long, cut long, cut_sha string").distinct(), "trimmed")
    scratch.drop("anchors", "marks")
    copy = known.join(firsts.withColumn("is_first", F.lit(True)), ["doc_id", "h"], "left").join(trimmed, ["doc_id", "h"], "left")
    lost = (F.col("n_words") >= window) & F.col("is_first").isNull()  # a copy of an earlier text
    nothing = hashlib.sha256(b"").hexdigest()
    return copy.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_words",
        F.when(lost, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(lost, nothing).otherwise(F.coalesce("cut_sha", "all_sha")).alias("kept_sha256"),
    )
