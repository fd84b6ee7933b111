"""Shared helpers of the text operators: scratch tables, whole-text Arrow streaming, word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.plans.scratch import Scratch  # noqa: F401

#: Rows and bytes of a table that a Python worker looks at together, however long an Arrow batch is; a longer row comes alone.
ROWS, BYTES = 256, 4 << 20
#: Words are maximal runs of anything but space and \x09-\x0D (the bytes that bytes.split() splits on).
WORD = "[^\\x20\\x09-\\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(parts: Iterator[pa.RecordBatch], column: str = "text", rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows and about `size` bytes of a string or binary column."""
    for b in parts:
        at = 0
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            below = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            end = min(at + rows, max(at + 1, below))
            yield b.slice(at, end - at)
            at = end


def id_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty), whatever further columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """16 bytes that tell texts apart (null is the empty text): with doc_id they name a document, repeated rows being one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


#: Bytes (or letters) of a word up to which workers keep what they know of it; longer ones are worked out each time.
KEPT_WORD = 64


class WordHashes(dict):
    """word -> 64-bit hash, filled on a miss; emptied when it holds `most` words of at most KEPT_WORD bytes (about 30 MB)."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: well-spread bits of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(h: np.ndarray, n: int, base: int = 0x9E6C63D0876A9A35) -> np.ndarray:
    """Polynomial hash of every n consecutive entries, by doubling; len(h) - n + 1 values."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out, at, p, power = None, 0, h.astype(np.uint64, copy=False), np.uint64(base)
    size, left = 1, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = p[at : at + m]
                out = part.copy() if out is None else out * power + part
                at += size
            left >>= 1
            if left:
                p = p[: len(p) - size] * power + p[size:]
                power = power * power
                size *= 2
    return out


def sliding_min_index(h: np.ndarray, n: int) -> np.ndarray:
    """Index of the smallest of every n consecutive entries, the leftmost of equals."""
    m = len(h) - n + 1
    at = np.arange(len(h), dtype=np.int64)
    size = 1
    while size * 2 <= n:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(h[b] < h[a], b, a)
        size *= 2
    a, b = at[:m], at[n - size : n - size + m]
    return np.where(h[b] < h[a], b, a)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the positions that lie in a window of `width` beginning at one of `starts`."""
    delta = np.bincount(starts, minlength=size + 1)[: size + 1].astype(np.int64)
    np.subtract.at(delta, np.minimum(starts + width, size), 1) if len(starts) else None
    return np.cumsum(delta[:size]) > 0


def batches(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


Batches = Iterator[pa.RecordBatch]
