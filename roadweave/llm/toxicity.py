"""Toxicity: a factorisation machine over hashed terms.

Terms of a text are its lower-cased words, without marks at their ends, and the words' first 3 to 6 and last 4 letters,
hashed into BUCKETS. In a bounded sample of labelled rows the documents of each class that hold a bucket are counted in the
cluster, and the KEEP buckets whose frequencies differ most between the classes (z of 3 at least) are kept. Words that say
nothing alone may say much together, so of the PAIRED whole words that divide the sample most evenly all pairs are compared:
where two words go together in one class but not in the other (z of PAIR_Z at least), both are kept too. Linear weights and
FACTORS-dimensional factors are fitted to all of them by AdaGrad, so that pairs of terms have a weight of their own. The model is a table of at most KEEP rows, whatever the size of the corpus; every whole text
of the corpus is scored in one pass without a shuffle.

The sample: at most `fit_rows` labelled documents of each class, those with the smallest hash of doc_id. Rows of one label
whose whole term sets are equal count once; everything else stays: near copies, and equal texts of different labels. What
reaches the driver is bounded: KEEP buckets, and of each sampled document the kept and the PAIRED buckets it holds, two bytes each.

Defined results: null and empty texts have no terms and get the score of the intercept; repeated rows give repeated rows;
a null doc_id is kept, is not held out and has no label; without labelled rows of both classes every score is 0 and predicted 0; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kit import KEPT_WORD, Batches, Scratch, batches, id_text, pieces
from .quality import held_out

BUCKETS = 1 << 20
KEEP = 4096
FACTORS = 8
#: Whole words whose pairs are compared, the words that this may add, and the z from which a pair counts.
PAIRED, ADDED, PAIR_Z = 1024, 256, 6.0
ENDS = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"


def word_terms(word: str) -> set[int]:
    w = word.strip(ENDS)
    if not w:
        return set()
    parts = {"w" + w, *(f"{n}" + w[:n] for n in (3, 4, 5, 6) if len(w) >= n), "e" + w[-4:]}
    return {2 * (xxhash.xxh32_intdigest(p.encode()) % (BUCKETS // 2)) + (p[0] != "w") for p in parts}  # whole words are even


class Terms(dict):
    """word -> what `of` makes of its terms; emptied when full; long words are not kept."""

    def __init__(self, of, most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        out = self.of(word_terms(word))
        if len(word) <= KEPT_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    buckets: np.ndarray  # sorted buckets of the terms it knows
    w: np.ndarray
    v: np.ndarray

    def logit(self, known: list[int]) -> float:
        if not known:
            return self.bias
        k = np.fromiter(known, np.int64, len(known))
        v = self.v[k]
        return float(self.bias + self.w[k].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum())


def fit_machine(rows: list[np.ndarray], label: np.ndarray, buckets: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> FactorisationMachine | None:
    """Of rows of places in `buckets`; None unless both classes occur."""
    y = label.astype(float)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return None
    draw = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(buckets)), draw.normal(0, 0.01, (len(buckets), FACTORS)), float(np.log(n1 / n0))
    gw, gv, gb = np.full(len(w), 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = [k for k in order[at : at + 64]]
            flat = np.concatenate([rows[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(rows[k]) for k in part])
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, row, v[flat])
            squares = np.bincount(row, weights=(v[flat] ** 2).sum(1), minlength=len(part))
            logit = bias + np.bincount(row, weights=w[flat], minlength=len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[part]) / len(part)
            dw, dv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(dw, flat, g[row])
            np.add.at(dv, flat, g[row, None] * (sums[row] - v[flat]))
            hit = np.unique(flat)
            dw, dv = dw[hit] + decay * w[hit], dv[hit] + decay * v[hit]
            gw[hit] += dw**2
            gv[hit] += dv**2
            gb += g.sum() ** 2
            w[hit] -= rate * dw / np.sqrt(gw[hit])
            v[hit] -= 0.2 * rate * dv / np.sqrt(gv[hit])
            bias -= 0.2 * rate * g.sum() / np.sqrt(gb)
    return FactorisationMachine(bias, buckets, w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(label, terms: sorted 4-byte buckets) of the sample; rows of one label with equal term sets once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("label = 0").orderBy("h", "doc_id").limit(fit_rows).unionAll(known.where("label = 1").orderBy("h", "doc_id").limit(fit_rows)).drop("h")

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        cache = Terms(tuple)
        schema = pa.schema([("label", pa.int32()), ("terms", pa.binary())])
        for b in pieces(parts):
            terms = [np.unique(np.fromiter({t for w in set(x.lower().split()) for t in cache[w]}, np.int32)).tobytes() for x in b.column("text").to_pylist()]
            yield batches({"label": b.column("label"), "terms": terms}, schema)

    return id_text(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "label int, terms binary").distinct()  # at most 2 x fit_rows rows are sent


def bucket_counts(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """((bucket, d0, d1): documents of each class that hold it, documents of class 0, of class 1)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("label", pa.int32()), ("bucket", pa.int32())])
        for b in pieces(parts, "terms"):
            for label, terms in zip(b.column("label").to_pylist(), b.column("terms").to_pylist(), strict=True):
                t = np.frombuffer(terms, np.int32)
                yield batches({"label": np.full(len(t), label, np.int32), "bucket": t}, schema)

    n = sample.agg(F.count_if(F.expr("label = 0")).alias("n0"), F.count_if(F.expr("label = 1")).alias("n1")).first()
    df = sample.mapInArrow(run, "label int, bucket int").groupBy("bucket").agg(F.count_if(F.expr("label = 0")).alias("d0"), F.count_if(F.expr("label = 1")).alias("d1"))
    return df, n.n0, n.n1


def chosen_buckets(sample: DataFrame, keep: int = KEEP - ADDED, least: int = 3, z: float = 3.0) -> np.ndarray:
    """Sorted buckets whose document frequencies differ between the classes, the `keep` with the largest z."""
    df, n0, n1 = bucket_counts(sample)
    if not n0 or not n1:
        return np.empty(0, np.int64)
    p = (F.col("d0") + F.col("d1")) / (n0 + n1)
    gap = F.abs(F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    best = df.where(F.col("d0") + F.col("d1") >= least).withColumn("z", gap).where(F.col("z") >= z).orderBy(F.desc("z"), "bucket").limit(keep)
    return np.sort(best.select("bucket").toArrow().column("bucket").to_numpy()).astype(np.int64)


def places_in(sample: DataFrame, buckets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each document of the sample which of these buckets it holds, and its label; in one order whatever order rows come in."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for b in pieces(parts, "terms"):
            found = [np.isin(buckets, np.frombuffer(t, np.int32)) for t in b.column("terms").to_pylist()]
            yield batches({"label": b.column("label"), "places": [np.flatnonzero(f).astype(np.uint16).tobytes() for f in found]}, pa.schema([("label", pa.int32()), ("places", pa.binary())]))

    got = sample.mapInArrow(run, "label int, places binary").toArrow()
    rows = sorted(zip(got.column("label").to_pylist(), got.column("places").to_pylist(), strict=True))
    return [np.frombuffer(p, np.uint16).astype(np.int64) for _, p in rows], np.array([y for y, _ in rows], np.int64)


def paired_buckets(sample: DataFrame, paired: int = PAIRED, added: int = ADDED, z: float = PAIR_Z, expected: float = 5.0) -> np.ndarray:
    """Sorted buckets of whole words that go together differently in the two classes, the `added` with the largest z.

    Compared is the covariance of two words' presence in each class; pairs that chance would bring together less than
    `expected` times in the smaller class don't count.
    """
    df, n0, n1 = bucket_counts(sample)
    if not n0 or not n1:
        return np.empty(0, np.int64)
    held = F.col("d0") + F.col("d1")
    common = df.where("bucket % 2 = 0").orderBy(F.desc(F.least(held, n0 + n1 - held)), "bucket").limit(paired)
    words = np.sort(common.select("bucket").toArrow().column("bucket").to_numpy()).astype(np.int64)
    rows, label = places_in(sample, words)
    x = np.zeros((len(rows), len(words)), np.float32)
    for k, r in enumerate(rows):
        x[k, r] = 1
    p = x.mean(0)
    spread = np.outer(p * (1 - p), p * (1 - p)) * (1 / n0 + 1 / n1)
    gap = np.zeros((len(words), len(words)))
    for c, sign in ((0, -1.0), (1, 1.0)):
        own = x[label == c]
        q = own.mean(0)
        gap += sign * (own.T @ own / len(own) - np.outer(q, q))
    score = np.abs(gap) / np.sqrt(np.maximum(spread, 1e-12))
    score[np.outer(p, p) * min(n0, n1) < expected] = 0
    np.fill_diagonal(score, 0)
    best = score.max(1, initial=0)
    order = np.lexsort((words, -best))[:added]
    return np.sort(words[order[best[order] >= z]])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int) -> FactorisationMachine | None:
    sample = Scratch(docs.sparkSession, "toxicity").table(labelled_sample(docs, labels, fit_rows), "sample")
    buckets = np.union1d(chosen_buckets(sample), paired_buckets(sample))
    return fit_machine(*places_in(sample, buckets), buckets)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 5000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model = fit(docs, labels, fit_rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        place = {int(b): k for k, b in enumerate(model.buckets)} if model else {}
        cache = Terms(lambda terms: tuple(place[t] for t in terms if t in place))
        for b in pieces(parts):
            out = []
            for text in b.column("text").to_pylist():
                known = sorted(set().union(*set(map(cache.__getitem__, set(text.lower().split())))))
                out.append(1 / (1 + np.exp(-np.clip(model.logit(known), -500, 500))) if model else 0.0)
            yield batches({"doc_id": b.column("doc_id"), "score": out}, schema)

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
