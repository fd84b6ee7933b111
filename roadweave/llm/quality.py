"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a short vector of statistics (sizes, character classes, repetition), transformed by logarithms and
standardised. Each class has a mean and a covariance shrunk towards the pooled covariance and its mean variance; a score
is the logistic of the log-odds (difference of log-densities from Mahalanobis distances with Cholesky factors that are
computed once, plus the log-ratio of class sizes), divided by a temperature: statistics of one text depend on each other in
ways that two normals don't show, so plain log-odds are too sure. A temperature changes no order of scores. All labelled rows outside the held-out fold count; their sums of products are added up in the cluster and only one
small matrix for each class reaches the driver.

Defined results: null and empty texts are scored as texts of no words; repeated rows give repeated rows; a null doc_id is
kept, is not held out and has no label; without two labelled rows of each class every score is 0.5; extra columns are
ignored (of_quality keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kit import Batches, Scratch, batches, fresh

FOLDS = 5
FEATURES = ("bytes", "words", "word_length", "upper", "marks", "bangs", "bars", "digits", "stops", "breaks", "distinct", "pairs", "stutter", "marked_words", "high_bytes", "line_repeats", "top_word")
D = len(FEATURES)
MARKS = np.frombuffer(b"*#$%&@^~<>={}[]\\_+", np.uint8)
UPPER = np.arange(65, 91)
DIGITS = np.arange(48, 58)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    words = text.split()
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    per = lambda c, of: float(np.log(c / max(of, 1) + 1e-3))
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    ends = sum(w[-1] in b"*#$%&!|" for w in times)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(np.log(size / max(n, 1) + 1)), per(counts[UPPER].sum(), size), per(counts[MARKS].sum(), size), per(counts[33], size), per(counts[124], size),
        per(counts[DIGITS].sum(), size), per(counts[46] + counts[44], n), per(len(lines), n), per(len(times), n), per(len(set(zip(words, words[1:], strict=False))), n), per(stutter, n), per(ends, len(times)),
        per(counts[128:].sum(), size), per(len(lines) - len(set(lines)), len(lines)), per(max(times.values(), default=0), n),
    ]


def statistics_of(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())], pa.list_(pa.float64()))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs and the statistics of each text; only the texts go to Python."""
    return docs.withColumn(name, F.arrow_udf(statistics_of, "array<double>")(F.col("text")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class: the Cholesky factor of its covariance
    prior: float  # the log-ratio of class sizes

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            out.append(-0.5 * (y * y).sum(0) - np.log(np.diag(factor)).sum())
        return out[1] - out[0] + self.prior

    def scores(self, x: np.ndarray, temperature: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / temperature, -500, 500)))


def fit_discriminant(moments: dict[int, np.ndarray], to_pooled: float = 0.3, to_identity: float = 0.05) -> Discriminant | None:
    """From each class's sum of [1, x] [1, x]^T; None unless both classes occur."""
    if len(moments) < 2 or min(m[0, 0] for m in moments.values()) < 2:
        return None
    n = np.array([moments[c][0, 0] for c in (0, 1)])
    raw = np.array([moments[c][0, 1:] / moments[c][0, 0] for c in (0, 1)])
    cov = np.array([moments[c][1:, 1:] / moments[c][0, 0] - np.outer(raw[c], raw[c]) for c in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    centre = (raw * n[:, None]).sum(0) / n.sum()
    cov, pooled = cov / np.outer(scale, scale), pooled / np.outer(scale, scale)
    shrunk = [(1 - to_pooled - to_identity) * c + to_pooled * pooled + to_identity * np.eye(len(scale)) * max(np.trace(c) / len(scale), 0.05) for c in cov]
    return Discriminant(centre, scale, (raw - centre) / scale, np.array([np.linalg.cholesky(c) for c in shrunk]), float(np.log(n[1] / n[0])))


def class_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of [1, x] [1, x]^T over rows (label, x), added up in the cluster; x has D entries."""

    def part(parts: Iterator[pa.RecordBatch]) -> Batches:
        sums = {}
        for b in parts:
            label = b.column("label").to_numpy(zero_copy_only=False)
            x = np.array(b.column("x").to_pylist(), float).reshape(len(label), -1)
            for c in np.unique(label):
                one = np.hstack((np.ones((int((label == c).sum()), 1)), x[label == c]))
                sums[c] = sums.get(c, 0) + one.T @ one
        schema = pa.schema([("label", pa.int32()), ("m", pa.list_(pa.float64()))])
        yield batches({"label": list(sums), "m": [m.ravel() for m in sums.values()]}, schema)

    cells = rows.mapInArrow(part, "label int, m array<double>").select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():  # (D + 1)^2 sums for each class
        out.setdefault(r.label, np.zeros((D + 1) ** 2))[r.k] = r.v
    return {c: m.reshape(D + 1, D + 1) for c, m in out.items()}


def fit(statistics_: DataFrame, labels: DataFrame) -> Discriminant | None:
    """From rows (doc_id, x) of all documents; labelled ones outside the held-out fold count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id")))
    return fit_discriminant(class_moments(statistics_.join(known, "doc_id").select("label", "x")))


def written_statistics(docs: DataFrame) -> DataFrame:
    x = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "x").drop("text")
    return Scratch(docs.sparkSession, "quality").table(x, "statistics")


def scoring(model: Discriminant | None, temperature: float):
    def score(x: pa.Array) -> pa.Array:
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
        return pa.array(model.scores(v, temperature) if model else np.full(len(v), 0.5))

    return F.arrow_udf(score, "double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, temperature: float = 4.0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    x = written_statistics(docs)
    scored = x.select("doc_id", scoring(fit(x, labels), temperature)("x").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, temperature: float = 4.0) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted quality is 1; no text is shuffled or written, each is read twice."""
    x, score = fresh(docs, "statistics"), fresh(docs, "score")
    model = fit(written_statistics(docs), labels)
    return with_statistics(docs, x).withColumn(score, scoring(model, temperature)(F.col(x))).where(F.col(score) >= threshold).select(*docs.columns)
