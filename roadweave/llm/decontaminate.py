"""Benchmark decontamination: rare word n-grams as seeds join documents to test items, then Smith-Waterman alignment.

Texts and test items are normalised words; a document is aligned with an item by local alignment over words (match 2,
mismatch -1, gap -1), and the pair counts if the score is at least `least` of a full match's. Edited and paraphrased copies
lose a little score for each changed word.

Seeds are n-grams of two words, the next word or the one after, on either side. That they lose nothing follows from the
score: an alignment of score S is a first match and steps from each match to the next; a step to the next word on both
sides adds 2, one that passes a single word on one or both sides adds 1, any other adds nothing or less. So its steps of
the first two kinds are word pairs at distance 1 or 2 on both sides whose weights sum to S - 2 at least, within 3 words for
each word of the item less S, and begin at different places of the item. A first pass counts in how many documents each
pair of neighbours occurs. The commonest places of an item, as many as could not make up the sum together, are left out: what is left,
its rare pairs, are the item's seeds, and every document that scores `least` holds one of them. Documents with a seed have
all their pairs with the item summed, and the stretches that reach the sum are aligned, however many documents or items
share a pair. No pair of a document and an item that scores `least` is left out.

Scale: texts are read in place, twice for each block of the test set, and never shuffled; only counts are. The test set is
sent to the workers in blocks of at most BLOCK words. Every document yields at most a row for each
item that it holds.

Defined results: null and empty texts and items hold nothing; items shorter than SHORT words are no evidence inside other
text, and count only for a document that has just their words; repeated rows give repeated results; null ids are kept;
extra columns are ignored (decontaminated keeps them); an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kit import MIX, Batches, Scratch, batches, id_text, pieces

SHORT = 4
BLOCK = 1 << 20
#: Bounds of what is looked at together: bytes of texts, cells of documents by items, links of word pairs to items.
SIZE, CELLS, LINKS = 1 << 20, 1 << 22, 1 << 21
MATCH, OFF = 2, 1
FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Normalised words: lower-cased runs of letters, digits and underscores.

    (pieces between blanks, which of them hold anything else, the words of those, where each text's pieces end).
    """
    lists = pa.compute.ascii_split_whitespace(pa.compute.utf8_lower(texts))
    flat = lists.flatten()
    odd = ~pa.compute.utf8_is_alnum(flat).to_numpy(zero_copy_only=False)
    spaced = pa.compute.replace_substring_regex(flat.filter(pa.array(odd)), pattern=r"[^\pL\pN_]+", replacement=" ")
    return flat, odd, pa.compute.split_pattern(pa.compute.utf8_trim(spaced, " "), " "), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


class Vocabulary:
    """Numbers of the words that items have, from 1; 0 stands for every other word, which matches nothing anyhow."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pa.compute.fill_null(pa.compute.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's words."""
        flat, odd, parts, ends = words_of(texts)
        out = self.numbers(flat)
        at = np.flatnonzero(odd)
        if len(at):
            several = parts.flatten()
            real = pa.compute.binary_length(several).to_numpy(zero_copy_only=False) > 0
            owner = np.repeat(at, parts.value_lengths().to_numpy(zero_copy_only=False))[real]
            size = np.ones(len(out), np.int64)
            size[at] = np.bincount(owner, minlength=len(out))[at]
            ends = np.concatenate(([0], np.cumsum(size)))[ends]
            out = np.repeat(np.where(odd, -1, out), size)
            out[out < 0] = self.numbers(several)[real]
        return np.split(out, ends[:-1]) if len(ends) else []


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end) of the best local alignment of an item in a text, both as word hashes."""
    n = len(text)
    ramp = np.arange(n + 1) * OFF
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = np.where(text == w, MATCH, -OFF)
        score = np.zeros(n + 1, np.int64)
        score[1:] = np.maximum(row[:-1] + step, 0)
        start = np.arange(n + 1)
        start[1:] = np.where(score[1:] > 0, begin[:-1], start[1:])
        up = row - OFF
        start = np.where(up > score, begin, start)
        score = np.maximum(score, up)
        lifted = score + ramp  # gaps along the text: the best cell to the left, less its distance
        source = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), np.arange(n + 1), 0))
        score, start = lifted[source] - ramp, start[source]
        row, begin = score, start
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


class TestSet:
    """A block of items: words as numbers from 1, and the sorted word pairs with the items that hold them."""

    def __init__(self, ids: list[int], words: list[np.ndarray], vocabulary: Vocabulary, least: float):
        self.ids, self.words, self.vocabulary = ids, words, vocabulary
        size = np.array(list(map(len, words)), np.int64)
        self.least = np.where(size < SHORT, max(1.0, least), least)
        score = np.ceil(self.least * MATCH * size - 1e-9).astype(np.int64)
        self.need = np.maximum(score - MATCH, 1)
        self.span = np.maximum(3 * size - score, 1)
        key, item, weight = [], [], []  # weights by the pair's distance in a text: 0 (a lone word), 1, 2
        for i, w in enumerate(words):
            for distance, weights in ((1, (0, 2, 1)), (2, (0, 1, 1))) if len(w) > 1 else ((0, (1, 0, 0)),):
                k = (w[: len(w) - distance] << 32) | (w[distance:] if distance else 0)
                key.append(k)
                item.append(np.full(len(k), i))
                weight.append(np.tile(weights, (len(k), 1)))
        key, item, weight = np.concatenate(key), np.concatenate(item), np.concatenate(weight)
        self.keys, place = np.unique(key, return_inverse=True)
        link, at = np.unique(place * len(words) + item, return_inverse=True)
        self.items, pair = link % len(words), link // len(words)
        self.weight = np.stack([np.bincount(at, weights=weight[:, d], minlength=len(link)) for d in range(3)]).astype(np.int64)
        self.bounds = np.searchsorted(pair, np.arange(len(self.keys) + 1))
        order = np.argsort(self.items, kind="stable")
        ends = np.searchsorted(self.items[order], np.arange(len(words) + 1))
        self.own = [(pair[o], self.weight[:, o]) for o in (order[a:b] for a, b in zip(ends, ends[1:], strict=False))]
        self.distances = [d for d in range(3) if self.weight[d].any()]
        self.seeds = np.ones(3 * len(self.keys), bool)  # pair * 3 + distance
        self.maybe = np.zeros(1 << 22, bool)  # by hashed bits: most pairs of a text end here
        self.maybe[bits(self.keys)] = True

    def choose_seeds(self, documents: np.ndarray) -> None:
        """Leaves out the commonest places of each item, as many as can't reach its need; documents: of each pair of neighbours."""
        self.seeds[:] = False
        for w, need in zip(self.words, self.need, strict=True):
            n = len(w)
            if n == 1:
                self.seeds[3 * np.searchsorted(self.keys, w << 32)] = True
                continue
            first = np.searchsorted(self.keys, (w[:-1] << 32) | w[1:])
            second = np.append(np.searchsorted(self.keys, (w[:-2] << 32) | w[2:]), first[-1])  # the last place has none
            rare = np.argsort(documents[first], kind="stable")[: n - 1 - (int(need) - 1) // MATCH]
            for k in (first[rare], second[rare]):
                self.seeds[3 * k + 1] = self.seeds[3 * k + 2] = True

    def hits(self, flat: np.ndarray, distances: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the text, numbers of the pairs that begin there, their distances), by place."""
        at, number, far = [], [], []
        for d in distances:
            p = np.flatnonzero((flat[: len(flat) - d] > 0) & (flat[d:] > 0))
            key = (flat[p] << 32) | (flat[p + d] if d else 0)
            near = self.maybe[bits(key)]
            p, key = p[near], key[near]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at.append(p[hit])
            number.append(k[hit])
            far.append(np.full(len(at[-1]), d))
        at, number, far = map(np.concatenate, (at, number, far))
        order = np.argsort(at, kind="stable")
        return at[order], number[order], far[order]

    def reaching(self, text: np.ndarray, number: np.ndarray, far: np.ndarray, texts: int) -> np.ndarray:
        """(text, item) whose pairs, each counted once, have the item's needed weight, as text * items + item; a seed is one of them."""
        code = np.unique((text * len(self.keys) + number) * 3 + far)
        seeded = np.zeros(texts, bool)
        seeded[code[self.seeds[code % (3 * len(self.keys))]] // (3 * len(self.keys))] = True
        code = code[seeded[code // (3 * len(self.keys))]]
        far, code = code % 3, code // 3
        text, number = code // len(self.keys), code % len(self.keys)
        first, count = self.bounds[number], np.diff(self.bounds)[number]
        total = np.zeros(texts * len(self.ids))
        ends = np.cumsum(count)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LINKS, "right")))
            n = count[lo:hi]
            link = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
            total += np.bincount(np.repeat(text[lo:hi], n) * len(self.ids) + self.items[link], weights=self.weight[np.repeat(far[lo:hi], n), link], minlength=len(total))
            lo = hi
        return np.flatnonzero(total.reshape(texts, -1) >= self.need)

    def placed(self, texts: list[np.ndarray], distances: list[int]) -> tuple[np.ndarray, ...]:
        """The hits of several texts: (text, place, pair, distance), and where each text's begin."""
        flat = np.concatenate([x for t in texts for x in (t, np.zeros(2, np.int64))])  # no pair lies across texts
        begins = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
        at, number, far = self.hits(flat, distances)
        edge = np.searchsorted(at, begins)
        text = np.repeat(np.arange(len(texts)), np.diff(edge))
        return text, at - begins[text], number, far, edge

    def counted(self, texts: list[np.ndarray]) -> np.ndarray:
        """In how many of the texts each pair occurs side by side."""
        text, _, number, _, _ = self.placed(texts, [1])
        return np.bincount(np.unique(text * len(self.keys) + number) % len(self.keys), minlength=len(self.keys))

    def found(self, texts: list[np.ndarray]) -> list[tuple]:
        """(number of the text, item_id, share, start, end) of each text and item that it holds."""
        text, at, number, far, edge = self.placed(texts, self.distances)
        out = []
        for cell in self.reaching(text, number, far, len(texts)).tolist():
            x, i = divmod(cell, len(self.ids))
            part = slice(edge[x], edge[x + 1])
            best = self.best(i, texts[x], at[part], number[part], far[part])
            share = best[0] / (MATCH * len(self.words[i]))
            if share >= self.least[i] and (len(self.words[i]) >= SHORT or len(texts[x]) == len(self.words[i])):
                out.append((x, self.ids[i], share, best[1], best[2]))
        return out

    def best(self, i: int, words: np.ndarray, at: np.ndarray, number: np.ndarray, far: np.ndarray) -> tuple[int, int, int]:
        """The best alignment of an item in the stretches of a text that have the needed weight."""
        pair, weight = self.own[i]
        k = np.minimum(np.searchsorted(pair, number), len(pair) - 1)
        mine = pair[k] == number
        at, w, span = at[mine], weight[far[mine], k[mine]], int(self.span[i])
        total = np.concatenate(([0], np.cumsum(w)))
        starts = at[total[np.searchsorted(at, at + span)] - total[np.searchsorted(at, at)] >= self.need[i]]
        best = (0, 0, 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) >= 2 * span) + 1) if len(starts) else ():  # overlapping reaches are one stretch
            lo = max(0, int(part[0]) - span + 1)
            score, a, b = align(self.words[i], words[lo : int(part[-1]) + span])
            if score > best[0]:
                best = (score, lo + a, lo + b)
        return best


def bits(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * MIX) >> np.uint64(42)


def blocks(items: DataFrame, least: float) -> Iterator[TestSet]:
    """The test set in blocks of at most BLOCK words; items without words hold nothing."""

    def block(rows: list[tuple[int, str]]) -> TestSet | None:
        texts = pa.array([t for _, t in rows], pa.string())
        flat, odd, parts, _ = words_of(texts)
        every = pa.compute.unique(pa.concat_arrays([flat.filter(pa.array(~odd)), parts.flatten()])).to_pylist()
        vocabulary = Vocabulary([w for w in every if w])
        held_ = [(i, w) for (i, _), w in zip(rows, vocabulary.of(texts), strict=True) if len(w)]
        return TestSet([i for i, _ in held_], [w for _, w in held_], vocabulary, least) if held_ else None

    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(r.t) // 2 + 1  # words at most
        if rows and size + n > BLOCK:
            if t := block(rows):
                yield t
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += n
    if rows and (t := block(rows)):
        yield t


def gathered(t: TestSet, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The normalised texts, some at a time, after the number of the first; null is the empty text."""
    rows = pa.RecordBatch.from_arrays([pa.compute.fill_null(texts, "")], names=["text"])
    first = 0
    for b in pieces(iter([rows]), size=SIZE, rows=max(1, CELLS // len(t.ids))):
        yield first, t.vocabulary.of(b.column("text"))
        first += b.num_rows


def held(t: TestSet, texts: pa.Array) -> Iterator[tuple]:
    """`found` of a batch's texts."""
    for first, part in gathered(t, texts):
        yield from ((first + x, *rest) for x, *rest in t.found(part))


def with_seeds(docs: DataFrame, block: TestSet) -> TestSet:
    """Counts the documents of each pair in the cluster; at most two counts for each word of a block come back."""
    spark = docs.sparkSession
    test = spark.sparkContext.broadcast(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        t = test.value
        total = np.zeros(len(t.keys), np.int64)
        for b in parts:
            for _, part in gathered(t, b.column("text")):
                total += t.counted(part)
        code = np.flatnonzero(total)
        yield batches({"code": code, "n": total[code]}, pa.schema([("code", pa.int64()), ("n", pa.int64())]))

    counts = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = Scratch(spark, "seeds").table(counts, "counts").toArrow()
    documents = np.zeros(len(block.keys), np.int64)
    documents[got.column("code").to_numpy()] = got.column("n").to_numpy()
    block.choose_seeds(documents)
    return block


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of each document and item that it holds."""
    spark = docs.sparkSession
    texts = id_text(docs)
    out = None
    for block in blocks(items, least):
        test = spark.sparkContext.broadcast(with_seeds(texts, block))

        def run(parts: Iterator[pa.RecordBatch], test=test) -> Batches:
            for b in parts:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[x], *rest) for x, *rest in held(test.value, b.column("text"))]
                yield batches({f.name: [x[k] for x in rows] for k, f in enumerate(FOUND_ARROW)}, FOUND_ARROW)

        part = texts.mapInArrow(run, FOUND)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; nothing is shuffled, and only texts go to Python."""
    spark = docs.sparkSession
    out = docs
    for block in blocks(items, least):
        holds = holding(spark.sparkContext.broadcast(with_seeds(docs, block)))
        out = out.where(~F.arrow_udf(holds, "boolean")(F.col("text")))
    return out


def holding(test: Broadcast):
    """Whether texts hold an item of a block."""

    def holds(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        hit[[x for x, *_ in held(test.value, texts)]] = True
        return pa.array(hit)

    return holds
