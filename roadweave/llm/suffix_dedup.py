"""Exact removal of repeated byte strings by column-wise construction of collection Burrows-Wheeler transforms.

A 200-byte string (window) is named by its minimizer, the least hash among its grams of half its length; equal windows have equal
minimizers. Windows whose minimizer occurs once in the corpus can't repeat and stop there. Runs of windows that share one
minimizer place are segments; segments of one minimizer meet in one bucket. Equal segments settle each other. Of what is
left, buckets build the sorted order of all suffixes column by column: in each round every string of a collection
inserts one more symbol (a word of eight bytes) from its end, its place found by rank on the transform so far, and the common prefixes with both
neighbours come from range minima over the previous round's. The partial transform and prefixes are read and written in
sequence, as files would be; a collection holds at most about COLLECTION bytes, so they fit a worker's memory and no machine's
own disk is used. A window repeats if its suffix shares `width` symbols with a neighbour.

Scale: see _repeats. Segments of one minimizer are bounded by the distinct contexts of one gram; equal ones are
settled within a stretch of documents and sent once. A minimizer that occurs more than HOT times (boilerplate shorter than a
window, with other neighbours each time) is not gathered: its windows are dealt one by one, by 96-bit hashes of their bytes.
The commonest MOST_HOT such minimizers are sent to the workers. A group above COLLECTION bytes is cut by the minimizer of its
windows' first half, then of their second, and so on (every window stays with its equals).

Defined results: null and empty texts have no bytes; texts shorter than `width` keep all; matches never cross documents;
repeated rows of one doc_id and text are one document that is counted as often as it comes; a null doc_id is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kit import Batches, Scratch, batches, mixed, pieces, sliding_min_index, window_hashes
from ._repeats import FINER, HOT_ROWS, LAST, MARKS, MARKS_ARROW, PACKET, PACKET_ARROW, TextTable, add, add_entries, add_settled, bucket_of, by_bucket, elsewhere, gathered, grouped_packets, hot_hashes, marked, marks_of, repeated_anchors, stretches, unpacked

#: Bytes of strings that are sorted together, and from which a single minimizer's segments are cut anew.
TOGETHER = 48 << 10
COLLECTION = 1 << 20
#: Times that a large collection is cut anew.
DEEPEST = 8
#: Occurrences of a minimizer from which its windows are dealt one by one (more in a corpus of over 10 TB), and minimizers that are dealt so.
HOT, MOST_HOT = 100_000, 2_000_000


def minimizers(text: bytes, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` bytes its minimizer's place; the hashes of all grams."""
    gram = width // 2
    h = mixed(window_hashes(mixed(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(salt)), gram))
    return sliding_min_index(h, width - gram + 1), h


def minimizer_anchors(width: int):
    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(text) < width:
            return np.empty(0, np.int32), np.empty(0, np.uint64)
        at, h = minimizers(text, width)
        at = np.unique(at)
        return at.astype(np.int32), h[at]

    return of


def column_wise_order(strings: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, prefix) of all suffixes of the collection in sorted order; prefix: symbols in common with the one before, up to `most`.

    Symbols are whole numbers from 1; 0 ends a string, and ends of different strings are different (ordered by string).
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    longest = int(size.max(initial=0))
    top = max((int(s.max()) for s in strings if len(s)), default=0)
    back = np.zeros((longest + 1, m), np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int32)  # round, string: the symbol before the suffix of that length
    for i, s in enumerate(strings):
        back[: len(s), i] = s[::-1]
    bwt, prefix, who, place = back[0].copy(), np.zeros(m, np.uint16), np.arange(m, dtype=np.int32), np.arange(m)
    length = np.zeros(m, np.int32)
    live = np.flatnonzero(size > 0)
    for j in range(1, longest + 1):
        live = live[size[live] >= j]
        pos = place[live]
        order = stable_order(bwt)  # rank of each symbol's occurrences
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        r = rank[pos]  # = C[c] + occurrences of c before pos; the first symbol 0 block holds the ends of strings
        symbol = bwt[pos]
        ends = int(np.searchsorted(bwt[order], 1)) if len(bwt) else 0
        # Places before insertion: suffixes already there with the same first symbol are those of earlier rounds.
        new = np.zeros(len(bwt), bool)
        new[pos] = True
        older = np.concatenate(([0], np.cumsum(~new[order])))
        before = older[r] - (older[ends]) + m  # suffixes so far that come first: m ends, then older occurrences
        by = np.argsort(r, kind="stable")
        live, pos, r, symbol, before = live[by], pos[by], r[by], symbol[by], before[by]
        up, down = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        same_up = (r > 0) & (bwt[up] == symbol) & (up < pos)
        same_down = (r + 1 < len(order)) & (bwt[down] == symbol) & (down > pos)
        with_up = np.where(same_up, 1 + range_min(prefix, up + 1, pos + 1, same_up), 0)
        with_down = np.where(same_down, 1 + range_min(prefix, pos + 1, down + 1, same_down), 0)
        at = before + np.arange(len(live))
        total = len(bwt) + len(live)
        hole = np.zeros(total, bool)
        hole[at] = True
        grown = []
        for old, add in ((bwt, back[j][live]), (prefix, np.minimum(with_up, most)), (who, live), (length, j)):
            wide = np.empty(total, old.dtype)
            wide[~hole] = old
            wide[at] = add
            grown.append(wide)
        bwt, prefix, who, length = grown
        after = at + 1
        held = (after < total) & ~hole[np.minimum(after, total - 1)]
        prefix[after[held]] = np.minimum(with_down[held], most)
        place[live] = at
    return who, size[who] - length, prefix


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort by counting digits of 16 bits."""
    if x.itemsize <= 2:
        return np.argsort(x, kind="stable")
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """min of x[lo:hi] where ok."""
    out = np.zeros(len(lo), np.int64)
    k = np.flatnonzero(ok)
    if len(k):
        pairs = np.empty(2 * len(k), np.int64)
        pairs[0::2], pairs[1::2] = lo[k], hi[k]
        out[k] = np.minimum.reduceat(np.append(x, x.dtype.type(0)), pairs)[0::2]
    return out


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string a mask of the windows that occur in the collection twice.

    A symbol is a word of `q` bytes, and a string takes part once for each of its q offsets, so that every window is a
    whole number of symbols wherever it begins, and there are q times fewer rounds.
    """
    q = next(q for q in (8, 4, 2, 1) if width % q == 0)
    words = [np.frombuffer(s[o : o + (len(s) - o) // q * q], f"<u{q}") for s in strings for o in range(q)]
    code = np.unique(np.concatenate(words), return_inverse=True)[1] + 1 if words else np.empty(0, np.int64)
    cut = np.cumsum([0, *map(len, words)])
    coded = [code[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    out = [np.zeros(max(0, len(s) - width + 1), bool) for s in strings]
    who, start, prefix = column_wise_order(coded, width // q)
    full = np.flatnonzero(prefix >= width // q)
    for k in (full, full - 1):
        for w, s in zip(who[k].tolist(), start[k].tolist(), strict=True):
            out[w // q][w % q + q * s] = True
    return out


def resolve(strings: list[bytes], width: int, depth: int = 0) -> list[np.ndarray]:
    """repeated_starts of distinct strings; a large collection is cut by other minimizers, which keeps equal windows together."""
    if sum(map(len, strings)) <= COLLECTION or depth == DEEPEST:
        return repeated_starts(strings, width)
    out = [np.zeros(max(0, len(s) - width + 1), bool) for s in strings]
    groups: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for k, s in enumerate(strings):
        at, h = minimizers(s, width, 1 + depth)
        for a, b in segments(at):
            groups[int(h[at[a]])][s[a : b + width - 1]].append((k, a))
    mixed_up = [list(g) for g in groups.values() if len(g) > 1]
    found: dict[bytes, np.ndarray] = {}
    for part in packed(mixed_up):
        found.update(zip(part, resolve(part, width, depth + 1), strict=True))
    for g in groups.values():
        for c, owners in g.items():
            n = len(c) - width + 1
            for k, a in owners:
                out[k][a : a + n] |= True if len(owners) > 1 else found[c] if c in found else False
    return out


def segments(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows with one minimizer place: (first, end)."""
    cut = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def packed(groups: list[list[bytes]]) -> Iterator[list[bytes]]:
    """Whole groups, joined up to TOGETHER bytes."""
    held, size = [], 0
    for g in groups:
        total = sum(map(len, g))
        if held and size + total > TOGETHER:
            yield held
            held, size = [], 0
        held = held + g if held else g
        size += total
    if held:
        yield held


def candidate_segments(texts: DataFrame, n: int, width: int, hot: np.ndarray | None = None) -> DataFrame:
    """Packets of the segments whose minimizer occurs twice; in `hashes` their bytes, in `checks` their lengths. Of hot minimizers packets of kind 2, of single windows."""
    sent = texts.sparkSession.sparkContext.broadcast(np.empty(0, np.uint64) if hot is None else hot)  # at most MOST_HOT numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        hot = sent.value
        for ids, hs, raw, (marks,) in stretches(parts, ("marks",)):
            found: dict[bytes, list[tuple[int, int]]] = {}
            bucket: dict[bytes, int] = {}
            single: list[tuple[np.ndarray, ...]] = []
            for d, (t, m) in enumerate(zip(raw, marks, strict=True)):
                at, h = minimizers(t, width)
                twice = marked(m, len(h))
                if len(hot) and len(at):
                    k = np.minimum(np.searchsorted(hot, h[at]), len(hot) - 1)
                    own = np.flatnonzero((hot[k] == h[at]) & twice[at])
                    if len(own):
                        twice[at[own]] = False
                        single.append((np.full(len(own), d), own, *window_names(t, width, own)))
                for a, b in segments(at):
                    if twice[at[a]]:
                        s = t[a : b + width - 1]
                        if s in found:
                            found[s].append((d, a))
                        else:
                            found[s] = [(d, a)]
                            bucket[s] = int(h[at[a]])
            keys = list(found)
            rows: dict[str, list] = {f.name: [] for f in PACKET_ARROW}
            key_of = np.array([ids, hs], np.int64).T
            settled = [(d, a, a + len(s) - width + 1) for s, own in found.items() if len(own) > 1 for d, a in own]
            if single:
                doc, at, name, check = map(np.concatenate, zip(*single, strict=True))
                again = elsewhere(check, name)
                settled += [(d, a, a + 1) for d, a in zip(doc[again].tolist(), at[again].tolist(), strict=True)]
                order = np.lexsort((check, name))
                new = order[np.append(True, (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1]))]
                add_entries(rows, 2, doc[new], at[new], name[new], check[new], again[new].astype(np.int32), key_of, n)
            add_settled(rows, marks_of(*ranges(settled), key_of, n))
            h = np.array([bucket[s] for s in keys], np.uint64)
            for b, k in by_bucket(bucket_of(h, FINER * n)):
                part = [keys[x] for x in k]
                own = np.array([(ids[d], hs[d], a, len(found[s]) > 1, v) for s, v in ((s, bucket[s] - 2**63) for s in part) for d, a in found[s][:1]], np.int64)
                add(rows, b, 0, None, None, b"".join(part), np.array(list(map(len, part)), np.int32).tobytes(), own.tobytes())
            yield batches(rows, PACKET_ARROW)

    return texts.mapInArrow(run, PACKET)


def window_names(text: bytes, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that tell the windows at these places apart."""
    symbols = np.frombuffer(text, np.uint8).astype(np.uint64)
    one = mixed(window_hashes(mixed(symbols + np.uint64(1 << 32)), width)[at])
    other = mixed(window_hashes(mixed(symbols + np.uint64(1 << 33)), width, 0xC2B2AE3D27D4EB4F)[at])
    return one, (other >> np.uint64(32)).astype(np.uint32)


def ranges(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents, and (start, end) of ranges of windows."""
    r = np.array(found, np.int64).reshape(-1, 3)
    return r[:, 0], r[:, 1:]


def settle_segments(rows: DataFrame, n: int, width: int) -> DataFrame:
    """Rows of MARKS, each place a range of repeated window starts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Batches:
        for held, done in grouped_packets(parts):
            if done is not None:
                yield done
                continue
            if lone := [r for r in held if r["kind"] == 2]:
                e = unpacked(lone)
                hit = elsewhere(e["check"], e["hash"]) & ~e["multi"]
                keys, doc = np.unique(e["key"], axis=0, return_inverse=True)
                at = e["at"][hit].astype(np.int64)
                yield batches(marks_of(doc.ravel()[e["doc"][hit]], np.stack((at, at + 1), axis=1), keys, n), MARKS_ARROW)
                held = [r for r in held if r["kind"] != 2]
            owners: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
            sure: set[bytes] = set()
            groups: dict[int, set[bytes]] = defaultdict(set)
            for r in held:
                at = 0
                own = np.frombuffer(r["own"], np.int64).reshape(-1, 5).tolist()
                for size, (i, h, a, multi, key) in zip(np.frombuffer(r["checks"], np.int32).tolist(), own, strict=True):
                    s = r["hashes"][at : at + size]
                    at += size
                    if s in owners or multi:
                        sure.add(s)
                    owners[s].append((i, h, a))
                    groups[key].add(s)
            # Only where segments of one minimizer differ, and not all of them repeat as wholes, is there anything to sort.
            mixed_up = [sorted(g) for _, g in sorted(groups.items()) if len(g) > 1 and not g <= sure]
            found: dict[bytes, np.ndarray] = {}
            for part in packed(mixed_up):
                found.update(zip(part, resolve(part, width), strict=True))
            ids: dict[tuple[int, int], int] = {}
            repeated = []
            for s, own in owners.items():
                if s in sure:
                    spans = [(0, len(s) - width + 1)]
                elif s in found and found[s].any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], found[s].view(np.int8), [0]))))
                    spans = list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))
                else:
                    continue
                for i, h, a in own:
                    d = ids.setdefault((i, h), len(ids))
                    repeated += [(d, a + x, a + y) for x, y in spans]
            yield batches(marks_of(*ranges(repeated), np.array(list(ids), np.int64).reshape(-1, 2), n), MARKS_ARROW)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)


def facts(parts: Iterator[pa.RecordBatch]) -> Batches:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_bytes", pa.int64()), ("text_sha", pa.binary())])
    for b in pieces(parts):
        texts = b.column("text").to_pylist()
        yield batches({"doc_id": b.column("doc_id"), "h": b.column("h"), "n_bytes": list(map(len, texts)), "text_sha": [hashlib.sha256(t).digest() for t in texts]}, schema)


def remove_repeated_strings(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    if width < 2:
        raise ValueError("a repeated string has at least 2 bytes")
    def cut(parts: Iterator[pa.RecordBatch]) -> Batches:
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("cut", pa.int64()), ("spans", pa.int64()), ("cut_sha", pa.string())])
        for b in pieces(parts):
            out = []
            for text, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                delta = np.zeros(len(text) + 1, np.int64)
                r = np.frombuffer(m, np.int32).reshape(-1, 2)
                np.add.at(delta, r[:, 0], 1)
                np.add.at(delta, r[:, 1] + width - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)), hashlib.sha256(kept).hexdigest()))
            yield batches({"doc_id": b.column("doc_id"), "h": b.column("h"), "cut": [x[0] for x in out], "spans": [x[1] for x in out], "cut_sha": [x[2] for x in out]}, schema)

    scratch = Scratch(docs.sparkSession, "strings")
    with TextTable(docs, scratch) as t:
        known = scratch.table(t.table.mapInArrow(facts, "doc_id long, h long, n_bytes long, text_sha binary"), "facts")
        texts = known.groupBy("text_sha").agg(F.min(F.struct("doc_id", "h")).alias("f"), F.count("*").alias("copies")).select("text_sha", "f.doc_id", "f.h", "copies")
        texts = scratch.table(texts, "distinct")
        single = texts.where("copies = 1").select("doc_id", "h").withColumn("single", F.lit(True))
        reps = t.table.join(texts.select("doc_id", "h"), ["doc_id", "h"])  # a copied text takes part once, for what others share with it
        often = max(HOT, (known.agg(F.sum("n_bytes")).first()[0] or 0) // (width // 4) // MOST_HOT)  # a minimizer comes about every quarter of a width
        places = scratch.table(repeated_anchors(reps, t.n, minimizer_anchors(width), often), "places")
        anchors = scratch.table(gathered(places.where(F.col("dest") != HOT_ROWS), t.n), "anchors")
        hot = hot_hashes(places, MOST_HOT)
        found = settle_segments(candidate_segments(t.table.join(anchors, ["doc_id", "h"]), t.n, width, hot), t.n, width)
        marks = scratch.table(gathered(found, t.n, 2).join(single.drop("single"), ["doc_id", "h"]), "marks")
        trimmed = scratch.table(t.table.join(marks, ["doc_id", "h"]).mapInArrow(cut, "doc_id long, h long, cut long, spans long, cut_sha string").distinct(), "trimmed")
    scratch.drop("places", "anchors", "marks")
    whole = known.join(single, ["doc_id", "h"], "left").join(trimmed, ["doc_id", "h"], "left")
    gone = (F.col("n_bytes") >= width) & F.col("single").isNull()  # another text equals it
    return whole.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("cut_sha", F.lower(F.hex("text_sha")))).alias("kept_sha256"),
    )
