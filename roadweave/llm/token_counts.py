"""Token counts by rank-synchronous merging of ragged symbol arrays.

A text is cut into pre-tokens at boundaries that no vocabulary piece crosses. The pre-tokens that a worker has not met
yet are held as one ragged numpy array of symbols; in every round each sequence applies its own lowest-rank pair
wherever it occurs (from the left, without overlap), all sequences at the same time, until no pair is left; the surviving
symbols are counted, unknown characters as their UTF-8 bytes. A round stops in a sequence after the first merge that makes
a pair of the same or a lower rank, which comes next by rights. So a pre-token of any length takes a round for each rank
that it meets, not one for each merge.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; a null doc_id stays
null; extra columns are ignored; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._kit import KEPT_WORD, Batches, batches, id_text, pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: Words kept with their count by a worker; the cache is emptied when full.
CACHE = 600_000
#: Symbols of pre-tokens that are merged together; a longer one comes alone.
SYMBOLS = 1 << 18
NONE = np.int64(2**62)


class PieceTable:
    """Symbols and pair ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in own}
        self.score = {p: sp.get_score(i) for p, i in pieces.items()}
        chars = {c for p in pieces for c in p}
        self.ids = dict(pieces)
        for c in sorted(chars - pieces.keys()):
            self.ids[c] = n + len(self.ids)
        self.single = {c: self.ids[c] for c in chars}
        order = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for p, s in self.score.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[s], self.ids[p])
        self.pairs = pairs
        self.bits = max(12, (len(pairs) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        for key, (r, m) in pairs.items():
            at = self._slot(key)
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.rank[at], self.made[at] = key, r, m
        # Cut before a space mark that follows anything else, and around line feeds, if no piece crosses these places.
        crossed = any(re.search("[^▁]▁", p) or (len(p) > 1 and "\n" in p) for p in pieces)
        self.cut = None if crossed else re.compile("▁*[^▁\n]+|▁+|\n")
        self.known = {c: 1 for c in chars if c in pieces}
        probe = "  a  ﬁ\n"
        self.plain = sp.normalize(probe) == "▁" + probe.replace(" ", "▁")

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such pair) and product of each pair; negative symbols form no pair."""
        key = left << 20 | right
        key[(left < 0) | (right < 0)] = -2
        with np.errstate(over="ignore"):
            at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        rank = np.where(got == key, self.rank[at], NONE)
        made = self.made[at]
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = todo[got == key[todo]]
            rank[hit], made[hit] = self.rank[at[hit]], self.made[at[hit]]
            todo = todo[(got != key[todo]) & (got != -1)]
        return rank, made

    def count_many(self, words: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(words):  # about SYMBOLS of them at a time
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= SYMBOLS):
                size += len(words[end])
                end += 1
            out += self._count(words[at:end])
            at = end
        return out

    def _count(self, words: list[str]) -> list[int]:
        get = self.single.get
        flat = "".join(words)
        sym = np.fromiter((get(c, -1) for c in flat), np.int64, len(flat))
        seq = np.repeat(np.arange(len(words)), list(map(len, words)))
        width = np.ones(len(flat), np.int64)
        lost = np.flatnonzero(sym < 0)
        width[lost] = [len(flat[k].encode()) for k in lost]
        if len(self.known) < len(self.single):
            raw = np.flatnonzero(sym >= 0)
            width[raw] = [self.known.get(flat[k]) or len(flat[k].encode()) for k in raw]
        return self._rounds(sym, seq, width, len(words)).tolist()

    def _rounds(self, sym: np.ndarray, seq: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at these places."""
            left, right = sym[at], sym[np.minimum(at + 1, len(sym) - 1)]
            left[(at == len(sym) - 1) | (seq[at] != seq[np.minimum(at + 1, len(sym) - 1)])] = -1
            return self.look(left, right)

        rank, made = ranked(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            ended = best == NONE
            keep = np.ones(len(sym), bool)
            if ended.any():  # no pair is left in these sequences
                gone = np.repeat(ended, size)
                out += np.bincount(seq[gone], weights=width[gone], minlength=n).astype(np.int64)
                keep = ~gone
            at = self._due(np.flatnonzero((rank == np.repeat(best, size)) & (rank != NONE)), sym, seq, rank, made)
            sym[at] = made[at]
            width[at] = 1
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, seq, width, rank, made = sym[keep], seq[keep], width[keep], rank[keep], made[keep]
            if len(moved):
                before = moved[(moved > 0) & (seq[moved - 1] == seq[moved])] - 1
                again = np.concatenate((moved, before))
                rank[again], made[again] = ranked(again)
        return out

    def _due(self, hit: np.ndarray, sym: np.ndarray, seq: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of the places of each sequence's lowest rank those that come before any other merge, in their order."""
        if not len(hit):
            return hit
        run = np.cumsum(np.append(True, (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]]))) - 1  # of adjacent places every other one
        start = hit[np.flatnonzero(np.append(True, run[1:] != run[:-1]))]
        at = hit[(hit - start[run]) % 2 == 0]
        own = np.append(True, seq[at[1:]] != seq[at[:-1]])
        if own.all():
            return at
        new, low = made[at], rank[at]
        after = np.append(False, at[1:] == at[:-1] + 2)  # the symbol on the left is one that was just made
        before = np.maximum(at - 1, 0)
        left = np.where(after, np.append(-1, new[:-1]), sym[before])
        left[(at == 0) | (seq[before] != seq[at])] = -1
        nearest = np.minimum(at + 2, len(sym) - 1)
        right = np.where((at + 2 < len(sym)) & (seq[nearest] == seq[at]), sym[nearest], -1)
        stops = (self.look(left, new)[0] <= low) | (self.look(new, right)[0] <= low)
        past = np.cumsum(stops) - stops
        return at[past == past[np.flatnonzero(own)][np.cumsum(own) - 1]]

    def cuts(self, text: str) -> list[str]:
        if not text:
            return []
        text = "▁" + text.replace(" ", "▁") if self.plain else self.sp.normalize(text)
        return self.cut.findall(text) if self.cut else [text]


class Counter(dict):
    """Pre-token -> tokens, at most CACHE of them of at most KEPT_WORD letters each (about 200 MB); longer ones are counted each time."""

    def __bool__(self) -> bool:
        return True

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def totals(self, texts: list[str]) -> list[int]:
        cut = [self.table.cuts(t) for t in texts]
        met = set().union(*cut)
        if len(self) + len(met) > CACHE:
            self.clear()
        new = list(met - self.keys())
        self.update(zip(new, self.table.count_many(new), strict=True))
        get = self.__getitem__
        out = [sum(map(get, c)) for c in cut]
        for w in new:
            if len(w) > KEPT_WORD:
                del self[w]
        return out


#: One for each vocabulary file, kept by a worker for its later tasks; a lost worker fills its own anew.
COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; `vocabulary` is the file name that public_tokenizers.path() resolves."""
    def count(parts: Iterator[pa.RecordBatch]) -> Batches:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        counter = COUNTERS.get(path) or COUNTERS.setdefault(path, Counter(PieceTable(path)))
        for b in pieces(parts):
            texts = b.column("text").to_pylist()
            n = counter.totals(texts)
            yield batches({"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}, ARROW)

    return id_text(docs).mapInArrow(count, SCHEMA)
