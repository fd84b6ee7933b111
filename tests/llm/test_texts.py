"""The other operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import decontaminate, embedding_dedup, minhash_dedup, suffix_dedup
from roadweave.llm.queries import QUERIES

from .test_native import docs, save

DRAW = random.Random(12)
VOCAB = [f"w{k}" for k in range(400)]
PROSE = " ".join(DRAW.choice(VOCAB) for _ in range(120))
SHARED = " ".join(DRAW.choice(VOCAB) for _ in range(55))


def edited(text, n):
    w = text.split()
    for k in DRAW.sample(range(len(w)), n):
        w[k] = "edit"
    return " ".join(w)


def prose(n):
    return " ".join(DRAW.choice(VOCAB) for _ in range(n))


ROWS = (
    [(k, prose(DRAW.randint(1, 150)), "s") for k in range(60)]
    + [(60 + k, edited(PROSE, 2), "s") for k in range(12)]
    + [(80 + k, f"{prose(30)} {SHARED} {prose(30)}", "t") for k in range(6)]
    + [(100, None, "s"), (101, "", "s"), (102, " \t\n ", "s"), (103, PROSE, "s"), (104, PROSE, "s"), (3, None, "s"), (105, "short", "s"), (106, "short", None), (107, "ab " * 3000, "s"), (108, "é😀 ñ " * 80, "s")]
)
ROWS = [r for k, r in enumerate(ROWS) if r[0] != 3 or k < 60]  # ids with several texts have tests of their own


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The rows, some twice, as every table that the queries read."""
    path = tmp_path_factory.mktemp("sf")
    save(docs(spark, ROWS + [ROWS[5], (104, PROSE, "s")]), path)
    spark.createDataFrame([(0, " ".join(SHARED.split()[:40])), (1, None), (2, ""), (3, "two words"), (4, edited(SHARED, 5))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i, *_ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    save(docs(spark, ROWS[:1]).limit(0), path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).count() == (name == "op12_chat_format")  # which adds a conversation of its own


def test_tokens(spark, sf):
    import public_tokenizers
    import sentencepiece

    from roadweave.llm.token_counts import Counter, PieceTable

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op9_token_counts"](spark, sf).collect():
        t = dict((i, t) for i, t, _ in ROWS)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    c = Counter(PieceTable(public_tokenizers.path("piece_bpe_32k.model")))
    draw = random.Random(2)
    for k in range(300):
        t = "".join(draw.choice("abc the▁ \n\t<s>é€😀AZ09") for _ in range(draw.randint(0, 2000 if k % 30 == 0 else 60)))
        assert c.totals([t]) == [len(sp.encode(t))]
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "0123456789abcdef", "é😀"):  # pre-tokens without a cut
        t = ["".join(draw.choice(letters) for _ in range(n)) for n in (1, 2, 513, 6000)]
        assert c.totals(t) == [len(sp.encode(x)) for x in t]


def test_scores(spark, sf):
    for name, limit in (("op2_toxicity", 0.5), ("op4_quality", 0.3)):
        out = QUERIES[name](spark, sf).collect()
        assert len(out) == len(ROWS) + 2
        for r in out:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)


@pytest.mark.parametrize(("name", "column"), [("op2_toxicity", "toxic"), ("op4_quality", "quality")])
def test_held_out_accuracy(spark, name, column):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(r.score, label[r.doc_id]) for r in QUERIES[name](spark, sf).collect() if r.held_out and r.doc_id in label]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in out for b, y in out if x > y]
    assert sum(pairs) / len(pairs) > (0.9 if column == "toxic" else 0.95)


def test_pairs_of_terms_are_learnt():
    """Two terms that are harmless alone and toxic together."""
    from roadweave.llm.toxicity import fit_machine

    draw = np.random.default_rng(0)
    x = draw.random((3000, 2)) < 0.5
    terms = [np.unique(np.concatenate((np.flatnonzero(r) + 1, draw.integers(100, 100_000, 4)))) for r in x]
    y = (x[:, 0] & x[:, 1]).astype(int)
    buckets = np.array([1, 2, *range(100, 400)])
    m = fit_machine([np.flatnonzero(np.isin(buckets, t)) for t in terms], y, buckets, epochs=30)
    score = lambda *t: m.logit([k - 1 for k in t])
    assert score(1, 2) > 0 > max(score(1), score(2), score())
    assert np.abs(m.v[0] @ m.v[1]) > 0.05
    for _ in range(50):  # the sum over all pairs of terms, one by one
        known = sorted(draw.choice(len(buckets), draw.integers(0, 30), replace=False).tolist())
        plain = m.bias + sum(m.w[k] for k in known) + sum(float(m.v[a] @ m.v[b]) for a, b in itertools.combinations(known, 2))
        assert m.logit(known) == pytest.approx(plain)


def test_copies_in_the_labelled_sample(spark):
    """Only equal term sets of one label count once; near copies and copies under other labels stay. Buckets are chosen as by counting them one by one."""
    from roadweave.llm import toxicity

    draw = random.Random(1)
    toxic = [f"{prose(30)} slur{k % 3}" for k in range(30)]
    clean = [prose(30) for _ in range(30)]
    texts = [*clean, toxic[5], *toxic, toxic[3], toxic[0].rsplit(" ", 2)[0]]
    label = [0] * 31 + [1] * 32
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    rows = list(zip(ids, texts, ["s"] * len(texts), strict=True))
    draw.shuffle(rows)
    labels = spark.createDataFrame(list(zip(ids, label, strict=True)), "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs(spark, [*rows, (None, "no id", "s")]), labels, 5000)
    terms = lambda t: frozenset(x for w in t.lower().split() for x in toxicity.word_terms(w))
    want = {(y, terms(t)) for t, y in zip(texts, label, strict=True)}
    got = [(r.label, frozenset(np.frombuffer(r.terms, np.int32).tolist())) for r in sample.collect()]
    assert len(got) == len(want) == 62 and set(got) == want
    n = [sum(y == c for y, _ in want) for c in (0, 1)]
    df = {b: [sum(b in t for y, t in want if y == c) for c in (0, 1)] for b in set().union(*(t for _, t in want))}
    z = {}
    for b, (d0, d1) in df.items():
        p = (d0 + d1) / sum(n)
        z[b] = abs(d1 / n[1] - d0 / n[0]) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    assert toxicity.chosen_buckets(sample).tolist() == sorted(b for b, v in z.items() if v >= 3 and sum(df[b]) >= 3)
    assert toxicity.chosen_buckets(sample.where("label = 0")).tolist() == []


def test_vectors(spark, tmp_path):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(12, 16))
    x = [(base[k % 12] + draw.normal(size=16) * draw.choice([0.01, 0.05, 0.09])).tolist() for k in range(150)]
    rows = [(k, v, int(k % 2)) for k, v in enumerate(x)] + [(200, x[0], 0), (201, x[0], 0), (202, [2 * c for c in x[0]], 0), (203, x[0], 1), (204, None, 0), (205, [0.0] * 16, 0), (206, [float("nan")] * 16, 0), (207, [None] + [1.0] * 15, 0), (208, x[0], None), (209, x[0][:8], 0), (210, [], 0), (211, [float("inf")] * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sound = lambda v: v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    links = {i: set() for i, *_ in rows}
    for (i, v, p), (j, w, q) in itertools.combinations(rows, 2):
        if p is not None and p == q and sound(v) and sound(w) and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
            links[i].add(j), links[j].add(i)
    root = {i: i for i in links}
    for _ in range(50):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    for tile in (1024, 5):
        out = embedding_dedup.link_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), tile=tile).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (len(links[i]), root[i], root[i] == i) for i in links}
    assert QUERIES["op3_embedding_dedup"](spark, str(tmp_path)).count() == len(rows)
    few = [(None, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, [2.0, 0.0], 0), (None, [0.0, 1.0], 0), (5, [1.0, 0.01], 0), (5, [1.0, 0.01], 0), (6, None, 0), (None, None, None), (7, [3.0, 4.0], 0), (7, [-3.0, 4.0], 0), (8, [3.0, 4.01], 0), (9, [-3.0, 4.01], 0)]
    odd = spark.createDataFrame([(*r, 1, "x") for r in few], "vec_id long, embedding array<double>, label int, rep int, vector string")
    assert Counter(map(tuple, embedding_dedup.link_vectors(odd).collect())) == Counter([(None, 4, 4, False)] * 2 + [(4, 4, 4, True), (None, 0, None, False)] + [(5, 4, 4, False)] * 2 + [(6, 0, 6, True), (None, 0, None, False)] + [(7, 1, 7, True)] * 2 + [(8, 1, 7, False), (9, 1, 7, False)])


def test_column_wise_order():
    draw = random.Random(1)
    for _ in range(20):
        texts = list({bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 50))) for _ in range(20)})
        who, start, prefix = suffix_dedup.column_wise_order([np.frombuffer(t, np.uint8).astype(int) + 1 for t in texts], 9)
        got = [texts[w][s:] for w, s in zip(who, start, strict=True)]
        assert got == sorted(t[s:] for t in texts for s in range(len(t) + 1))
        common = [0] + [next(k for k in range(len(a) + 1) if k == min(len(a), len(b)) or a[k] != b[k]) for a, b in itertools.pairwise(got)]
        assert prefix.tolist() == [min(9, c) for c in common]


def test_large_groups_are_cut_alike(monkeypatch):
    draw = random.Random(6)
    core = bytes(draw.choice(b"abcdefgh") for _ in range(60))
    texts = list({bytes(draw.choice(b"ab") for _ in range(20)) + core[draw.randint(0, 9) :] + bytes(draw.choice(b"ab") for _ in range(20)) for _ in range(60)})
    whole = suffix_dedup.repeated_starts(texts, 48)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 300)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.resolve(texts, 48), strict=True))


def removed(units, width, earlier_only):
    """Masks over units (id -> list) of what lies in a repeated window."""
    first, times = {}, {}
    for i in sorted(units):
        for p in range(len(units[i]) - width + 1):
            k = tuple(units[i][p : p + width])
            first.setdefault(k, (i, p))
            times[k] = times.get(k, 0) + 1
    out = {}
    for i, u in units.items():
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - width + 1):
            k = tuple(u[p : p + width])
            if first[k] != (i, p) if earlier_only else times[k] > 1:
                gone[p : p + width] = True
        out[i] = gone
    return out


def unique_rows(extra=()):
    return {i: t or "" for i, t, _ in [*ROWS, *extra]}


def test_word_windows(spark, tmp_path):
    save(docs(spark, ROWS), tmp_path)
    words = {i: t.encode().split() for i, t in unique_rows().items()}
    gone = removed(words, 20, True)
    want = {i: (len(w), int(gone[i].sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g)).hexdigest()) for i, w in words.items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()} == want


def test_byte_strings(spark, tmp_path):
    rows = ROWS[:100]
    save(docs(spark, rows), tmp_path)
    raw = {i: (t or "").encode() for i, t, _ in rows}
    gone = removed(raw, 200, False)
    want = {i: (len(b), int(gone[i].sum()), int((np.diff(np.concatenate(([0], gone[i].astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[i]])).hexdigest()) for i, b in raw.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("hot", [2, 8, 100_000])
def test_one_minimizer_in_a_third_of_documents(spark, tmp_path, monkeypatch, hot):
    """Boilerplate shorter than a window, with other neighbours each time, some of them equal; minimizers dealt window by window or not."""
    draw = random.Random(13)
    letters = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    stock, sides = letters(170), [letters(60) for _ in range(4)]
    rows = [(k, letters(90) + (draw.choice(sides) + stock + draw.choice(sides) if k % 3 == 0 else letters(200)) + letters(90), "s") for k in range(90)]
    rows += [(90, rows[0][1][40:], "s"), (91, rows[3][1], "s"), (92, stock + stock, "s")]
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    save(docs(spark, rows), tmp_path)
    raw = {i: t.encode() for i, t, _ in rows}
    gone = removed(raw, 200, False)
    want = {i: (len(b), int(gone[i].sum()), int((np.diff(np.concatenate(([0], gone[i].astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[i]])).hexdigest()) for i, b in raw.items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()} == want
    assert sum(n > 0 for _, n, _, _ in want.values()) > 10


def test_null_ids_and_repeated_rows(spark, tmp_path):
    save(docs(spark, [(None, PROSE, "s"), (None, SHARED, "s"), (1, PROSE, "s"), (1, PROSE, "s"), (2, None, "s")]), tmp_path)
    assert {n: QUERIES[n](spark, str(tmp_path)).count() for n in ("op5_suffix_dedup", "op6_substring_dedup", "op7_minhash_dedup", "op9_token_counts")} == dict.fromkeys(("op5_suffix_dedup", "op6_substring_dedup", "op7_minhash_dedup", "op9_token_counts"), 5)
    six = sorted((r.doc_id or 0, r.n_removed) for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect())
    assert six == [(0, 0), (0, 120), (1, 0), (1, 0), (2, 0)]


def shingled(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, sf):
    sets = {i: shingled(t) for i, t in unique_rows().items()}
    root = {i: i for i in sets}
    alike = [(i, j) for i, j in itertools.combinations(sets, 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    out = QUERIES["op7_minhash_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.class_id, r.kept) for r in out} == {i: (root[i], root[i] == i) for i in sets}
    assert len(out) == len(ROWS) + 2


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(0)
    h = draw.integers(0, 2**63, 1000).astype(np.uint64)
    for weights in (np.ones(800), draw.integers(1, 9, 800).astype(float), draw.random(800) * 3):
        a, b = dict(zip(h[:800].tolist(), weights, strict=True)), dict(zip(h[150:950].tolist(), weights[::-1], strict=True))
        both = a.keys() | b.keys()
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in both) / sum(max(a.get(k, 0), b.get(k, 0)) for k in both)
        sign = lambda d: minhash_dedup.signature(np.array(list(d), np.uint64), np.array(list(d.values())), 4096)
        assert (sign(a) == sign(b)).mean() == pytest.approx(want, abs=0.03)


def test_sketches_lose_less_than_bands():
    """Pairs at similarity 0.8 that a sketch rules out are fewer than those that share no band."""
    import math

    import pyarrow as pa

    k, p = minhash_dedup.K, 0.8 + 0.2 / 256
    a = np.zeros((k + 1, k), np.uint8)
    b = np.array([[0] * n + [1] * (k - n) for n in range(k + 1)], np.uint8)
    names = [str(n).encode() for n in range(k + 1)]
    batch = pa.RecordBatch.from_pydict({"a": names, "b": names, "sa": [x.tobytes() for x in a], "sb": [x.tobytes() for x in b]})
    passed = {int(n) for out in minhash_dedup.agreeing(iter([batch])) for n in out.column("a").to_pylist()}
    lost = sum(math.comb(k, n) * p**n * (1 - p) ** (k - n) for n in range(k + 1) if n not in passed)
    assert lost < (1 - 0.8**minhash_dedup.ROWS) ** minhash_dedup.BANDS


def test_alignment():
    draw = np.random.default_rng(3)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    for _ in range(100):
        a, b = (draw.integers(0, 4, draw.integers(1, 20)).astype(np.uint64) for _ in range(2))
        score, lo, hi = decontaminate.align(a, b)
        assert score == plain(a, b) == plain(a, b[lo:hi])


def test_contaminated(spark, sf):
    out = {(r.doc_id, r.item_id): r.score for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    assert {d for d, _ in out} == set(range(80, 86)) and {i for _, i in out} == {0, 4}
    assert all(s == 1.0 for (_, i), s in out.items() if i == 0) and all(0.6 < s < 1 for (_, i), s in out.items() if i == 4)


def leaks(spark, texts, items):
    out = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.score for r in out.collect()}


def every(words, n, change=lambda w: ["edit"]):
    return " ".join(x for k, w in enumerate(words.split()) for x in (change(w) if k % n == n - 1 else [w]))


def test_edited_copies_beside_full_ones(spark):
    """A copy is found by its own words, however many documents hold them."""
    item = " ".join(f"i{k}" for k in range(42))
    part = " ".join(item.split()[:22])
    assert set(leaks(spark, [f"{prose(20)} {item} {prose(20)}", f"{prose(20)} {every(item, 6)} {prose(20)}", part.rsplit(" ", 3)[0]], [item])) == {(0, 0), (1, 0)}
    assert set(leaks(spark, [item, every(item, 6)], [item])) == {(0, 0), (1, 0)}
    assert set(leaks(spark, [item] * 4 + [part], [item])) == {(k, 0) for k in range(5)}


def test_copies_without_a_run_of_words(spark):
    """Every third or fourth word replaced, or a word put in after each: no three or no two words lie together."""
    item = " ".join(f"i{k}" for k in range(40))
    texts = [every(item, 4), every(item, 3), every(item, 1, lambda w: [w, "more"]), every(item, 2)]
    assert leaks(spark, texts, [item]) == {(0, 0): pytest.approx(0.64, abs=0.01), (1, 0): pytest.approx(0.51, abs=0.01), (2, 0): pytest.approx(41 / 80)}
    assert leaks(spark, ["some two words here", "two more words", "Two words.", "two words two words", "here"], ["two words", "here", "..."]).keys() == {(2, 0), (4, 1)}


def test_all_pairs_that_score_are_found(spark):
    """As by aligning every document with every item, with small vocabularies and words put in or left out."""
    draw = random.Random(8)
    some = lambda n: " ".join(f"v{int(draw.paretovariate(0.6)) % 60}" for _ in range(n))
    items = [some(draw.randint(4, 45)) for _ in range(25)]
    texts = []
    for t in items * 6:
        out = [x for w in t.split() for x in draw.choice([[w]] * 5 + [["z"], [w, "z"], [], [w, *some(1).split()]])]
        texts.append(f"{some(draw.randint(0, 60))} {' '.join(out)} {some(draw.randint(0, 60))}")
    number = {w: k for k, w in enumerate(sorted({w for t in items + texts for w in t.split()}))}
    coded = lambda t: np.array([number[w] for w in t.split()])
    share = {(d, i): decontaminate.align(coded(a), coded(t))[0] / 2 / len(a.split()) for d, t in enumerate(texts) for i, a in enumerate(items)}
    assert leaks(spark, texts, items) == {k: v for k, v in share.items() if v >= 0.5}


def grouped(rows, alike):
    """Classes of distinct (doc_id, text) rows by brute force: {(doc_id, text): (class_id, kept)}."""
    nodes = sorted({(i is None, i, t) for i, t in rows}, key=lambda n: (n[0], n[1] or 0, hashlib.md5((n[2] or "").encode()).digest()))
    root = list(range(len(nodes)))
    pairs = [(x, y) for x, y in itertools.combinations(range(len(nodes)), 2) if alike(nodes[x][2], nodes[y][2])]
    for _ in range(20):
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    return {(i, t): (nodes[root[k]][1], root[k] == k) for k, (_, i, t) in enumerate(nodes)}


def similar(a, b, weights="set"):
    count = lambda t: Counter(tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(1, len(w) - 4)) if w)
    x, y = count(a), count(b)
    if weights == "set":
        x, y = Counter(set(x)), Counter(set(y))
    return bool(x and y) and sum((x & y).values()) >= 0.8 * sum((x | y).values())


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Two texts of one id keep the links of each; null ids take part and come last; repeated rows are kept together."""
    x, y, z = prose(60), prose(60), prose(60)
    rows = [(1, x), (1, y), (2, edited(x, 1)), (3, edited(y, 1)), (None, edited(z, 1)), (None, z), (None, z), (7, edited(x, 1)), (8, None), (9, ""), (9, ""), (None, None), (10, prose(40))]
    out = minhash_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want = grouped(rows, similar)
    key = lambda t: hashlib.md5((t or "").encode()).digest()
    assert Counter((r.doc_id, bytes(r.key), r.class_id, r.kept) for r in out) == Counter((i, key(t), *want[i, t]) for i, t in rows)
    assert {r.class_id for r in out if r.doc_id == 3} == {1} and want[3, rows[3][1]] == (1, False)


def roots(pairs, nodes):
    root = {n: n for n in nodes}
    for a, b in pairs:
        a, b = root[a], root[b]
        root = {n: min(a, b) if r in (a, b) else r for n, r in root.items()}
    return root


@pytest.mark.parametrize("spread", [0, 6, 12, 20])
def test_links_of_a_block_are_a_forest(spread):
    draw = np.random.default_rng(spread)
    base = draw.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 100 - k], draw.integers(0, 2**63, k, dtype=np.uint64)))) for k in draw.integers(0, spread + 1, 60)]
    names = [bytes([k]) * 16 for k in range(60)]
    part = [names[k - k % (2 if k < 20 else 1)] for k in range(60)]  # the first ones in pairs
    sketch, bands = bytes(minhash_dedup.K), np.arange(minhash_dedup.BANDS).tobytes()
    t = pa.RecordBatch.from_pydict({"bucket": [0] * 60, "i": [0] * 60, "j": [0] * 60, "tile": [0] * 60, "class": names, "part": part, "main": [part[0]] * 60, "size": [len(s) for s in sets], "sketch": [sketch] * 60, "bands": [bands] * 60, "hashes": [s.tobytes() for s in sets], "counts": [b""] * 60})
    got = [(r["a"], r["b"]) for b in minhash_dedup.linked(0.8)(iter([t])) for r in b.to_pylist()]
    every = [(part[x], part[y]) for x in range(60) for y in range(x) if minhash_dedup.alike(sets[x].tobytes(), b"", sets[y].tobytes(), b"", 0.8)]
    assert roots(got, part) == roots(every, part) and len(got) < len(set(part)) < len(every)


def test_heads_are_linked_once(spark):
    draw = random.Random(3)
    pairs = {(f"a{draw.randint(0, 30):02}", f"b{k}") for k in range(400) for _ in range(draw.randint(1, 3))}
    got = [tuple(r) for r in minhash_dedup.stars(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()]
    nodes = {n for p in pairs for n in p}
    assert roots(got, nodes) == roots(pairs, nodes) and len(got) <= 400 + 31 * 30 / 2


def test_borderline_copies_make_few_links(spark, monkeypatch):
    draw = random.Random(11)
    base = [f"w{k}" for k in range(184)]

    def copy(k):  # pairs of such copies are about as often below 0.8 as above
        words = list(base)
        for n, at in enumerate(draw.sample(range(5, 180), draw.choice([1, 2, 2, 3]))):
            words[at] = f"x{k}-{n}"
        return " ".join(words)

    texts, counts, table = [copy(k) for k in range(150)], {}, minhash_dedup.Scratch.table

    def written(self, df, name):
        out = table(self, df, name)
        counts[name] = counts.get(name, 0) + out.count() if name.startswith("links") else 0
        return out

    monkeypatch.setattr(minhash_dedup.Scratch, "table", written)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(180)} for t in texts]
    want = roots([(x, y) for x in range(150) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])], range(150))
    assert got == want and counts["links-first"] < 300 and counts.get("links-second", 0) < 150


def test_near_duplicates_by_counts(spark):
    """Weighted signatures end to end: shingles that occur often count as often."""
    draw = random.Random(4)
    rows = []
    for k in range(40):
        parts = [prose(6) for _ in range(4)]
        weights = [draw.randint(1, 8) for _ in parts]
        for j in range(3):
            own = [max(1, w + draw.choice([-1, 0, 0, 1])) for w in weights]
            rows.append((3 * k + j, " ".join(" ".join([p] * w) for p, w in zip(parts, own, strict=True))))
    out = minhash_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), weights="counts").collect()
    want = {i: v for (i, _), v in grouped(rows, lambda a, b: similar(a, b, "counts")).items()}
    plain = {i: v for (i, _), v in grouped(rows, similar).items()}
    assert {r.doc_id: (r.class_id, r.kept) for r in out} == want != plain
    assert 0 < sum(not k for _, k in want.values()) < len(rows)


def test_recall_of_near_duplicates(spark):
    """Pairs of similarity 0.8 to 0.9, each a group of its own; pairs just below 0.8 stay apart."""
    draw, rows, near = random.Random(9), [], 0
    for k in range(400):
        t = [f"{k}.{j}" for j in range(draw.randint(60, 200))]
        u = list(t)
        for j in draw.sample(range(len(t)), max(1, len(t) // 40)):
            u[j] = "edit"
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
    links = {2 * k + 1 for k in range(400) if similar(rows[2 * k][1], rows[2 * k + 1][1])}
    out = {r.doc_id for r in minhash_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows])).collect() if not r.kept}
    assert 100 < len(links) < 400 and out <= links and len(out) >= 0.99 * len(links)


def test_quality_by_plain_densities(spark):
    """Log-densities of shrunken normals, written out with inverses and determinants."""
    from roadweave.llm import quality

    draw = np.random.default_rng(7)
    x = {c: draw.normal(size=(200, quality.D)) @ draw.normal(size=(quality.D, quality.D)) + c for c in (0, 1)}
    one = {c: np.hstack((np.ones((len(v), 1)), v)) for c, v in x.items()}
    model = quality.fit_discriminant({c: o.T @ o for c, o in one.items()})
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (cov[0] + cov[1]) / 2
    scale = np.sqrt(np.diag(pooled))
    want = []
    for c in (0, 1):
        own, both = (m / np.outer(scale, scale) for m in (cov[c], pooled))
        s = 0.65 * own + 0.3 * both + 0.05 * np.eye(quality.D) * np.trace(own) / quality.D
        d = (x[1][:20] - x[c].mean(0)) / scale
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert model.log_odds(x[1][:20]) == pytest.approx(want[1] - want[0], rel=1e-6)
    assert model.scores(x[1][:20], 4.0) == pytest.approx(1 / (1 + np.exp(-(want[1] - want[0]) / 4)))


def test_null_ids_and_odd_columns_in_scores(spark):
    from roadweave.llm.quality import classify_quality, of_quality
    from roadweave.llm.toxicity import score_toxicity

    rows = docs(spark, [(k, prose(20) if k % 2 else "!!! $$$ ||| " * 9, "s") for k in range(40)] + [(None, prose(9), "s"), (None, None, "s"), (1, "", "s")])
    rows = rows.withColumns({"statistics": F.lit("x"), "score": F.lit("y"), "label": F.lit("z"), "h": F.lit(1)})
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for out in (classify_quality(rows, labels).collect(), score_toxicity(rows, labels).collect()):
        assert len(out) == 43 and sum(r.doc_id is None for r in out) == 2 and not any(r.held_out for r in out if r.doc_id is None)
    kept = of_quality(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(1, 40, 2) if k != 1}


def test_contaminated_rows_of_any_kind(spark):
    item = " ".join(f"i{k}" for k in range(30))
    rows = docs(spark, [(None, f"x {item}", "s"), (None, prose(30), "s"), (4, item, "s"), (4, item, "s"), (4, prose(9), "s"), (5, None, "s"), (6, "", "s"), (7, "v " * 200_000 + item, "s")])
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "the")], "item_id long, text string")
    out = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, items).collect()]
    assert Counter(out) == {(None, 1): 2, (4, 1): 4, (7, 1): 2}
    assert Counter(r.doc_id for r in decontaminate.decontaminated(rows, items).collect()) == {None: 1, 4: 1, 5: 1, 6: 1}
    assert decontaminate.decontaminated(rows, items.limit(0)).count() == rows.count()


def test_seeds_are_the_rare_half_and_lose_nothing(spark):
    """Of an item that many documents hold in part, seeds lie where few do."""
    item = [f"i{k}" for k in range(40)]
    texts = [" ".join(item[:14])] * 30 + [" ".join(item)]
    (block,) = decontaminate.blocks(spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"), 0.5)
    t = decontaminate.with_seeds(spark.createDataFrame([(x,) for x in texts], "text string"), block)
    starts = {int(t.keys[k // 3] >> 32) for k in np.flatnonzero(t.seeds)}
    assert len(starts) == 39 - (38 - 1) // 2 and min(starts) > 13 - 1


def test_recall_of_edited_items(spark):
    """Copies with a fifth of their words changed, left out or put in, against aligning each."""
    draw = random.Random(3)
    items = [prose(draw.randint(20, 60)) for _ in range(30)]
    texts = []
    for t in items * 8:
        w = [x for v in t.split() for x in ([v] if draw.random() > 0.2 else draw.choice([["edit"], [], [v, "more"]]))]
        texts.append(f"{prose(50)} {' '.join(w)} {prose(50)}")
    number = {w: k for k, w in enumerate(sorted({w for t in items + texts for w in t.split()}))}
    coded = lambda t: np.array([number[w] for w in t.split()])
    want = {(d, d % 30) for d, t in enumerate(texts) if decontaminate.align(coded(items[d % 30]), coded(t))[0] >= len(items[d % 30].split())}
    assert len(want) > 200 and want <= leaks(spark, texts, items).keys()


def test_pipeline(spark, sf, none):
    import corpus_pipeline as p

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = [name for name, _ in p.STAGES]
    assert len(kinds) == 5 and frame.columns == p.STAGES[0][1](spark, frame, sf).columns
    near = p.near_copies(spark, frame, sf)
    ids = sorted(r.doc_id for r in near.select("doc_id").collect())
    assert 60 in ids and not {61, 62, 103, 104, 106} & set(ids) and near.columns == frame.columns and len(ids) == len(set(ids))
    clean = {r.doc_id for r in p.test_items(spark, frame, sf).collect()}
    assert clean == {i for i, *_ in ROWS} - set(range(80, 86))
    out = p.run(spark, sf)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and 0 < out.count() <= len(ROWS)
    assert p.run(spark, none).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage against plain Python, with null ids, ids with several texts, repeated rows and columns of clashing names."""
    import corpus_pipeline as p

    item = " ".join(f"i{k}" for k in range(30))
    base = [(k, prose(DRAW.randint(1, 80)), "s") for k in range(30)]
    rows = [*base, (1, edited(PROSE, 1), "s"), (40, edited(PROSE, 1), "s"), (None, PROSE, "t"), (None, prose(50), "t"), (None, f"{prose(9)} {item}", "t"), (2, f"{item} {prose(9)}", None), (2, prose(30), None), (2, prose(30), None)]
    rows += [rows[3], (50, None, "s"), (51, "", "s"), (50, "x token=abcdefghijklmnop", "s"), (None, "AKIA" + "B" * 16, "s"), (None, None, "s")]
    names = ("spans", "_id", "_b", "_blob", "_spans", "_key", "key", "class", "kept", "score", "set", "blob_")
    frame = docs(spark, rows).withColumns({n: F.lit("mine") for n in names})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, texts = str(tmp_path), lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = Counter((i, t) for i, t, _ in rows)
    from roadweave.llm.quality import classify_quality

    scores = classify_quality(frame, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = p.quality(spark, frame, sf)
    assert kept.count() == sum(r.predicted for r in scores) and not texts(kept) - every
    assert Counter(i for i, _ in texts(kept).elements()) == Counter(r.doc_id for r in scores if r.predicted)
    groups = grouped([(i, t) for i, t, _ in rows], similar)
    one = Counter({(i, t): 1 for (i, t), (_, k) in groups.items() if k})
    assert texts(p.near_copies(spark, frame, sf)) == one
    assert texts(p.test_items(spark, frame, sf)) == Counter({k: n for k, n in every.items() if item not in (k[1] or "")})
    hidden = lambda t: t and t.replace("token=abcdefghijklmnop", "[SECRET]").replace("AKIA" + "B" * 16, "[SECRET]")
    red = p.secrets(spark, frame, sf)
    assert texts(red) == Counter((i, hidden(t)) for i, t, _ in rows)
    assert all(r.n_chars == (len(r.text) if "[SECRET]" in (r.text or "") else 0) for r in red.collect())
    assert sum(r.size for r in p.mixing(spark, frame, sf).collect()) == sum(len((t or "").split()) for _, t, _ in rows)
    for stage in (p.quality, p.near_copies, p.test_items, p.secrets):
        out = stage(spark, frame, sf)
        assert out.columns == frame.columns and all(r[n] == "mine" for r in out.collect() for n in names)
    out = p.run(spark, sf).collect()
    good = set(texts(kept))
    left = {n for n, (_, k) in grouped(sorted(good, key=str), similar).items() if k and item not in (n[1] or "")}
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((hidden(t) or "").split())) for i, t in left)


def test_repeated_rows_with_other_columns(spark):
    """One stays, whatever order rows come in."""
    rows = docs(spark, [(1, PROSE, "b"), (1, PROSE, "a"), (2, PROSE, "c")])
    assert [tuple(r) for r in minhash_dedup.one_of_each(rows).collect()] == [tuple(r) for r in minhash_dedup.one_of_each(rows.orderBy("source")).collect()] == [(1, PROSE, "en", "a", 0, 7, "b", "s", "k")]


def test_ledger_is_kept_between_runs(spark, tmp_path):
    import corpus_pipeline as p
    from roadweave.llm import secrets

    path = f"{tmp_path}/ledger"
    spark.conf.set(p.LEDGER, path)
    try:
        for more, blobs in ((0, 2), (1, 3), (1, 3)):
            rows = [(1, "token=abcdefghijklmnop", "s"), (2, "plain", "s"), (3, "AKIA" + "A" * 16, "s")][: 2 + more]
            out = p.secrets(spark, docs(spark, rows), "")
            assert [r.text for r in out.orderBy("doc_id").collect()] == ["[SECRET]", "plain", "[SECRET]"][: 2 + more]
            assert secrets.read_ledger(spark, path).count() == blobs
    finally:
        spark.conf.unset(p.LEDGER)


def test_settings_stay_as_they_were(spark, sf):
    before = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    tables = {t.name for t in spark.catalog.listTables()}
    for name in ("op5_suffix_dedup", "op6_substring_dedup", "op9_token_counts"):
        QUERIES[name](spark, sf)
    assert before == (dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k) for k in before[1]}) and tables == {t.name for t in spark.catalog.listTables()}
