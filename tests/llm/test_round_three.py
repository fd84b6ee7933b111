"""Hard negatives, chat formatting and the filter audit against brute force, exact round trips and odd input."""

import hashlib
import json
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadweave.llm import chat_format as C
from roadweave.llm import filter_audit, hard_negatives
from roadweave.llm.queries import QUERIES

# ---------------------------------------------------------------- hard negatives


def mined(rows, n_positives=5, n_negatives=10, every=10):
    """rows: (id, label, vector); anchors have ids divisible by `every`. One tuple for each anchor, positive and negative."""
    good = [(k, i, y, [int(np.floor(256 * x)) for x in v]) for k, (i, y, v) in enumerate(rows) if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, i, y, v in good:
        if i is None or i % every:
            continue
        scored = sorted(((-dot(v, w), j is None, j or 0, m, z) for m, j, z, w in good if m != k))
        for s, _, j, m, _ in [r for r in scored if r[4] == y][:n_positives]:
            hard = [r for r in scored if r[4] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:n_negatives]
            out += [(i, good_id(rows, m), rank, good_id(rows, r[3]), -s, -r[0]) for rank, r in enumerate(hard, 1)]
    return out


def good_id(rows, k):
    return rows[k][0]


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, "x", 5) for i, y, v in rows], "vec_id long, label int, embedding array<float>, id string, row int").repartition(1)


def compare(spark, rows, **sizes):
    df = vectors(spark, rows).drop("id", "row") if sizes.pop("plain", False) else vectors(spark, rows)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0, **sizes).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(mined([(i, y, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]), key=key)
    return got


def test_negatives_equal_brute_force_over_many_panels(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 12))
    rows = [(k, int(y), (centres[y] * 0.4 + draw.normal(size=12) * 0.25 + 0.2).tolist()) for k, y in enumerate(draw.choice(6, 400, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]))]
    got = compare(spark, rows, panel=64, per_anchor_panel=8)
    assert len(got) > 500 and {r[2] for r in got} == set(range(1, 11))
    assert sorted(got) == sorted(compare(spark, rows, panel=64, per_anchor_panel=8, depth=5))  # whatever the chunks of dimensions


def test_negatives_of_odd_rows(spark):
    v = [0.5, 0.25, 0.1]
    rows = [
        (0, 1, v), (10, 1, v), (10, 1, v), (None, 1, v), (None, 2, [0.3, 0.1, 0.0]), (3, 2, [0.3, 0.1, 0.0]), (4, 2, [0.3, 0.1]), (4, 2, [0.3, 0.1]), (5, 2, []), (6, None, v), (7, 2, None), (8, 2, [0.3, None, 0.1]),
        (9, 2, [float("nan"), 0.0, 0.1]), (11, 2, [float("inf"), 0.0, 0.1]), (20, 3, v), (30, 4, [-0.5, -0.25, -0.1]), (31, 4, [0.5, 0.2, 0.1]), (40, 5, [0.0, 0.0, 0.0]), (41, 5, [0.1, 0.0, 0.0]),
    ]
    got = compare(spark, rows, panel=4, per_anchor_panel=2)
    assert any(r[3] is None for r in got) and {r[0] for r in got} >= {0, 10}
    assert hard_negatives.mine(vectors(spark, []), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives.mine(vectors(spark, [(1, 1, v)]), F.col("id") % 10 == 0).collect() == []


def test_scores_never_overflow(spark):
    rows = [(0, 1, [3e38, 3e38]), (1, 1, [3e38, 3e38]), (2, 2, [3e38, -1e30]), (3, 2, [1e38, 1e35])]
    assert all(r.positive_score > 0 for r in hard_negatives.mine(vectors(spark, rows), F.col("id") == 0).collect())
    a = np.array([[2**31, 5]])
    assert hard_negatives.product(a, a).tolist() == [[2**62 + 25]]
    assert hard_negatives.wide(hard_negatives.narrow(np.array([-(2**40), 7]))).tolist() == [-(2**40), 7] and not len(hard_negatives.wide(hard_negatives.narrow(np.array([], np.int64))))


# ---------------------------------------------------------------- chat formatting

ALPHABET = st.sampled_from(["<", ">", "/", "[", "]", "\\", "s", "</s>", "<s>", "[INST]", " [/INST]", "<<SYS>>", "\n<</SYS>>", "[TURN]", "[/TURN]", "<|im_end|>", "%0A", "%", "\n", "é", "𝄞", " ", "</s", "INST]"])
TEXT = st.lists(ALPHABET, max_size=12).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_formatted_turns_read_back_whatever_they_say(turns):
    w = C.Writer(C.INST)
    reader = C._Reader(1, w)
    pieces = [w.piece(r, t) for r, t in turns]
    held, back = "".join(p[0] for p in pieces), []
    while held:
        role, text, a, b, over = w.parse(held)
        back.append((role, text))
        held = held[over:]
    assert back == turns
    for p in pieces:
        reader.feed(*p)
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert reader.row() == (1, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len(p[0]) for p in pieces))
    for _, t in turns:  # no control string is left in a text
        assert not any(c in w.escaped(t) for c in C.INST.controls) and w.restored(w.escaped(t)) == t


def test_templates_are_checked():
    with pytest.raises(ValueError):
        C.Writer(C.Template(marks={"user": ("<a>", "</a>")}, other=("<o>", "\n", "</o>"), controls=("<a>", "</a>", "<o>", "</o>", "a><")))
    with pytest.raises(ValueError):
        C.Writer(C.Template(marks={"user": ("plain ", "</a>")}, other=("<o>", "\n", "</o>"), controls=("</a>", "<o>", "</o>")))


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}, [("user", "pq")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "system": "be"}, [("system", "be"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "response": "done", "context": "here", "category": "x"}, [("user", "do\n\nhere"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "source": {"name": "n"}}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": 42}, [("user", "q"), ("assistant", "42")]),
    ({"dialog": [{"speaker": "bot", "text": "hi"}]}, [("assistant", "hi")]),
    ({"something": "else"}, []),
]


def test_json_records_of_every_layout(spark):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(97, None), (98, "{"), (99, "[1]"), (None, json.dumps(RECORDS[6][0]))]
    df = spark.createDataFrame([(i, j, 1) for i, j in rows], "conv_id long, j string, text int")
    got: dict = {}
    for r in C.turns_of_json(df, "j").orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: t for k, (_, t) in enumerate(RECORDS) if t} | {None: RECORDS[6][1]}
    counts = C.layouts(df, "j").collect()
    assert sum(r.n for r in counts) == len(rows) and sum(r.n for r in counts if r.mapping is None) == 4
    assert len({r.fingerprint for r in counts}) >= 10


def test_typed_tables_of_every_layout(spark):
    for record, want in RECORDS[:-1]:
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"conv_id": 5})])).withColumn("turns", F.lit(1))
        got = [(r.role, r.text) for r in C.canonical_turns(df).orderBy("turn").collect()]
        assert got == want, record
    with pytest.raises(ValueError):
        C.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, something string"))


def test_chat_query_on_odd_rows(spark, tmp_path):
    long = "<s>[INST]" * 120_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, None, "</s>"), (2, 0, "tool\n", "x"), (2, 0, "tool\n", "x"), (None, 3, "assistant", "y"), (3, 0, "assistant", long), (3, 0, "assistant", "a")]
    schema = "conv_id long, turn long, role string, text string, piece string, prompt string"
    spark.createDataFrame([(*r, "p", "q") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op12_chat_format"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert got[1].turns_sha256 == digest("user\n\nassistant\n\n") and got[1].loss_chars == 0 and got[1].loss_sha256 == digest("")
    assert got[2].n_turns == 3 and got[2].turns_sha256 == digest("tool\n\nx\n" * 2 + "\n</s>\n")
    assert got[None].loss_sha256 == digest("y")
    assert got[3].loss_chars == len(long) + 1 and got[3].loss_sha256 in (digest(long + "a"), digest("a" + long))
    assert got[-7].loss_sha256 == digest("</s>[INST] ok [/INST]") and got[-7].formatted_chars > 2 * len("</s>[INST] ok [/INST]") + 20
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in QUERIES["op12_chat_format"](spark, f"{tmp_path}/none").collect()] == [-7]


# ---------------------------------------------------------------- filter audit


def audited(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). One filter after another, in every order."""
    fails = []
    for i, t, s in docs:
        t = t or ""
        words = t.encode().split()
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((s or "", f, any(k == i and q == 1 for k, q, _ in labels if k is not None), any(k == i and x == 1 for k, _, x in labels if k is not None)))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        mine = [r for r in fails if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, order, step] = (len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, 1, "h", "m") for i, t, s in docs], "doc_id long, text string, source string, part int, hash string, mask string")
    y = spark.createDataFrame([(i, q, x, "n") for i, q, x in labels], "doc_id long, quality int, toxic int, part string")
    rows = filter_audit.audit_filters(d, y).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_running_every_order(spark):
    draw = random.Random(4)
    docs = []
    for k in range(120):
        n = draw.choice([3, 150, 199, 200, 260])
        pool = [f"w{j}" for j in range(draw.choice([40, 100, 400]))]
        t = " ".join(draw.choices(pool, k=n)) + draw.choice(["", "", " # x", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF"])
        docs.append((k, docs[draw.randrange(k)][1] if k and draw.random() < 0.3 else t, draw.choice(["s1", "s2", "s2", None, ""])))
    docs += [(5, docs[5][1], "s1"), (None, docs[5][1], "s1"), (None, None, None), (900, "", "s3"), (901, None, "s3"), (902, "word " * 200_000 + "é" * 10, "s3"), (903, "A" * 300_000, "s4")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, None), (None, 1, 1)]
    want = audited(docs, labels)
    assert audit(spark, docs, labels) == want and len(want) == 5 * 600
    assert {k: v[6] for k, v in want.items() if v[6]}


def test_audit_of_more_parts_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 4)
    docs = [(k, "one two", f"s{k % 11}") for k in range(40)]
    assert audit(spark, docs, [(3, 1, 0)]) == audited(docs, [(3, 1, 0)])
    batch = filter_audit.pa.RecordBatch.from_pydict({"part": [f"s{k % 11}" for k in range(40)], "mask": [k % 32 for k in range(40)], "label": [k % 4 for k in range(40)]})
    few = list(filter_audit._accumulate(iter([batch, batch.slice(0, 7)])))
    assert sum(sum(b.column("kept").to_pylist()[4::600]) for b in few) == sum(m == 0 for m in [*range(32), *range(8), *range(7)])


def test_audit_of_empty_tables(spark):
    assert audit(spark, [], []) == {}
    got = audit(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("mask", range(32))
def test_first_failures(mask):
    for k, order in enumerate(filter_audit.ORDERS):
        first = next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)
        assert filter_audit.FIRST[mask, k] == first and "".join("ABCDE"[f] for f in filter_audit.AT[k]) == order


# ---------------------------------------------------------------- mended operators


def test_toxicity_of_pairs_that_say_nothing_alone(spark):
    """Toxic: both of two words, or neither. Through the whole operator."""
    from roadweave.llm import toxicity

    draw = random.Random(9)
    pool = [f"word{k}" for k in range(400)]
    texts, label = [], []
    for _ in range(3000):
        both = draw.random() < 0.5, draw.random() < 0.5
        words = draw.choices(pool, k=25) + [w for w, b in zip(("alpha", "bravo"), both, strict=True) if b]
        draw.shuffle(words)
        texts.append(" ".join(words))
        label.append(int(both[0] == both[1]))
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    y = spark.createDataFrame([(k, v) for k, v in enumerate(label)], "doc_id long, toxic int")
    rows = [r for r in toxicity.score_toxicity(d, y).collect() if r.held_out]
    assert len(rows) > 400 and sum(r.predicted == label[r.doc_id] for r in rows) / len(rows) >= 0.95
    sample = toxicity.labelled_sample(d, y, 5000)
    assert set(toxicity.paired_buckets(sample)) >= {b for w in ("alpha", "bravo") for b in toxicity.word_terms(w) if b % 2 == 0}
    assert not len(toxicity.paired_buckets(sample.where("label = 1")))


def test_toxicity_scores_are_the_machine_on_every_text(spark):
    """The whole query against terms and pairs counted one by one."""
    from roadweave.llm import toxicity

    draw = random.Random(2)
    docs = [(k, " ".join(draw.choices(["Good", "day", "sir", "vile,", "scum!", "they", "are"], k=draw.randrange(12)))) for k in range(300)] + [(None, "vile"), (5, None), (7, ""), (900, "scum " * 200_000), (901, "x" * 5_000_000)]
    labels = [(k, int("scum" in t and "they" in t)) for k, t in docs[:300]]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(d, y, 5000)
    place = {int(b): k for k, b in enumerate(m.buckets)}
    got = sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score_toxicity(d, y).collect())
    want = []
    for i, t in docs:
        known = sorted({place[b] for w in set((t or "").lower().split()) for b in toxicity.word_terms(w) if b in place})
        z = m.bias + sum(m.w[k] for k in known) + sum(float(m.v[a] @ m.v[b]) for n, a in enumerate(known) for b in known[n + 1 :])
        want.append((i or -1, round(1 / (1 + np.exp(-z)), 9)))
    assert [(i, pytest.approx(s)) for i, s in sorted(want)] == got


def test_rows_without_ids_are_spread_over_shards(spark):
    from roadweave.llm.mixing import mix_sources

    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat_ws(" ", *(F.lit(w) for w in "a b c d e f g h i".split()), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    shards = mix_sources(df, shard_words=2000).groupBy("shard").count().collect()
    assert len(shards) == 200 and max(r["count"] for r in shards) < 2 * 200
    same_id = df.withColumn("doc_id", F.lit(1))
    assert max(r["count"] for r in mix_sources(same_id, shard_words=2000).groupBy("shard").count().collect()) < 2 * 200


def test_a_log_full_of_hashes(spark):
    import time

    from roadweave.llm import secrets

    n = 30_000
    text = "\n".join(f"{k:032x}" for k in range(n))
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, blob string")
    began = time.time()
    got = secrets.scan_and_keep(df, None).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("last"), F.element_at("spans", 7_000)["start"].alias("mid")).first()
    assert (got.n, got.last, got.mid) == (n, len(text), 6_999 * 33) and time.time() - began < 30
    clean = secrets.redacted(df).first().text
    assert clean == "\n".join(["[SECRET]"] * n) and time.time() - began < 90


def test_redaction_equals_slicing(spark):
    from roadweave.llm import secrets

    draw = random.Random(4)
    rows = []
    for k in range(60):
        size = draw.choice([0, 5, 900, 1024, 1025, 5000])
        text = "".join(draw.choice("ab𝄞é\n ") for _ in range(size))
        spans = sorted((a, draw.randrange(3), min(size, a + draw.choice([1, 3, 40, 1500])), "k") for a in (draw.randrange(size) for _ in range(draw.choice([0, 1, 4, 30, 700]) if size else 0)))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, f"blob long, text string, spans {secrets.SPAN}").repartition(3)
    whole = df.drop("spans").join(secrets.merged(df), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    got = {r.blob: r.out for r in whole.select("blob", secrets.redact(F.col("text"), F.col("spans")).alias("out")).collect()}
    for k, text, spans in rows:
        out, at, end = "", 0, None
        for a, _, b, _ in spans:
            if end is None or a > end:
                out += text[at:a] + "[SECRET]"
                end = b
            end = max(end, b)
            at = end
        assert got[k] == out + text[at:]


def test_workers_keep_no_long_words():
    import xxhash

    from roadweave.llm import _kit, token_counts, toxicity

    cache = _kit.WordHashes()
    words = [b"x" * 65, b"y", b"z" * 5_000_000]
    assert [int(h) for h in cache.of(words)] == [xxhash.xxh64_intdigest(w) for w in words] and list(cache) == [b"y"]
    terms = toxicity.Terms(tuple)
    assert sorted(terms["a" * 100]) == sorted(toxicity.word_terms("a" * 100)) and not terms
    table = type("T", (), {"cuts": staticmethod(str.split), "count_many": staticmethod(lambda ws: [len(w) for w in ws])})()
    counter = token_counts.Counter(table)
    assert counter.totals(["ab " + "漢" * 20_000, "ab", ""]) == [20_002, 2, 0] and dict(counter) == {"ab": 2}


@pytest.mark.parametrize("name", ["op4_quality", "op5_suffix_dedup", "op6_substring_dedup", "op7_minhash_dedup", "op9_token_counts"])
def test_unbroken_texts_of_megabytes(spark, tmp_path, name):
    """Long texts without a blank, and one of very many words."""
    rows = [(1, "漢字" * 800_000), (2, "QUJD" * 1_250_000), (3, "w " * 2_000_000), (4, "plain text"), (5, "漢字" * 800_000)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    if name == "op9_token_counts":
        assert [out[k].n_bytes for k in (1, 2, 3)] == [4_800_000, 5_000_000, 4_000_000] and out[1].n_tokens == out[5].n_tokens > 0
    if name == "op5_suffix_dedup":
        assert out[1].n_removed == 4_800_000 and out[3].n_removed == 4_000_000 and out[4].n_removed == 0
    if name == "op6_substring_dedup":
        assert (out[3].n_words, out[3].n_removed, out[1].n_words) == (2_000_000, 2_000_000 - 1, 1)
    if name == "op7_minhash_dedup":
        assert out[5].class_id == 1 and [out[k].kept for k in (1, 2, 3, 4, 5)] == [True, True, True, True, False]
