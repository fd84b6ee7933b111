"""Source mixing and secret scans: DataFrame functions only."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadweave.llm import mixing, secrets
from roadweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, blob string, shard string, key string"


def docs(spark, rows):
    """Extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "b", "s", "k") for i, t, s in rows], SCHEMA)


def save(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_quotas_are_highest_quotients(spark):
    draw = random.Random(1)
    for seats in (1, 7, 40, 500):
        votes = {k: draw.choice([0, 1, 5, 90, 1000, 4321]) for k in range(9)}
        df = spark.createDataFrame(list(votes.items()), "name long, v long")
        got = {r.name: r.quota for r in mixing.sainte_lague(df, [], "name", F.col("v"), F.lit(seats)).collect()}
        order = sorted(((-v / (2 * k - 1), n) for n, v in votes.items() if v for k in range(1, seats + 1)))[:seats]
        want = Counter(n for _, n in order)
        assert got == {n: want.get(n, 0) for n in votes}


def test_targets_fill_like_the_rounds_they_stand_for(spark):
    draw = random.Random(3)
    for _ in range(4):
        sizes = {f"s{k}": draw.choice([0, 3, 50, 400, 9000]) for k in range(8)} | {None: 77}
        got = {r.source: r.target for r in mixing.water_level(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3).collect()}
        names = sorted(k for k in sizes if k is not None) + [None]
        weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
        total, full = sum(sizes.values()), {}
        while True:  # share, stop what is above, share the rest anew
            rest = {n: (total - sum(full.values())) * weight[n] / sum(weight[m] for m in names if m not in full) for n in names if n not in full}
            over = {n: 3.0 * sizes[n] for n, t in rest.items() if t > 3 * sizes[n]}
            if not over:
                break
            full |= over
        want = {**full, **rest}
        assert all(got[n] == pytest.approx(want[n]) for n in names)


def test_mix(spark):
    draw = random.Random(5)
    rows = [(k, " ".join("w" * draw.randint(1, 5) for _ in range(draw.randint(0, 60))), draw.choice(["a", "a", "a", "b", "cé", None])) for k in range(400)]
    rows += [(400, None, "a"), (None, "x y", "b"), (401, "  one", "b"), (7, rows[7][1], rows[7][2]), (402, "v " * 30_000, "b")]
    df = docs(spark, rows)
    got = mixing.mix_sources(df, block_words=16, shard_words=1000)
    out = got.collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, words(t)) for i, t, _ in rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(taken - target) <= 16 + 0.02 * target for taken, target in by.values())
    again = mixing.mix_sources(df.repartition(7), block_words=16, shard_words=1000)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out))
    assert mixing.mix_sources(df.limit(0)).count() == 0


RULES = (
    ("assign", re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def base_spans(text):
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(RULES) for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return ",".join(f"{n}:{a}:{e}" for a, _, e, n in found)


def test_secrets_equal_brute_force(spark, tmp_path):
    draw = random.Random(8)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "x", "é", "\U0001f600", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "longvalue-1234"]
    rows = [(k, "".join(draw.choice(bits) for _ in range(draw.randint(0, 25))), "s") for k in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (None, "token=abcdefghijklmnop", "s"), (5, rows[5][1], "s"), (302, rows[5][1], "s"), (303, "a" * 200_000, "s"), (304, 'token=secret":abcdefghijklmnop', "s")]
    save(docs(spark, rows), tmp_path)
    out = QUERIES["op8_secret_scans"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        s = base_spans(t)
        want[i, s.count("assign:"), s.count("access:"), s.count("hex:"), hashlib.sha256(s.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    texts = dict((i, t) for i, t, _ in rows)
    assert all(set(filter(None, base_spans(texts[r.doc_id]).split(","))) <= set(r.spans.split(",")) for r in out)
    assert any("pem:" in r.spans for r in out) and any("hub:" in r.spans for r in out)
    assert "Python" not in QUERIES["op8_secret_scans"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_ledger_scans_only_unseen_blobs(spark):
    old = docs(spark, [(1, "token=abcdefghijklmnop", "s"), (2, "plain", "s")])
    found, ledger = secrets.scan_history(old)
    assert ledger.count() == 2
    more = docs(spark, [(1, "token=abcdefghijklmnop", "s"), (3, "plain", "s"), (4, "AKIA" + "A" * 16, "s")])
    found, new = secrets.scan_history(more, ledger)
    assert new.count() == 1 and {r.doc_id: len(r.spans) for r in found.collect()} == {1: 1, 3: 0, 4: 1}
    _, all_new = secrets.scan_history(more, ledger, version="2")
    assert all_new.count() == 3
    assert secrets.scan_history(more.limit(0))[0].count() == 0


def test_scans_write_few_files_and_sort_no_texts(spark, monkeypatch):
    plans, files, table = {}, {}, secrets.Scratch.table

    def written(self, df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        out = table(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(secrets.Scratch, "table", written)
    rows = [(k, f"token=abcdefghijkl{k % 40} 0123456789abcdef", "s") for k in range(64)]
    found, new = secrets.scan_history(docs(spark, rows).repartition(16))
    assert sorted(files) == ["hits", "paths"] and sum(files.values()) <= 4
    assert "ShuffledHashJoin" in plans["hits"] and "SortMergeJoin" not in plans["hits"]
    assert new.count() == 40 and [len(r.spans) for r in found.collect()] == [2] * 64


def test_redaction_sorts_no_texts(spark):
    out = secrets.redacted(docs(spark, [(k, f"token=abcdefghijkl{k % 40} x" if k % 2 else "plain", "s") for k in range(64)]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.text for r in out.collect()) == ["[SECRET] x"] * 32 + ["plain"] * 32


def test_redaction(spark):
    found, _ = secrets.scan_history(docs(spark, [(1, "a token=abcdefghijklmnop b 0123456789abcdef c", "s"), (2, "nothing", "s")]))
    t = docs(spark, [(1, "a token=abcdefghijklmnop b 0123456789abcdef c", "s"), (2, "nothing", "s")]).select("doc_id", "text").join(found, "doc_id")
    assert {r.doc_id: r.t for r in t.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()} == {1: "a [SECRET] b [SECRET] c", 2: "nothing"}
