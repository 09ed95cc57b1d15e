"""Operators 3 and 8 and the pipeline against brute force, held-out labels and awkward rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quiverdf.llm import secrets as S
from quiverdf.llm import toxicity as T

FOLDER = "/root/testdata/sf0.001"


# --- secrets -------------------------------------------------------------------------------------------------


def brute_bits(value):
    """The least cost over every way to cut a value, by trying all."""
    structured = S.Segments(value)
    of = {(i, j): c for i in range(len(value)) for j, c, _ in sorted(structured.at(i), key=lambda s: -s[1])}
    best = math.inf
    for cuts in itertools.product((False, True), repeat=len(value) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(value)]
        total, i, last = 0.0, 0, ""
        for j in ends:
            brute = S.OPEN + sum(map(S.char_bits, value[i:j]))
            if (i, j) in of and S.OPEN + of[i, j] < brute:
                total, last = total + S.OPEN + of[i, j], "s"
            else:
                total, last = total + brute, "b"
            i = j
        best = min(best, total)
    return best


@pytest.mark.parametrize("value", ["password1", "abc123xyz", "qwerty99", "aaaabbbb", "20240131x", "P@ssw0rd!", "x7Kq#2pL", "asdf1234", "ababab12"])
def test_guess_bits_brute_force(value):
    bits, cut = S.guess_bits(value)
    assert abs(bits - brute_bits(value)) < 1e-9
    assert [i for i, _, _ in cut] + [len(value)] == [0] + [j for _, j, _ in cut]


def test_weak_values_cost_little():
    assert all(S.guess_bits(v)[0] < 30 for v in ("password123", "qwertyuiop", "aaaaaaaaaaaa", "monkey2019", "abcdefgh"))
    assert all(S.guess_bits(v)[0] > S.LEAST_BITS for v in ("x7Kq#2pLz9", "e3b3ed3cc8548923d6"))
    assert S.guess_bits("a" * 100_000)[0] < 40


def base_spans(t):
    a = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(a, t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[1])))


def test_base_spans_brute_force():
    rng = random.Random(0)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "ſecret", "\n", "x", "deadbeef", "KEY", "a/b+c.d-e="]
    for _ in range(3_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        got = [(a, k, b) for a, b, k, _ in S.find_spans(t) if k != "guess"]
        assert got == base_spans(t), t


@pytest.mark.parametrize("text", [
    "pwd = {qzjxkvbwmfhytr}", "passphrase: {qzjxkvbwmfhytr}", "bearer {qzjxkvbwmfhytr}", "pwd => {Qzjxkvbwmfhytr}", "login = {xK9fQ2Lm}",
    "pwd: {xK9fQ2LmT}", "pwd = {pé8Kq#2ßLz9}", "login: {7Ω!x9Kq2Pz}, ok", "pwd is prohibited", "login: PASSWORDADMIN", "pwd = password123", "login credentials",
])
def test_values_in_context(text):
    want = re.findall(r"\{(.*)\}", text)
    text = text.replace("{", "").replace("}", "")
    assert [text[a:b] for a, b, k, _ in S.find_spans(text) if k == "guess"] == want


def test_guess_adds_and_never_overlaps():
    t = 'pwd: x7Kq#2pLz9!t and passphrase = correct, login hunter2hunter2; auth_token => "Zq8!vR3@kT6$" password=e3b3ed3cc8548923d6'
    spans = S.find_spans(t)
    found = [t[a:b] for a, b, k, _ in spans if k == "guess"]
    assert found == ["x7Kq#2pLz9!t", "Zq8!vR3@kT6$"]
    assert all(b <= c for (_, b, _, _), (c, _, _, _) in itertools.pairwise(sorted(spans)))
    cleaned = S.redact(t, [{"start": a, "end": b, "kind": k} for a, b, k, _ in spans])
    assert "x7Kq" not in cleaned and "[guess]" in cleaned and "[assign]" in cleaned and S.redact(None, []) is None


@pytest.mark.parametrize("text", [
    "login https://www.example.com/help/page", "secret counter-revolutionary", "token classification-based", "login username@example.com",
])
def test_prose_and_addresses_are_no_secrets(text):
    assert S.find_spans(text) == []


def test_words_of_the_corpus_are_guessed(docs):
    """A value of common words is weak, whatever the fixed list; one that only follows = is no common word."""
    texts = [f"the zebrafish and the rhododendron number {i}, pwd = qzjxkvbwmfhytr" for i in range(12)] + [None, "pwd = zebrafish"]
    table = docs([*texts, "login: rhododendron1"])
    words = S.common_words(table)
    assert {"zebrafish", "rhododendron"} <= set(words) and "qzjxkvbwmfhytr" not in words
    got = {r["doc_id"]: [s["kind"] for s in r["secret_spans"]] for r in S.find_secrets(table).collect()}
    assert all(got[i] == ["guess"] for i in range(12)) and got[13] == got[14] == []
    assert S.common_words(table, most=1) == ["and"] or len(S.common_words(table, most=1)) == 1
    assert S.common_words(table.limit(0)) == []


def test_bits_end_at_the_most():
    value = "x7Kq#2pLz9" * 50_000
    assert S.guess_bits(value, most=S.MOST_BITS, cuts=False) == (S.MOST_BITS, [])
    for value in ("password1", "x7Kq#2pL", "P@ssw0rd!", "ABCDEFGH1"):
        assert S.guess_bits(value, most=S.MOST_BITS, cuts=False)[0] == S.guess_bits(value)[0]


def test_secrets_awkward(awkward, docs):
    rows = S.find_secrets(awkward).collect()
    assert len(rows) == 11 and all(r["secret_spans"] == [] for r in rows)
    assert S.find_secrets(awkward.limit(0)).count() == 0
    late = "🙂 " * 50_000 + "token=abcdef1"
    assert [(s["start"], s["end"]) for s in S.find_secrets(docs([late])).first()["secret_spans"]] == [(100_000, 100_013)]


# --- toxicity ------------------------------------------------------------------------------------------------


def labelled(spark, docs, n=600):
    rng = random.Random(1)
    texts, rows = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "rotten"])
        texts.append(" ".join(w))
        rows.append((i, int(bad)))
    return docs(texts), spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("quality", F.lit(1)), dict(rows)


def test_held_out_accuracy(spark, docs):
    table, labels, truth = labelled(spark, docs)
    rows = T.score_toxicity(table, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert 60 < len(held) < 180
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    kept = T.without_toxic(table, labels)
    assert kept.columns == table.columns and 0.6 * 600 < kept.count() < 0.8 * 600


def test_held_out_labels_do_not_matter(spark, docs):
    table, labels, _ = labelled(spark, docs, 200)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in T.score_toxicity(table, x).collect()} for x in (labels, other))
    assert a == b


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (4, 0), (3, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = T.score_toxicity(awkward, labels).collect()
    assert len(rows) == 11
    assert {r["score"] for r in T.score_toxicity(awkward, labels.limit(0)).collect()} == {0.0}
    assert T.score_toxicity(awkward.limit(0), labels).count() == 0
    assert T.without_toxic(awkward, labels.limit(0)).count() == 11


def test_ftrl_is_sparse_and_sequential():
    rng = np.random.default_rng(2)
    rows = [(np.append(rng.choice(1_000, 20, replace=False) + 10, i % 2), i % 2) for i in range(400)]
    w = T.fitted([(a.astype(np.int32), y) for a, y in rows], bits=11).weights()
    assert w[1] > 1 and w[0] < 0 and (np.abs(w) > 0).sum() < 600


def test_ftrl_brute_force():
    """The steps in plain dictionaries, one model after another."""
    rng = np.random.default_rng(3)
    rows = [(np.append(rng.choice(60, 7, replace=False), 64).astype(np.int32), int(rng.random() < 0.4)) for _ in range(150)]
    side = T.Ftrl(6, (0.1, 0.7, 2.0))
    for at, y in rows * 2:
        side.learn(at, y)
    for m, l1 in enumerate((0.1, 0.7, 2.0)):
        z, n = {}, {}

        def weight(i, z=z, n=n, l1=l1):
            if abs(z.get(i, 0.0)) <= l1:
                return 0.0
            return -(z[i] - math.copysign(l1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

        for at, y in rows * 2:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / T.ALPHA * w[i]
        assert np.allclose([weight(i) for i in range(65)], side.weights(m), atol=1e-9)


def test_repeated_ids_do_not_crowd_the_training(spark, docs):
    table = docs([(i % 40, f"w{i % 7} x{i % 3}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    rows = T.training_rows(table, labels, 10)
    assert rows.count() == 10 and T.training_rows(table, labels).count() <= 40
    assert len(T.train(T.training_rows(table, labels), most_features=0)[0]) == 0


# --- pipeline ------------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n > before if name == "mixing" else n < before, name
    out = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert out.count() == before and {"shard", "slot"} <= set(out.columns)


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    key = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert key(rows) == key(docs)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, awkward, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, awkward, FOLDER)
    assert set(awkward.columns) <= set(out.columns), name
    assert out.count() > 0
    assert f(spark, awkward.limit(0), FOLDER).count() == 0
