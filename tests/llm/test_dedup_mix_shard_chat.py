"""Operators 1, 2, 4 and 7 against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiverdf.llm import chat, registry
from quiverdf.llm.exact_dedup import exact_dedup, heavy_digests
from quiverdf.llm.mixing import mix_sources, mixed_documents
from quiverdf.llm.sharding import balanced_shards, sharded_documents

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), c.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: "" if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v
    rows = lambda d: sorted(str([plain(v) for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


# --- exact deduplication -------------------------------------------------------------------------------------


def even(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("counters", [8, 16_384])
def test_dedup_brute_force(docs, counters):
    rng = random.Random(0)
    texts = ["hot  text"] * 60 + [f"t{rng.randrange(40)}" + " " * rng.randrange(2) for _ in range(120)] + ["\x0b", " ", "", None]
    rng.shuffle(texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[even(t)].append(i)
    got = exact_dedup(docs(texts), counters=counters, most=4).collect()
    assert len(got) == len(texts)
    for r in got:
        group = groups[even(texts[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(group), len(group), r["doc_id"] == min(group))
        assert bytes(r["digest"]) == hashlib.sha256(even(texts[r["doc_id"]]).encode()).digest()


def test_sketch_finds_the_heavy_digest(spark):
    table = spark.createDataFrame([(bytes(8) if i % 3 == 0 else i.to_bytes(8, "big"),) for i in range(3_000)], "digest binary")
    found = [r["head"] for r in heavy_digests(table, 64, 8).collect()]
    assert 0 in found and len(found) <= 8


def test_dedup_awkward(awkward):
    got = exact_dedup(awkward).collect()
    assert len(got) == 11
    kept = Counter(r["keep_id"] for r in got if r["kept"])
    assert all(n == 1 for n in kept.values())
    assert {r["keep_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert {r["keep_id"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert [r["keep_id"] for r in got if r["doc_id"] == 2] == [2]  # a blank is not empty
    assert exact_dedup(awkward.limit(0)).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------


def check_shards(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1 and set(sizes) <= set(range(shards))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_shards_are_even_and_keep_groups(docs):
    rng = random.Random(1)
    texts = [f"group {i}" for i in range(30) for _ in range(rng.randrange(1, 6))] + [f"single {i}" for i in range(300)]
    rows = balanced_shards(docs(texts), shards=7).collect()
    check_shards(rows, 7)
    where = defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        where[t].add(r["shard"])
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
    assert all(len(v) == 1 for v in where.values())


def test_a_group_of_a_third_of_all_rows(docs):
    texts = ["hot"] * 100 + [f"single {i}" for i in range(200)]
    rows = balanced_shards(docs(texts), shards=10).collect()
    check_shards(rows, 10)
    start = 10  # a hash would put it everywhere
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "hot"}) < start


def test_shards_awkward(awkward):
    rows = balanced_shards(awkward, shards=3).collect()
    assert len(rows) == 11
    check_shards(rows, 3)
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {16}
    out = sharded_documents(awkward, shards=3)
    assert out.count() == 11 and out.where("grp = 'own'").count() == 11
    assert set(out.columns) == set(awkward.columns)
    assert balanced_shards(awkward.limit(0)).count() == 0


def test_more_shards_than_rows(docs):
    check_shards(balanced_shards(docs(["a", "b", "a"]), shards=5).collect(), 5)


def test_reruns_agree(docs):
    table = docs([f"t{i % 9}" for i in range(50)])
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in balanced_shards(table, shards=4).collect()) for _ in range(2))
    assert a == b


# --- mixing --------------------------------------------------------------------------------------------------


def fill(sizes, share=1.5, most=2):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, whole = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = whole - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("range_rows", [5, 4_096])
def test_mix_meets_targets(docs, range_rows):
    rng = random.Random(2)
    texts = ["w " * rng.randrange(0, 40) for _ in range(300)]
    source = {i: rng.choice(["a"] * 6 + ["b", "c", "é", None]) for i in range(300)}
    sizes = Counter()
    for i, t in enumerate(texts):
        sizes[source[i]] += len(t.split())
    want = fill(sizes)
    rows = mix_sources(docs(texts, source=source), range_rows=range_rows).collect()
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)


def test_mix_awkward(docs, awkward):
    rows = mix_sources(awkward).collect()
    assert len(rows) == 11 and sum(r["taken"] for r in rows) == int(1.5 * sum(r["size"] for r in rows))
    out = mixed_documents(awkward)
    assert out.columns == awkward.columns and out.where("size = 'own'").count() == out.count()
    often = Counter(r["doc_id"] for r in mixed_documents(docs(["a b"] * 20)).collect())
    assert sum(often.values()) == 30 and max(often.values()) == 2
    assert mix_sources(awkward.limit(0)).count() == 0 == mixed_documents(awkward.limit(0)).count()
    assert sum(r["taken"] for r in mix_sources(docs(["", None])).collect()) == 0


# --- chat formatting -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", chat.PROBE, "\\", "\\\\|", "<|", "<\\|", "<<|im_end|>", "a\n<|im_end|>\n", "ends with <", "🙂é"])
def test_escape_is_reversible(spark, text):
    t = F.lit(text)
    row = spark.range(1).select(chat.unescape(chat.escape(t)), chat.escape(t), chat.read_turns(F.concat(chat.format_turn(F.lit("us\ner\\_"), t), chat.format_turn(F.lit("assistant"), t)))).first()
    assert row[0] == text and "<|" not in row[1]
    assert [(r["role"], r["text"]) for r in row[2]] == [("us\ner\\_", text), ("assistant", text)]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_conversations_come_back(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t} " + chat.PROBE * (t % 2)) for c in range(9) for t in range(c + 1)]
    out = chat.format_conversations(conversations(spark, rows)).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    for r in out:
        assert [(x["role"], x["text"]) for x in r["t"]] == [(a[2], a[3]) for a in sorted(rows) if a[0] == r["conv_id"]]
    assert len(out) == 9


def test_conversations_awkward(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 5, "user", None), (1, 5, "user", None), (1, 9, "assistant", "x" * 200_000)]
    out = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(conversations(spark, rows)).collect()}
    assert set(out) == {None, 1}
    assert out[1].count(chat.START) == 3 and len(out[1]) > 200_000
    assert out[None].index("<|im_start|>\n") < out[None].index("user")  # a null turn comes first
    assert chat.format_conversations(conversations(spark, rows).limit(0)).count() == 0


def test_best_branches_of_a_tree(spark):
    """        0 - 1 - 2 (leaf, 9)      and 10 - 11, a second tree
               |   ` 3 - 4 (leaf, 1 + 1)
               ` 5 (leaf, 2)            (scores)"""
    rows = [(0, None, 0.0), (1, 0, 0.0), (2, 1, 9.0), (3, 1, 1.0), (4, 3, 1.0), (5, 0, 2.0), (10, None, 0.0), (11, 10, None), (20, 99, 1.0)]
    messages = spark.createDataFrame([(n, p, "user", f"m{n}", s) for n, p, s in rows], "node long, parent long, role string, text string, score double")
    path = lambda r: [x["text"] for x in r["t"]]
    best = chat.format_paths(messages).withColumn("t", chat.read_turns(F.col("formatted"))).collect()
    assert {r["tree"]: path(r) for r in best} == {0: ["m0", "m1", "m2"], 10: ["m10", "m11"], 20: ["m20"]}
    two = chat.format_paths(messages, 3).where("tree = 0").withColumn("t", chat.read_turns(F.col("formatted"))).orderBy("rank").collect()
    assert [path(r) for r in two] == [["m0", "m1", "m2"], ["m0", "m1", "m3", "m4"], ["m0", "m5"]]


def test_deep_path(spark):
    n = 70
    messages = spark.createDataFrame([(i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(n)], "node long, parent long, role string, text string, score double")
    row = chat.format_paths(messages).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [x["text"] for x in row["t"]] == [f"m{i}" for i in range(n)]


def test_groups_of_up_to_a_shard_are_not_cut_in_advance(docs):
    """A group of nine tenths of a shard ends together, all but a few rows."""
    from collections import Counter

    from quiverdf.llm import sharding

    rows = docs([f"text {i}" for i in range(710)] + ["the same"] * 90)
    out = sharding.balanced_shards(rows, shards=8).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {100}
    assert max(Counter(r["shard"] for r in out if r["doc_id"] >= 710).values()) >= 80


def test_cut_links_brute_force(docs):
    rng = random.Random(4)
    texts = [f"group {i}" for i in range(40) for _ in range(rng.randrange(1, 9))] + ["large"] * 60 + ["", None]
    rows = balanced_shards(docs(texts), shards=6).collect()
    check_shards(rows, 6)
    for r in rows:
        same = [o for o in rows if (texts[o["doc_id"]] or "") == (texts[r["doc_id"]] or "")]
        assert r["n_links"] == len(same) - 1
        assert r["cut"] == sum(o["shard"] != r["shard"] for o in same)
    assert sum(r["cut"] for r in rows) < sum(r["cut_before"] for r in rows)


def test_links_draw_neighbours_together(spark, docs):
    """Cliques of eight in a chain, between documents without links: the cut edges, counted one by one, become few."""
    rng = random.Random(5)
    edges = [(8 * c + i, 8 * c + j) for c in range(12) for i in range(8) for j in range(i)] + [(8 * c, 8 * c + 8) for c in range(11)]
    edges += [(3, 3), (2, 1), (5, 10_000), edges[0]]
    links = spark.createDataFrame(rng.sample(edges, len(edges)), "a long, b long")
    table = docs([f"t{i}" for i in range(296)])
    rows = balanced_shards(table, shards=4, turns=12, links=links).collect()
    check_shards(rows, 4)
    shard = {r["doc_id"]: r["shard"] for r in rows}
    real = {tuple(sorted(e)) for e in edges if e[0] != e[1] and max(e) < 296}
    for r in rows:
        mine = [e for e in real if r["doc_id"] in e]
        assert r["n_links"] == len(mine) and r["cut"] == sum(shard[a] != shard[b] for a, b in mine)
    before, after = (sum(r[c] for r in rows) // 2 for c in ("cut_before", "cut"))
    assert before > 200 and after < before / 4
    again = {r["doc_id"]: r["shard"] for r in balanced_shards(table, shards=4, turns=12, links=links).collect()}
    assert again == shard
    assert balanced_shards(table.limit(0), links=links).count() == 0
    assert {r["n_links"] for r in balanced_shards(table, shards=4, links=links.limit(0)).collect()} == {0}


def test_loss_mask_is_the_learnt_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<|im_end|>\\"), (1, 2, "assistant", ""), (1, 3, "assistant", "🙂é"), (2, 0, "user", None)]
    got = {r["conv_id"]: r for r in chat.format_conversations(conversations(spark, rows)).withColumn("t", chat.masked(F.col("formatted"), F.col("mask"))).collect()}
    assert got[1]["t"] == ["a<|im_end|>\\", "", "🙂é"] and got[2]["t"] == []
    for m in got[1]["mask"]:
        assert got[1]["formatted"][m["start"] + m["len"] :].startswith(chat.END)


def test_circles_of_replies(spark):
    """2 -> 3 -> 4 -> 2 with 5 below 3; 7 replies to itself, 8 to 7; 1 is a root."""
    rows = [(1, None), (2, 4), (3, 2), (4, 3), (5, 3), (7, 7), (8, 7)]
    messages = spark.createDataFrame([(n, p, "user", f"m{n}", 1.0) for n, p in rows], "node long, parent long, role string, text string, score double")
    out = chat.format_paths(messages, 5).withColumn("t", chat.read_turns(F.col("formatted"))).collect()
    assert {(r["tree"], tuple(x["text"] for x in r["t"])) for r in out} == {(1, ("m1",)), (2, ("m2", "m3", "m4")), (2, ("m2", "m3", "m5")), (7, ("m7", "m8"))}
