"""Operators 5, 6, 9 and 10 against brute force and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverdf.llm import jaccard as J
from quiverdf.llm import passages as P
from quiverdf.llm._shared import Scratch, components
from quiverdf.llm.decontamination import contamination, proximity_matches, without_contaminated
from quiverdf.llm import licences as L
from quiverdf.llm.licences import scan_licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- decontamination -----------------------------------------------------------------------------------------


def lower(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(text, items, window=10):
    w, hit, found = lower(text), set(), set()
    for i, t in items:
        q = lower(t)
        n = min(window, len(q))
        for s in range(len(q) - n + 1) if q else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == q[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination_brute_force(spark, docs):
    rng = random.Random(0)
    items = [(i, " ".join(prose(rng, rng.choice([1, 4, 9, 10, 11, 25]), 12))) for i in range(12)] + [(12, None), (13, "!!"), (14, "w1, W2.w3"), (15, "w1 w2 w3")]
    texts = []
    for _ in range(80):
        w = prose(rng, rng.randrange(0, 40), 12)
        _, t = items[rng.randrange(12)]
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + t.split()[rng.randrange(3) :] + w[at:]).upper().replace(" ", rng.choice([" ", ", ", "\n"])))
    for r in contamination(docs(texts), benchmark(spark, items)).collect():
        n, hit, found = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, found), texts[r["doc_id"]]


def test_contamination_awkward(spark, awkward):
    items = benchmark(spark, [(1, "same text here"), (1, "same text here"), (None, "你好"), (3, "word " * 30)])
    rows = contamination(awkward, items).collect()
    assert len(rows) == 11
    assert Counter(r["n_hit"] for r in rows) == {0: 5, 3: 4, 30_000: 1, 1: 1}
    out = without_contaminated(awkward, items)
    assert out.columns == awkward.columns and out.count() == 5
    assert contamination(awkward, items.limit(0)).where("n_hit > 0").count() == 0
    assert contamination(awkward.limit(0), items).count() == 0


def brute_near(texts, items, window=10, slop=2):
    """For each text: phrases with proximity matches only, the rarest term, counted over all texts, standing in place."""
    words = [lower(t) for t in texts]
    count = Counter(w for t in words for w in t)
    phrases = {tuple(q[s : s + min(window, len(q))]) for _, t in items for q in [lower(t)] if q for s in range(max(1, len(q) - window + 1))}
    out = []
    for w in words:
        n = 0
        for p in phrases:
            if not all(count[x] for x in p):
                continue
            off = min(range(len(p)), key=lambda i: (count[p[i]], i))
            starts = [at - off for at, x in enumerate(w) if x == p[off] and at - off >= -slop]
            exact = any(tuple(w[at : at + len(p)]) == p for at in starts if at >= 0)
            near = any(all(x in w[max(0, at + i - slop) : max(0, at + i + slop + 1)] for i, x in enumerate(p)) for at in starts)
            n += near and not exact
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_near_matches_brute_force(spark, docs, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.choice([1, 2, 3, 5, 12]), 9))) for i in range(8)] + [(8, None), (None, "w1 w2 w3"), (9, "w1 w2 w3")]
    texts = [" ".join(prose(rng, rng.randrange(0, 25), 9)) for _ in range(60)] + [None, ""]
    got = {r["doc_id"]: r["n_near"] for r in contamination(docs(texts), benchmark(spark, items)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts, items)


def test_proximity(spark, docs):
    table = docs(["a b c d", "a x b y c d", "a b c e", "d c b a"])
    got = {(r["__row"], r["start"]) for r in proximity_matches(table, benchmark(spark, [(1, "a b c d")]), slop=2).collect()}
    assert len({r for r, _ in got}) == 2  # in place, and within two words
    assert len({r for r, _ in {(r["__row"], r["start"]) for r in proximity_matches(table, benchmark(spark, [(1, "a b c d")]), slop=0).collect()}}) == 1


def test_proximity_at_the_head_of_a_document(spark, docs):
    table = docs(["a b d c", "d d d a", "d a b c"])  # d, the rarest term, would begin the phrase before the document
    items = benchmark(spark, [(1, "a b c d"), (2, "a b c"), (3, "a b c")])
    found = proximity_matches(docs(["a b d c", "a b c", "a b c"]), items, slop=2).where("phrase = 'a b c d'").collect()
    assert [r["start"] for r in found] == [-1]
    assert proximity_matches(table.limit(0), items).count() == 0


# --- Jaccard join --------------------------------------------------------------------------------------------


def grams(t, n=5):
    w = (t or "").lower().split()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_links(texts, threshold=0.8):
    s = [grams(t) for t in texts]
    near = lambda a, b: a == b or len(a & b) >= threshold * len(a | b) > 0
    links = [[j for j in range(len(s)) if j != i and near(s[i], s[j])] for i in range(len(s))]
    label = list(range(len(s)))
    for _ in s:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(s))]
    return links, label


@pytest.mark.parametrize("block", [3, 1_024])
def test_near_duplicates_brute_force(docs, block):
    rng = random.Random(3)
    texts = []
    for _ in range(14):
        base = prose(rng, rng.choice([3, 5, 30, 60]), 200)
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            texts.append(rng.choice([" ", "  "]).join(w))
    texts += ["", None, "  "]
    links, label = brute_links(texts)
    for r in J.near_duplicates(docs(texts), block=block).collect():
        i = r["doc_id"]
        assert (r["n_links"], r["class_id"], r["kept"]) == (len(links[i]), label[i], label[i] == i)


def test_near_duplicates_awkward(awkward):
    rows = J.near_duplicates(awkward).collect()
    assert len(rows) == 11
    classes = defaultdict(list)
    for r in rows:
        classes[r["class_id"]].append(r)
    assert {k: len(v) for k, v in classes.items()} == {0: 4, 3: 1, 4: 4, 6: 1, 7: 1}
    assert all(sum(r["kept"] for r in v) == 1 for v in classes.values())
    out = J.without_near_copies(awkward)
    assert out.count() == 5 and out.columns == awkward.columns
    assert J.near_duplicates(awkward.limit(0)).count() == 0


def test_bands_reach_the_recall():
    b, r = J.choose_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= J.MOST_HASHES
    rng = random.Random(4)
    missed = 0
    for _ in range(200):
        base = prose(rng, 120, 10**6)
        other = list(base)
        for at in (20, 60):
            other[at] = "changed"
        x, y = (J.band_codes(J.shingles(" ".join(w)), b, r) for w in (base, other))
        missed += not (x == y).any()
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    assert {r["node"]: r["label"] for r in got} == want


# --- passages ------------------------------------------------------------------------------------------------


def test_chains_against_all_subsets():
    rng = random.Random(5)
    for _ in range(60):
        parts = np.array(sorted({(rng.randrange(30), rng.randrange(30), rng.randrange(1, 6)) for _ in range(7)}))
        best = 0.0

        def score(chain, parts=parts):
            total = 0.0
            for k, i in enumerate(chain):
                x, y, n = parts[i]
                total += n
                if k:
                    px, py, pn = parts[chain[k - 1]]
                    if px + pn > x or py + pn > y:
                        return -1e9
                    total -= P.GAP * (x - px - pn + y - py - pn)
            return total

        for mask in range(1, 1 << len(parts)):
            best = max(best, score([i for i in range(len(parts)) if mask >> i & 1]))
        assert abs(score(P.chains(parts)[0]) - best) < 1e-9


def planted(rng, passage, copies, edits=0):
    out = []
    for _ in range(copies):
        p = list(passage)
        for at in rng.sample(range(len(p)), edits):
            p[at] = f"edit{rng.randrange(10**6)}"
        a, b = prose(rng, 40, 10**6), prose(rng, 40, 10**6)
        out.append(" ".join(a + p + b))
    return out


def test_planted_passages_are_found_and_clean_texts_left(docs):
    rng = random.Random(6)
    texts = planted(rng, prose(rng, 55, 10**6), 5) + planted(rng, prose(rng, 90, 10**6), 4, 4) + planted(rng, prose(rng, 30, 10**6), 3)
    texts += [" ".join(prose(rng, 100, 10**6)) for _ in range(10)]
    rows = P.repeated_passages(docs(texts)).collect()
    assert {r["doc_id"] for r in rows} | {r["other_id"] for r in rows} == set(range(9))
    for r in rows:
        a, b = texts[r["doc_id"]].split(), texts[r["other_id"]].split()
        assert r["end"] - r["start"] >= 50 and r["identity"] >= 0.8
        if r["doc_id"] < 5:
            assert (r["start"], r["end"]) == (40, 95) and a[40:95] == b[r["other_start"] : r["other_end"]]


def test_frequent_passage_and_repeats_inside(docs, monkeypatch):
    rng = random.Random(7)
    texts = planted(rng, prose(rng, 60, 10**6), 90) + ["is on " * 60 + " ".join(prose(rng, 60, 10**6)) for _ in range(3)]
    rows = P.repeated_passages(docs(texts)).collect()
    assert {r["doc_id"] for r in rows} | {r["other_id"] for r in rows} == set(range(93))
    assert len(rows) < 4 * len(texts)


def shares(a, b, n=50):
    a, b = a.split(), b.split()
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


def scattered(rng):
    """Passages whose parts stand alone before: halves, thirds, a half that repeats inside one document."""
    new = lambda n: " ".join(prose(rng, n, 10**6))
    out = []
    for n in (2, 3, 5):
        parts = [new(60 // n) for _ in range(n)]
        for _ in range(2):
            out += [f"{new(9)} {p} {new(9)}" for p in parts] + [f"{new(9)} {' '.join(parts)} {new(9)}"]
    a, b, c = new(30), new(30), new(26)
    return out + [b, f"{a} {new(9)} {a} {b}", a, b, f"{new(70)} {a} {b}"] + [c, f"{c} {a}", new(3) + " " + c, a, f"{c} {a} {new(20)}"]


@pytest.mark.parametrize("seed", range(2))
def test_scattered_passages_brute_force(docs, seed):
    rng = random.Random(seed)
    texts = scattered(rng) + ["a " * 70 + " ".join(prose(rng, 40, 10**6)), "b c " + "a " * 55 + " ".join(prose(rng, 20, 10**6))]
    blocks = [" ".join(prose(rng, 17, 10**6)) for _ in range(6)]
    texts += [" ".join(rng.choices(blocks, k=rng.randrange(1, 6))) for _ in range(60)]
    rows = P.repeated_passages(docs(texts).coalesce(1).sortWithinPartitions("doc_id")).collect()
    found = {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}
    assert found >= {i for i, t in enumerate(texts) if any(shares(t, u) for j, u in enumerate(texts) if j != i)}
    for r in rows:
        assert r["end"] - r["start"] >= 50 and r["identity"] >= 0.8
    assert len({tuple(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("changed, recall", [(0.05, 0.97), (0.1, 0.95), (0.15, 0.85), (0.18, 0.8)])
def test_changed_passages_are_found(docs, changed, recall):
    """Pairs of documents that share 60 words, a part of them changed: at an identity of 0.8 or more all are passages."""
    rng = random.Random(8)
    texts = []
    while len(texts) < 200:
        p = prose(rng, 60, 10**6)
        q = [f"z{rng.random()}" if rng.random() < changed else w for w in p]
        if sum(x == y for x, y in zip(p, q, strict=True)) >= 48:
            texts += [" ".join(prose(rng, 30, 10**6) + w + prose(rng, 30, 10**6)) for w in (p, q)]
    rows = P.repeated_passages(docs(texts).coalesce(1).sortWithinPartitions("doc_id")).collect()
    assert all(r["doc_id"] - r["other_id"] == 1 and r["doc_id"] % 2 for r in rows)
    assert len({r["doc_id"] for r in rows}) >= recall * 100


def test_passages_awkward(awkward):
    rows = P.repeated_passages(awkward).collect()
    assert rows == []
    twice = P.repeated_passages(awkward.unionByName(awkward.where("doc_id = 3"))).collect()
    assert {(r["doc_id"], r["other_id"]) for r in twice} == {(3, 3)}
    assert P.repeated_passages(awkward.limit(0)).count() == 0


def test_alignment_inside_gaps():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([1, 3, 4, 9, 5])
    steps = P.between(a, b[:4])
    assert sum(dx for dx, _, _ in steps) == 5 and sum(dy for _, dy, _ in steps) == 4
    assert P.extend(a, a) == (5, [True] * 5) and P.extend(a, a[::-1] + 9) == (0, [])


def test_words_are_coded_many_at_once(monkeypatch):
    """The codes are those of ``word_codes``, which is asked for long words only."""
    texts = ["", " ", "a", "a \ud800 b", "é漢字🎉 " * 5, "İstanbul \u3000 ǅ", "x\x00y \x1c z\x85w", *["q" * i + " ß" * (i % 3) for i in range(70)], " ".join(prose(random.Random(1), 2_000))]
    want, code, asked = [J.word_codes(t) for t in texts], P.word_codes, []
    monkeypatch.setattr(P, "word_codes", lambda text: (asked.append(len(text.encode())), code(text))[1])
    for words in (3, P.WORDS):
        monkeypatch.setattr(P, "WORDS", words)
        assert all(np.array_equal(a, b) for a, b in zip(want, P.codes_of(texts), strict=True))
    assert min(asked) > 31 and list(P.codes_of([])) == []


def test_least_cost_alignments_are_those_of_the_whole_table():
    """Equal last words, and texts without equal words, take no table, with the steps that it would give."""

    def plain(a, b):
        cost = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, u in enumerate(a, 1):
            for j, v in enumerate(b, 1):
                cost[i, j] = min(cost[i - 1, j - 1] + (u != v), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        steps, i, j = [], len(a), len(b)
        while i or j:
            if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
                steps.append((1, 1, bool(a[i - 1] == b[j - 1])))
            else:
                steps.append((1, 0, False) if i and cost[i, j] == cost[i - 1, j] + 1 else (0, 1, False))
            i, j = i - steps[-1][0], j - steps[-1][1]
        return steps[::-1]

    rng = np.random.default_rng(3)
    for words in (2, 4, 12, 2_000) * 100:
        a, b = (rng.integers(0, words, n).astype(np.uint32) for n in rng.integers(1, 14, 2))
        if len(a) != len(b):
            assert P.between(a, b) == plain(a, b)


def test_windows_of_the_second_round_travel_as_masks(spark, docs, monkeypatch):
    """A row for each document and lot of blocks, not for each block; the masks name the blocks again."""
    rng = random.Random(5)
    fill, shared = (lambda: prose(rng, 40, 10**6)), prose(rng, 60, 10**6)
    texts = [fill() + shared[:40] + fill(), fill() + shared[20:] + fill(), fill() + shared + fill()]
    keep, seen = P.Scratch.keep, []

    def held(self, df, *x, **y):
        out = keep(self, df, *x, **y)
        if df.columns[:3] == ["a", "b", "parts"]:
            seen.append(out.where("parts IS NULL").collect())
        return out

    monkeypatch.setattr(P.Scratch, "keep", held)
    P.repeated_passages(docs([" ".join(t) for t in texts])).collect()
    assert len(seen[0]) > 1 and len(seen[0]) == len({r["a"] for r in seen[0]}) <= 3
    blocks = np.array([(1, 0), (1, 62), (1, 63), (1, 200), (7, 5)])
    rows, lots, bits = P.masks(blocks)
    assert list(zip(rows, lots, strict=True)) == [(1, 0), (1, 1), (1, 3), (7, 0)]
    assert P.blocks_of(lots[:3], bits[:3]).tolist() == [0, 62, 63, 200] and P.blocks_of(lots[3:], bits[3:]).tolist() == [5]
    assert all(len(x) == 0 for x in P.masks(np.empty((0, 2), np.int64)))


# --- licences ------------------------------------------------------------------------------------------------


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").repartition(3)


def test_licences_inherit_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("r/LICENSE", mit + "\n" + "more words here " * 20), ("r/a.py", "code"), ("r/sub/COPYING", gpl), ("r/sub/b.py", "code"),
        ("r/sub/deep/er/c.py", None), ("r/sub/d.py", "print()\n# Licensed under the Apache License, Version 2.0\n" + "more code " * 9), ("q/e.py", ""),
        ("top.py", "x"), (None, mit), ("r/all.txt", "All rights reserved by nobody in particular, whatever this may say at length"),
    ]
    got = {r["path"]: (r["licence"], r["inherited_from"], r["licence_file"]) for r in scan_licences(files(spark, rows)).collect()}
    assert got == {
        "r/LICENSE": ("MIT", None, True), "r/a.py": ("MIT", "r/LICENSE", False), "r/sub/COPYING": ("GPL-3.0", None, True),
        "r/sub/b.py": ("GPL-3.0", "r/sub/COPYING", False), "r/sub/deep/er/c.py": ("GPL-3.0", "r/sub/COPYING", False),
        "r/sub/d.py": ("Apache-2.0", None, False), "q/e.py": (None, None, False), "top.py": (None, None, False),
        None: ("MIT", None, True), "r/all.txt": ("MIT", "r/LICENSE", False),
    }


def test_licences_count_the_words_of_a_text_once(spark, monkeypatch):
    """Not again for each of its units: nothing above the explosion parts a text."""
    keep, plans, counts = L.Scratch.keep, [], set()

    def seen(self, df, *a):
        out = keep(self, df, *a)
        if "n_words" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            counts.update((r["n_words"], r["unit"]) for r in out.collect())
        return out

    monkeypatch.setattr(L.Scratch, "keep", seen)
    notice = "Released under the MIT License"
    rows = [("a", f"One two.\n{notice}. Four"), ("b", notice)]
    assert {r["path"] for r in scan_licences(files(spark, rows)).collect()} == {"a", "b"}
    assert len(plans) == 1 and "split(" not in plans[0].split("Generate")[0]
    units = {f"One two.\n{notice}. Four", "One two.", "One two", f"{notice}. Four", notice, "Four"}
    assert counts == {(8, u) for u in units} | {(5, notice)}


def test_licences_awkward(spark, awkward):
    table = awkward.select(F.concat(F.lit("d/"), F.coalesce("doc_id", F.lit(99))).alias("path"), "text", *[c for c in awkward.columns if c not in ("text",)])
    assert scan_licences(table).count() == 11
    assert scan_licences(table.limit(0)).count() == 0
    long = files(spark, [("a/x", "word " * 200_000 + "\nReleased under the MIT License.")])
    assert scan_licences(long).first()["licence"] == "MIT"


def test_every_template_finds_itself(spark):
    """Alone, in a file of code behind a header, and as a sentence of a long line."""
    code = "def run ( ) : return 1 " * 40
    rows = []
    for i, (_, text) in enumerate(L.TEMPLATES):
        rows += [(f"a{i}/x", text), (f"b{i}/x", f"{text}\n\n{code}\n\n{code}")]
        if len(text) < 120:
            rows.append((f"c{i}/x", f"{code}. {text}. {code}"))
    rows += [(f"n{j}/x", code + f" word{j} other{j}") for j in range(60)]
    got = {r["path"]: (r["own_licence"], r["cosine"]) for r in scan_licences(files(spark, rows)).collect()}
    for i, (name, _) in enumerate(L.TEMPLATES):
        assert got[f"a{i}/x"][1] > 0.999 and got[f"b{i}/x"][1] > 0.999
        same = {n for n, t in L.TEMPLATES if t.lower().split()[:6] == L.TEMPLATES[i][1].lower().split()[:6]} | {name}
        assert got[f"a{i}/x"][0] in same and got.get(f"c{i}/x", (name,))[0] in same
    assert all(got[f"n{j}/x"] == (None, None) for j in range(60))


def test_equal_cosines_take_the_first_name(spark):
    templates = (("B", "alpha beta gamma"), ("A", "alpha beta gamma"))
    assert scan_licences(files(spark, [("x", "alpha beta gamma"), ("y", "delta")]), templates=templates).where("path = 'x'").first()["licence"] == "A"


def test_nested_folders_of_documents(spark, docs):
    table = docs([(0, "Released under the MIT License."), (1, "x"), (10, "Licensed under CC BY-NC 4.0."), (11, "y"), (111, "z")])
    got = {r["path"].split("/")[-1]: (r["licence"], len(r["path"].split("/"))) for r in scan_licences(L.document_files(table)).collect()}
    assert got == {"0": ("MIT", 2), "1": ("CC-BY-NC-4.0", 5), "10": ("CC-BY-NC-4.0", 4), "11": ("CC-BY-NC-4.0", 5), "111": ("MIT", 5)}


# --- row identity --------------------------------------------------------------------------------------------


@pytest.fixture
def scattered_files(spark, tmp_path):
    """Documents in 40 files, and a function that has them dealt to tasks in another way."""
    rng = random.Random(9)
    texts = [" ".join(prose(rng, 60, 10**6)) for _ in range(100)]
    rows = [(i, texts[i % 100] + (" more" if i >= 100 else ""), "en", f"s{i % 3}", 1) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(40).write.parquet(str(tmp_path / "docs"))

    def redeal(n):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.minPartitionNum", n)

    redeal(2)
    yield spark.read.parquet(str(tmp_path / "docs")), redeal
    for c in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(c)


@pytest.mark.parametrize("work", ["near", "contaminated", "mixed", "sharded", "passages"])
def test_rows_keep_their_numbers_however_files_are_dealt(spark, scattered_files, work):
    """Plans are built under one dealing and read under another."""
    from quiverdf.llm.mixing import mixed_documents
    from quiverdf.llm.sharding import sharded_documents

    docs, redeal = scattered_files
    first = docs.orderBy("doc_id").first()["text"]
    items = spark.createDataFrame([(1, " ".join(first.split()[5:20]))], "item_id long, text string")
    out = {
        "near": lambda: J.without_near_copies(docs), "contaminated": lambda: without_contaminated(docs, items),
        "mixed": lambda: mixed_documents(docs), "sharded": lambda: sharded_documents(docs, shards=4),
        "passages": lambda: P.repeated_passages(docs),
    }[work]()
    redeal(16)
    ids = [r["doc_id"] for r in out.collect()]
    want = {"near": 100, "contaminated": 158, "sharded": 160}.get(work)
    assert want is None or len(ids) == len(set(ids)) == want
    if work == "mixed":
        assert {1, 2} >= set(Counter(ids).values()) and len(ids) > 200
    if work == "passages":
        assert len(set(ids)) == 60


def test_ids_of_any_type_and_clashing_names(spark, docs):
    from quiverdf.llm.mixing import mixed_documents

    rng = random.Random(3)
    base = " ".join(prose(rng, 80, 10**6))
    table = docs([base, base, base + " end", " ".join(prose(rng, 80, 10**6))])
    named = table.select(F.concat(F.lit("doc-"), "doc_id").alias("doc_id"), "text", "source", F.lit(7).alias("__row"), F.lit(8).alias("__copies"), F.lit(9).alias("_metadata"))
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in J.near_duplicates(named).collect()} == {("doc-0", "doc-0", 2), ("doc-1", "doc-0", 2), ("doc-2", "doc-0", 2), ("doc-3", "doc-3", 0)}
    assert all(r["doc_id"].startswith("doc-") and r["other_id"].startswith("doc-") for r in P.repeated_passages(named).collect())
    for out in (J.without_near_copies(named), mixed_documents(named), without_contaminated(named, benchmark(spark, [(1, "none of these")]))):
        assert out.columns == named.columns
        assert {(r["__row"], r["__copies"], r["_metadata"]) for r in out.collect()} == {(7, 8, 9)}


def test_many_variants_of_one_text(docs):
    """Links of a large bucket, most of them settled by sizes alone, against all pairs."""
    rng = random.Random(11)
    base, texts = prose(rng, 70, 10**6), []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(20)}"
        texts.append(" ".join(w[: rng.choice([70, 70, 60])]))
    links, label = brute_links(texts)
    rows = {r["doc_id"]: r for r in J.near_duplicates(docs(texts), block=64).collect()}
    assert [rows[i]["class_id"] for i in range(400)] == label
    assert [rows[i]["n_links"] for i in range(400)] == [len(x) for x in links]


def test_bands_that_cannot_reach_the_recall():
    with pytest.raises(ValueError):
        J.choose_bands(0.02, 0.9999)
    assert J.choose_bands(1.0) == (1, 1)


def test_different_texts_that_share_passages_are_all_paired(spark):
    """Every pair of different texts for which all pairs of places show a passage has a row, and every copy."""
    import itertools

    from quiverdf.llm import passages as P

    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(1 << 40)}"
    lines = [[word() for _ in range(30)] for _ in range(3)]
    a, b, c = lines
    texts = [a, b, a + b, a, b, a + b, b + c, a + b + c, c, b + c]
    texts = [" ".join([word() for _ in range(20)] + t + [word() for _ in range(20)]) for t in texts]
    texts += [texts[2], texts[2], texts[7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["other_id"], r["doc_id"]) for r in P.repeated_passages(docs).collect()}
    with_ab, with_bc = [2, 5, 7], [6, 7, 9]
    want = {*itertools.combinations(with_ab, 2), *itertools.combinations(with_bc, 2), (2, 10), (2, 11), (7, 12)}
    assert found == want
