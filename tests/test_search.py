"""Samples, exact search and recall."""

import numpy as np
from pyspark.sql import functions as F

from quiverdf.operators import evaluation as E
from quiverdf.operators import knn as K
from quiverdf.operators import sampling as S
from quiverdf.streaming.search import search_stream


def asked(df):
    return df.withColumnRenamed("vec_id", "qid")


def test_three_fixed_vectors(vectors):
    docs = vectors([[1, 0, 1], [0, 1, 0], [-1, 0, -1]])
    got = {(r["qid"], r["vec_id"], r["dist"]) for r in K.knn(docs, asked(docs), 1).collect()}
    assert got == {(0, 0, -1.0), (1, 1, 0.0), (2, 2, -1.0)}


def test_metrics_edges_and_ties(vectors):
    x = np.array([[1.0, 0], [2, 0], [0, 3], [0, 0], [1, 0]])
    docs = vectors(x)
    for metric in ("dot", "cosine", "euclidean"):
        a, b = (f(docs, asked(docs), 9, metric).orderBy("qid", "rank").select("qid", "rank", "vec_id").collect() for f in (K.knn, K.knn_expr))
        assert a == b
    first = [r["vec_id"] for r in K.knn(docs, asked(docs).where("qid = 4"), 2, "euclidean").orderBy("rank").collect()]
    assert first == [0, 4]  # equal distances: the smaller id
    assert K.knn(docs, asked(docs), 9, "cosine").where("vec_id = 3 OR qid = 3").count() == 0


def test_empty_sides(spark, vectors):
    docs = vectors(np.eye(3))
    assert K.knn(docs, asked(docs).limit(0), 2).count() == 0
    assert K.knn(docs.limit(0), asked(docs), 2).count() == 0


def test_blocks_of_queries(vectors, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_NUMBERS", 6)
    x = np.random.default_rng(0).random((20, 3))
    docs = vectors(x)
    got = K.knn(docs, asked(docs), 3, "euclidean", exclude_self=True).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for q, g in got.groupby("qid"):
        assert g.sort_values("rank").vec_id.tolist() == np.argsort(d[q], kind="stable")[:3].tolist()


def test_graph_is_symmetric_and_unique(vectors):
    g = K.knn_graph(vectors(np.random.default_rng(1).random((40, 4))), 3).toPandas()
    pairs = set(zip(g.src, g.dst, strict=True))
    assert len(pairs) == len(g) and {(b, a) for a, b in pairs} == pairs and all(a != b for a, b in pairs)


def _all_pairs(x, k):
    """(id, id) of the k nearest others of each row by sums in order, ties to the smaller id."""
    d = np.add.accumulate((x[:, None] - x[None]) ** 2, axis=2)[:, :, -1]
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}


def test_all_rows_ask_in_bounded_tiles(vectors, monkeypatch):
    """No distances of a whole block by a whole batch, equal vectors equally far, whatever the blocks."""
    x = np.repeat(np.random.default_rng(5).normal(size=(60, 7)), 5, axis=0)
    docs = vectors(x).repartition(3)
    near = lambda: {(r["qid"], r["vec_id"]) for r in K.knn_all(docs, 7, "euclidean").collect()}
    assert near() == _all_pairs(x, 7)
    monkeypatch.setattr(K, "ROW_NUMBERS", 140)
    monkeypatch.setattr(K, "HELD_BLOCKS", 4)
    assert near() == _all_pairs(x, 7)
    seen = []
    whole = K.Nearest._tile
    monkeypatch.setattr(K.Nearest, "_tile", lambda self, b, ids, *a: (seen.append((b.stop - b.start) * len(ids)), whole(self, b, ids, *a)))
    monkeypatch.setattr(K, "TILE", 100)
    best = K.Nearest(np.arange(300), x, 7, "euclidean", True)
    for i in range(0, 300, 90):
        best.meet(np.arange(i, min(i + 90, 300)), x[i : i + 90])
    assert max(seen) <= 100 and set(zip(best.table().qid, best.table().vec_id, strict=True)) == _all_pairs(x, 7)


def test_blocks_that_meet_are_not_paired_in_rows(vectors, monkeypatch):
    """F5 order_cost: a block goes once to a task that needs it, and no row holds two; nor must a group have rows."""
    cut, seen = K.cut_lineage, []
    monkeypatch.setattr(K, "cut_lineage", lambda df, rows=None: (seen.append(df), cut(df, rows))[1])
    monkeypatch.setattr(K, "ROW_NUMBERS", 14)
    for n in (1, 2, 3, 5, 90):
        x = np.random.default_rng(n).normal(size=(n, 7))
        near = K.knn_all(vectors(x).repartition(3), 4, "euclidean").collect()
        assert {(r["qid"], r["vec_id"]) for r in near} == {(i, j) for i, j in _all_pairs(x, 4) if i != j}
        assert "CartesianProduct" not in seen[-1]._jdf.queryExecution().executedPlan().toString()


def test_graph_joins_ties_by_id(vectors):
    x = np.repeat(np.random.default_rng(6).normal(size=(12, 33)), 9, axis=0)
    g = K.knn_graph(vectors(x), 4).toPandas()
    one = _all_pairs(x, 4)
    assert set(zip(g.src, g.dst, strict=True)) == one | {(b, a) for a, b in one} and (g.dist == 0).all()


def test_recall_golden(spark):
    exact = spark.createDataFrame([(0, i) for i in (0, 1, 2, 5, 4, 3, 6, 9, 8, 7)], "qid long, vec_id long")
    approx = spark.createDataFrame([(0, i) for i in (1, 0, 2, 4, 6, 7, 17, 11, 14, 8)], "qid long, vec_id long")
    assert E.recall(exact, approx).first()["recall"] == 0.7
    one = spark.range(1).select(E.recall_of(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (2, 3)))))
    assert one.first()[0] == 0.5


def test_samples(spark, vectors):
    df = vectors(np.zeros((1000, 1)))
    assert S.bernoulli(df, 1).count() == 1000 and S.bernoulli(df, 0).count() == 0
    assert 200 < S.bernoulli(df, 0.3).count() < 400
    assert S.reservoir(df, 50).count() == 50 and S.reservoir(df, 5000).count() == 1000
    assert S.reservoir(df, 50).collect() == S.reservoir(df.repartition(7), 50).collect()
    per = S.stratified(df.withColumn("g", F.col("vec_id") % 3), 5, "g").groupBy("g").count().collect()
    assert [r["count"] for r in per] == [5, 5, 5]
    q, rest = S.split_queries(df, 10)
    assert q.count() == 10 and rest.count() == 990 and rest.join(q, "vec_id").count() == 0
    parts = S.random_partitions(df, 4).groupBy("part").count().collect()
    assert sorted(r["part"] for r in parts) == [1, 2, 3, 4] and min(r["count"] for r in parts) > 150


def test_clusters_without_points_count(spark):
    sizes = E.cluster_sizes(spark.createDataFrame([(0,), (0,), (2,)], "cluster int"), 4)
    assert sorted(map(tuple, sizes.collect())) == [(0, 2), (1, 0), (2, 1), (3, 0)]
    m = E.size_moments(sizes).first()
    assert m["mean"] == 0.75 and m["effective_k"] == 2


def test_stream_equals_batch(spark, vectors, tmp_path):
    docs = vectors(np.random.default_rng(2).random((30, 4)))
    asked(docs).limit(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, embedding array<double>").parquet(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))
    search_stream(stream, docs, 3, sink, str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "rank", "vec_id").orderBy("qid", "rank").collect()
    assert got == K.knn(docs, asked(docs).limit(5), 3).select("qid", "rank", "vec_id").orderBy("qid", "rank").collect()


def test_searches_without_sql_ask_throughout(spark, tmp_path):
    """Queries are all ids divisible by 100, wherever the ids begin."""
    from quiverdf.plans.catalog import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    docs.withColumn("vec_id", F.col("vec_id") + 1_000).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["qid"] for r in QUERIES["pq_anisotropic"](spark, str(tmp_path)).collect()} == set(range(1_000, 1_500, 100))


def test_no_queries_find_nothing(spark, vectors):
    from quiverdf.operators import ivf, pq

    rng = np.random.default_rng(3)
    docs = vectors(rng.normal(size=(80, 8)))
    none = docs.limit(0).withColumnRenamed("vec_id", "qid")
    c, lists = ivf.build_ivf(docs, 4)
    assert [x.count() for x in ivf.search(lists, none, c, 5, 2)] == [0, 0]
    assert ivf.search_quantised(ivf.quantise_lists(lists, c, 4), docs, none, c, 5, 2, 4).count() == 0
    model = pq.supplied_model(docs, "dot", np.zeros((1, 8)), 2, 4)
    assert pq.search(pq.encode_docs(docs, model), none, model, 5).count() == 0


def test_quantised_search_takes_every_block_of_queries(spark, vectors, monkeypatch):
    """Three queries a block give what one block of all gives."""
    from quiverdf.operators import ivf, knn

    docs = vectors(np.random.default_rng(4).normal(size=(90, 8)))
    queries = docs.where("vec_id < 10").withColumnRenamed("vec_id", "qid")
    c, lists = ivf.build_ivf(docs, 4)
    coded = ivf.quantise_lists(lists, c, 4)
    found = lambda: sorted(tuple(r) for r in ivf.search_quantised(coded, docs, queries, c, 5, 3, 4).collect())
    whole = found()
    blocks = knn.blocks_of
    monkeypatch.setattr(ivf, "blocks_of", lambda q, limit=0: blocks(q, 24))
    assert len({r[0] for r in whole}) == 10 and found() == whole
