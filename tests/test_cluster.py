"""k-means, inverted files, order and merge policies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverdf.operators import balanced as A
from quiverdf.operators import evaluation as E
from quiverdf.operators import ivf as I
from quiverdf.operators import kmeans as M
from quiverdf.operators import knn as K
from quiverdf.operators import merge_policy as G
from quiverdf.operators import ordering as R


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(20 * i, 1, (30, 6)) for i in range(8)])


def test_plus_plus_reaches_every_cluster(blobs):
    c, chosen = M.plus_plus(blobs, 8, np.random.default_rng(1))
    assert np.allclose(c, blobs[chosen[:, 0]])
    assert len({round(v / 20) for v in c[:, 0]}) == 8
    same, _ = M.plus_plus(np.ones((5, 2)), 3, np.random.default_rng(2))
    assert (same == 1).all()


def test_starts_respect_subspaces():
    x = np.random.default_rng(3).random((200, 6)) + 5 * np.arange(6)
    for c in (M.forgy(x, 4, np.random.default_rng(4), 3), M.plus_plus(x, 4, np.random.default_rng(4), 3)[0]):
        assert c.shape == (4, 6) and (np.floor(c / 5) == np.arange(6)).all()


def test_steps_lower_the_cost(vectors, blobs):
    df, c, last = vectors(blobs), blobs[::30] + 3.0, math.inf
    for _ in range(3):
        c, cost = M.lloyd_step(df, c)
        assert cost <= last
        last = cost
    assigned = M.assign(df, c).toPandas()
    assert (assigned.cluster.to_numpy()[np.argsort(assigned.vec_id)] == M.squared_distances(blobs, c).argmin(1)).all()


def test_empty_clusters_keep_their_centre(vectors):
    c = np.array([[0.0, 0], [100, 100]])
    new, _ = M.lloyd_step(vectors([[1.0, 1], [3, 3]]), c)
    assert new.tolist() == [[2, 2], [100, 100]]


def test_hamerly_equals_lloyd(blobs):
    c = blobs[:8]
    assert np.allclose(M.hamerly(blobs, c, 20)[0], M.local_lloyd(blobs, c, 20, tolerance=-1.0)[0])


def test_one_cluster_is_the_mean(vectors, blobs):
    assert np.allclose(M.kmeans(vectors(blobs), blobs[:1])[0], blobs.mean(0))


def test_coarse_count(vectors, blobs):
    assert len(M.coarse_clusters(vectors(blobs), 24)) == 10
    assert len(M.coarse_clusters(vectors(blobs), 10_000)) == 1


def test_hierarchical_sizes(vectors):
    x = np.random.default_rng(5).random((600, 4))
    c, assigned = M.hierarchical(vectors(x), 50, 4)
    sizes = assigned.groupBy("cluster").count().toPandas()
    assert sizes["count"].max() <= 1.34 * 50 and sizes["count"].sum() == 600
    assert sorted(sizes.cluster) == list(range(len(c)))
    one, all_ = M.hierarchical(vectors(x[:20]), 50)
    assert len(one) == 1 and all_.count() == 20
    same, _ = M.hierarchical(vectors(np.ones((200, 2))), 20)
    assert len(same) == 1


def test_spills_differ_from_the_primary(vectors, blobs):
    df = vectors(blobs)
    c = blobs[::30]
    s = M.spill(M.assign(df, c), c).toPandas()
    assert (s.spilled != s.cluster).all() and (s.spilled >= 0).all()
    e = M.spill_expr(df, c).toPandas().sort_values("vec_id")
    assert e.spilled.tolist() == s.sort_values("vec_id").spilled.tolist()
    alone = M.spill(M.assign(df, c[:1]), c[:1]).toPandas()
    assert (alone.spilled == -1).all()


def test_local_passes(vectors, blobs):
    c, assigned = M.kmeans_local(vectors(blobs), blobs[::30] + 1.0, 3)
    got = assigned.toPandas()
    assert (got.spilled != got.cluster).all() and np.allclose(c, blobs.reshape(8, 30, 6).mean(1), atol=0.5)


def test_split_largest(vectors, blobs):
    c, at = M.split_largest(vectors(blobs), 8)
    assert len(c) == 8 == len(np.unique(at))


def test_balanced_sizes():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(3, 1, (60, 4))])
    start = M.plus_plus(x, 6, rng)[0]
    c, at = A.balanced_clusters(x, start, 6)
    plain = M.local_lloyd(x, start, 10)[1]
    assert np.bincount(at, minlength=6).std() < np.bincount(plain, minlength=6).std()
    small, _ = A.balanced_clusters(x, start, 6, dims=2, epochs=1, polish=10)
    assert small.shape == c.shape


def test_sinkhorn_evens_columns(spark):
    rows = [(i, c, float(cost)) for i in range(40) for c, cost in ((0, 0.0), (1, 1.0))]
    costs = spark.createDataFrame(rows, "vec_id long, cluster int, cost double")
    share = lambda n: {r["cluster"]: r["s"] for r in A.sinkhorn_rounds(costs, 1.0, n, 40, 2).groupBy("cluster").agg(F.sum("share").alias("s")).collect()}
    assert abs(share(20)[0] - 20) < 0.5 < abs(share(0)[0] - 20)


def test_all_probes_give_exact_results_and_spills_help(vectors):
    x = np.random.default_rng(7).standard_normal((400, 8))
    docs = vectors(x)
    q = vectors(x[:12]).withColumnRenamed("vec_id", "qid")
    exact = K.knn(docs, q, 10)
    c, lists = I.build_ivf(docs, 12)
    plain = I.postings(M.assign(docs, c))
    mean = lambda found: E.recall_summary(E.recall(exact, found)).first()["mean"]
    assert mean(I.search(lists, q, c, 10, 99)[0]) == 1.0
    few, more = (mean(I.search(plain, q, c, 10, n)[0]) for n in (2, 6))
    assert few <= more
    assert mean(I.search(lists, q, c, 10, 2)[0]) >= few
    compared = I.search(lists, q, c, 10, 99)[1].toPandas().n_compared
    assert (compared == lists.count()).all()  # twice-listed points are compared twice
    pd_a = I.search_expr(lists, q, c, 10, 3).orderBy("qid", "rank").select("qid", "vec_id").collect()
    assert pd_a == I.search(lists, q, c, 10, 3)[0].orderBy("qid", "rank").select("qid", "vec_id").collect()


def test_probes_prune_written_postings(spark, vectors, tmp_path):
    x = np.random.default_rng(8).standard_normal((100, 4))
    docs = vectors(x)
    c = x[:5]
    I.write_postings(I.postings(M.assign(docs, c)), str(tmp_path / "p"))
    lists = spark.read.parquet(str(tmp_path / "p"))
    q = docs.limit(3).withColumnRenamed("vec_id", "qid")
    assert I.search(lists, q, c, 5, 5)[0].count() == 15


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_quantised_ivf(vectors, metric):
    x = np.random.default_rng(9).standard_normal((300, 16))
    docs = vectors(x)
    turned, _, c, lists = I.build_quantised_ivf(docs, 4, 60, metric, 8)
    q = turned.where("vec_id < 8").select(F.col("vec_id").alias("qid"), "embedding")
    found = I.search_quantised(lists, turned, q, c, 5, 99, 4, 4, metric)
    exact = K.knn(docs, docs.where("vec_id < 8").withColumnRenamed("vec_id", "qid"), 5, metric)
    assert E.recall_summary(E.recall(exact, found)).first()["mean"] > 0.9


@pytest.mark.parametrize(("dims", "order"), [(2, 3), (2, 5), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(dims, order):
    side = 1 << order
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in R.hilbert_cells(cells, order)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(keys, kind="stable")]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_orders_lower_the_cost(vectors):
    x = np.random.default_rng(10).random((60, 2))
    points = vectors(x)
    g = R.edge_weights(K.knn_graph(points, 4))
    cost = lambda ids: R.order_cost(g, points.sparkSession.createDataFrame([(int(v), i) for i, v in enumerate(ids)], "vec_id long, pos long")).first()["cost"]
    hilbert = [r["vec_id"] for r in R.hilbert_order(points).collect()]
    ids, found = R.annealed_order(points, 4, 6)
    assert sorted(ids) == list(range(60))
    assert abs(found - cost(ids)) < 1e-9 and found < cost(range(60)) and cost(hilbert) < cost(range(60))


def test_merge_cost_and_policies(spark):
    one = spark.createDataFrame([(1, 0, 100), (1, 1, 10), (1, 2, 5)], "merge_id int, seq int, n int")
    want = 57.5 + 10 * math.log(100) + 5 * math.log(110)
    assert abs(G.merge_costs(one).first()["cost"] - want) < 1e-9 and abs(G.merge_cost([100, 10, 5]) - want) < 1e-9
    given = [(100, 0.0)] * 1_000
    log = G.run_policy("log_doc", given, most_deleted=0.0)
    assert log.merges == 111 and log.segments() == [] or sum(log.segments()) == 100_000
    for name in G.POLICIES:
        p = G.run_policy(name, given, most_deleted=0.0)
        assert sum(p.segments()) == 100_000 == p.docs
    tiered = G.run_policy("tiered", given, most_deleted=0.0)
    assert len(tiered.segments()) <= tiered.allowed()
    assert {r["policy"] for r in G.trials(spark, 2, (50, 100)).collect()} == {"log_doc", "tiered", "largest"}


def test_samples_are_cut_throughout():
    """Training sees all of a cluster's sample, not only its lowest ids."""
    import pandas as pd

    g = pd.DataFrame({"vec_id": range(1_000), "embedding": [np.array([10.0 * (i >= 500), i / 1_000]) for i in range(1_000)]})
    centres = M._splitter({0: 2}, 10, 6, 0)((0,), g)["centre"]
    assert sorted(round(c[0]) for c in centres) == [0, 10]
    x = np.arange(50)
    assert (M.some_of(x, 50, 0) == x).all() and (np.diff(M.some_of(x, 20, 0)) > 0).all() and M.some_of(x, 20, 0).max() > 30


def test_coarse_clusters_leave_the_sample_distributed(vectors, monkeypatch):
    """No points on the driver but the starts, distances in bounded tiles; what Lloyd's steps over all points give."""
    x = np.random.default_rng(12).normal(size=(400, 6))
    docs = vectors(x).repartition(3)
    rng = np.random.default_rng(0)
    tries = [M.local_lloyd(x, M.forgy(x, 20, rng), 10) for _ in range(5)]
    want = M.lloyd_step(docs, min(tries, key=lambda t: t[2])[0])[0]
    monkeypatch.setattr(M, "matrix", lambda points: pytest.fail("points on the driver"))
    got = M.coarse_clusters(docs, 20)
    assert np.allclose(got, want) and (got == M.coarse_clusters(docs, 20)).all()
    assert np.allclose(M.coarse_clusters(docs, 1_000), x.mean(0))
    seen, whole = [], M.squared_distances
    monkeypatch.setattr(M, "squared_distances", lambda a, c: (seen.append(len(a) * len(c)), whole(a, c))[1])
    monkeypatch.setattr(M, "TILE", 100)
    at, low = M.nearest_centres(x, got)
    assert max(seen) <= 100 and (at == whole(x, got).argmin(1)).all() and np.allclose(low, whole(x, got).min(1))


@pytest.mark.parametrize("name", ["edge_weights", "order_cost", "growth_of_distance"])
def test_graphs_take_no_rows_to_the_driver(spark, monkeypatch, name):
    from quiverdf.plans.catalog import QUERIES

    monkeypatch.setattr(K, "blocks_of", lambda *a: pytest.fail("points on the driver"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_batches_of_a_cut_are_bounded(spark):
    import pandas as pd

    from quiverdf.operators.lineage import BATCH, cut_lineage

    before = spark.conf.get(BATCH)
    sizes = spark.range(0, 40, 1, 2).mapInPandas(lambda it: (pd.DataFrame({"n": [len(b)]}) for b in it), "n int")
    assert max(r["n"] for r in cut_lineage(sizes, 3).collect()) == 3 and spark.conf.get(BATCH) == before


@pytest.mark.parametrize("name", ["edge_weights", "order_cost"])
def test_graphs_send_few_pairs_of_blocks_at_once(spark, monkeypatch, name):
    from quiverdf.plans.catalog import QUERIES

    cut, seen = K.cut_lineage, []
    monkeypatch.setattr(K, "cut_lineage", lambda df, rows=None: (seen.append(rows), cut(df, rows))[1])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert seen[-1] and seen[-1] * 2 * K.ROW_NUMBERS * 8 <= 8 << 20
