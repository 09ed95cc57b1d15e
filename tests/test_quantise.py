"""Scalar, optimised, one-bit and product quantisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverdf.operators import evaluation as E
from quiverdf.operators import kmeans as M
from quiverdf.operators import one_bit as B
from quiverdf.operators import osq as O
from quiverdf.operators import pq as P
from quiverdf.operators import scalar_quant as Q


def column(df, c):
    return np.array([r[0] for r in df.orderBy("vec_id").select(c).collect()])


def test_quantiles_of_a_uniform(vectors):
    df = vectors(np.random.default_rng(0).uniform(0, 10, (300, 100)))
    for ci, want in ((0.5, (2.5, 7.5)), (0.9, (0.5, 9.5))):
        assert np.allclose(Q.central_interval(df, ci), want, atol=0.1)
    low, high = Q.central_interval(df, 1.0)
    assert low >= 0 and high <= 10


def test_one_bit_is_a_threshold(vectors):
    x = np.random.default_rng(1).uniform(0, 10, (3, 100))
    assert (column(vectors(x), Q.quantise("embedding", 2.5, 7.5, 1.0)) == (x >= 5)).all()


def test_codes_and_correction_estimate_products(vectors):
    x = np.clip(np.random.default_rng(2).normal(0, 0.1, (40, 64)), -0.3, 0.3)
    df = Q.quantised(vectors(x), -0.3, 0.3, 8)
    codes, p = column(df, "codes").astype(float), column(df, "p")
    estimate = p[:, None] + p[None] + (0.6 / 255) ** 2 * codes @ codes.T
    assert np.abs(estimate - x @ x.T).max() < 0.01
    back = column(df, Q.dequantise("codes", -0.3, 0.3, 255.0))
    assert np.abs(back - np.clip(x, -0.3, 0.3)).max() <= 0.3 / 255 + 1e-9


def test_no_width_gives_zero_codes(vectors):
    df = Q.quantised(vectors([[1.0, 1.0]]), 1.0, 1.0, 4)
    assert df.first()["codes"] == [0, 0]


def test_search_matches_expression(vectors):
    x = np.random.default_rng(3).normal(0, 0.1, (50, 16))
    docs = Q.quantised(vectors(x), -0.3, 0.3, 4)
    got = Q.search(docs, vectors(x[:4]).withColumnRenamed("vec_id", "qid"), 5, -0.3, 0.3, 4).toPandas()
    codes, p = column(docs, "codes").astype(float), column(docs, "p")
    for q, g in got.groupby("qid"):
        d = 1 - (p + p[q] + (0.6 / 15) ** 2 * codes @ codes[q])
        assert np.allclose(g.sort_values("rank").dist, np.sort(d)[:5])


def test_maximiser_finds_the_peak():
    f = lambda x, y: (2 + np.cos(x - 1) + np.cos(y - 1)) / (1 + abs(x - 1) + abs(y - 1))
    x, y, value = Q.maximise(f, 24, (-3, 5), (-3, 5), np.random.default_rng(0))
    assert value >= 0.97 * f(1, 1)


def test_calibrated_interval_is_in_its_box(vectors):
    df = vectors(np.random.default_rng(4).normal(0, 0.1, (120, 32)))
    low, high, score = Q.calibrated_interval(df, 4, 100, 5, 16, 8)
    (a, b), (c, d) = Q.candidate_box(df, 4)
    assert a - (b - a) / 12 <= low <= b + (b - a) / 12 and c - (d - c) / 12 <= high <= d + (d - c) / 12
    assert low < 0 < high and score <= 1


def test_segments(spark, vectors):
    g = spark.createDataFrame([(0, 100, 0.0, 1.0), (1, 300, 0.0, 1.0)], "seg_id long, n long, lo double, hi double")
    assert tuple(Q.merged_interval(g).first()) == (0, 1)
    assert not Q.must_recompute(g, 0, 1) and Q.to_requantise(g, 0, 1).count() == 0
    far = spark.createDataFrame([(0, 100, 0.0, 1.0), (1, 300, 2.0, 3.0)], g.schema)
    assert Q.must_recompute(far, 1.5, 2.5) and Q.to_requantise(far, 1.5, 2.5).count() == 2
    x = np.random.default_rng(5).random((40, 8))
    codes = vectors(x).withColumn("seg_id", F.col("vec_id") % 2).select("seg_id", "vec_id", Q.quantise("embedding", 0.0, 1.0, 256.0).alias("codes"))
    merged, span, share = Q.merge_segments(codes, g)
    assert share == 0 and span == (0, 1)
    assert merged.orderBy("vec_id").select("codes").collect() == codes.orderBy("vec_id").select("codes").collect()


def test_channels_round_trip(vectors):
    x = np.random.default_rng(6).random((60, 9)) * 0.1 + np.repeat([0, 5, 9], 3)
    df = vectors(x)
    ch = Q.channels(x.mean(0).tolist())
    assert len(set(ch[:3])) == 1 and len(set(ch)) == 3
    coded, spans = Q.channel_quantised(df, ch, 0.999)
    back = column(Q.channel_dequantised(coded, ch, spans), "embedding")
    assert np.abs(back - x).max() < 0.02


def test_optimised_intervals_do_not_raise_the_loss():
    x = np.random.default_rng(7).standard_normal((50, 32))
    for bits in (1, 2, 4):
        lo, hi = O.starts(x, bits)
        a, b = O.optimised(x, bits)
        assert (O.loss(x, a, b, bits) <= O.loss(x, lo, hi, bits) + 1e-12).all()
        c, d, q = O.optimised_with_codes(x, bits)
        e = x - O.decoded(q, c, d, bits)
        joint = 0.9 * (x * e).sum(1) ** 2 / (x * x).sum(1) + 0.1 * (e * e).sum(1)
        assert (joint <= O.loss(x, a, b, bits) + 1e-9).all() and q.min() >= 0 and q.max() < 2**bits


def test_constant_vectors_quantise(vectors):
    q = O.quantise_docs(vectors(np.ones((2, 4))), 4).collect()
    assert all(r["codes"] == [0] * 4 and r["lo"] == 1 for r in q)


def test_preconditioner_keeps_products_and_balances():
    rng = np.random.default_rng(8)
    var = rng.random(64) ** 3
    order = O.balancing_permutation(var, 16)
    assert sorted(order.tolist()) == list(range(64))
    sums = var[order].reshape(4, 16).sum(1)
    assert np.ptp(sums) < 0.5 * np.ptp(np.sort(var).reshape(4, 16).sum(1))
    for m in O.random_orthogonal(70, 32):
        assert np.allclose(m @ m.T, np.eye(len(m)))


def test_one_bit_bounds_cover(vectors):
    x = np.random.default_rng(9).standard_normal((200, 64))
    docs = vectors(x)
    t = B.estimates(docs, vectors(x[:5]).withColumnRenamed("vec_id", "qid"), B.centre_of(docs))
    r = E.coverage(t, 5, 40).first()
    assert r["covered"] > 0.85 and r["recall"] > 0.8
    assert E.coverage(B.pruned(t, 5), 5, 5).first()["recall"] > 0


def test_pca_and_balanced_subspaces():
    x = np.random.default_rng(10).random((1000, 24)) * 0.1 * (np.arange(24) + 1)
    v, lam = P.pca(x)
    assert np.allclose(v @ v.T, np.eye(24)) and (np.diff(lam) <= 1e-12).all()
    assert np.allclose(np.cov(x.T, bias=True) @ v[0], lam[0] * v[0])
    turn = P.balanced_subspaces(v, lam, 6)
    assert np.allclose(turn @ turn.T, np.eye(24))
    spread = lambda t: np.ptp((x @ t.T).var(0).reshape(6, 4).sum(1))
    assert spread(turn) < 0.5 * spread(np.eye(24))
    with pytest.raises(ValueError):
        P.balanced_subspaces(v, lam, 7)
    with pytest.raises(ValueError):
        P.balanced_subspaces(v, lam[::-1], 6)


def test_encode_recovers_centres_and_anisotropic_error():
    rng = np.random.default_rng(11)
    books = rng.random((8, 16, 3))
    codes = rng.integers(0, 16, (100, 8))
    assert (P.encode(P.decode(codes, books), books) == codes).all()
    x = rng.random((500, 24))
    parallel = lambda t: np.mean(((x * (x - P.decode(P.encode(x, books, t), books))).sum(1)) ** 2 / (x * x).sum(1))
    assert parallel(0.6) < 0.75 * parallel(0.0)


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclidean"])
def test_table_distance_is_distance_to_decoded(vectors, metric):
    rng = np.random.default_rng(12)
    docs = P.prepared(vectors(rng.random((300, 22))), metric, 8)
    model = P.fit_pq(docs, metric, 8, 16, 150)
    assert model.centres.shape == (2, 24)
    coded = P.encode_docs(docs, model)
    c, k = column(coded, "codes"), column(coded, "cluster")
    y = model.decode(c, k)
    q = np.append(rng.random(22), [0, 0])
    if metric == "cosine":
        q /= np.linalg.norm(q)
    # The base of a euclidean similarity is 1, so its table distance is the squared distance itself.
    want = ((q - y) ** 2).sum(1) if metric == "euclidean" else 1 - y @ q
    assert np.allclose(model.distances(q, c, k), want, atol=1e-6)
    exact = column(docs, "embedding")
    assert ((exact - y) ** 2).mean() < 0.25 * exact.var()
    with pytest.raises(IndexError):
        model.decode(c[:1], np.array([9]))


def test_merged_models(vectors):
    docs = P.prepared(vectors(np.random.default_rng(13).random((200, 16))), "dot", 4)
    a, b = (P.fit_pq(docs.where(F.col("vec_id") % 2 == i), "dot", 4, 8, 60, seed=i) for i in (0, 1))
    m = P.merge_models(docs, a, b, 70)
    assert m.centres.shape == (3, 16)
    assert P.encode_docs(docs, m).count() == 200
    with pytest.raises(ValueError):
        P.merge_models(docs, a, P.PqModel("cosine", b.centres, b.rotations, b.books), 70)
    tables = P.model_tables(docs.sparkSession, m)
    assert tables["codebooks"].count() == 3 * 4 * 8 == tables["norms"].count()


def test_codebooks_beat_random():
    x = np.random.default_rng(14).random((1000, 12))
    book = P.fit_codebooks(x, 12, 64)
    error = ((x - P.decode(P.encode(x, book), book)) ** 2).mean()
    chance = ((x - np.random.default_rng(15).random((1000, 12))) ** 2).mean()
    assert error < chance / 40
    assert M.squared_distances(x[:1], x[:1])[0, 0] < 1e-9
