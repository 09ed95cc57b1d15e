"""Vector and code functions against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverdf.functions import codes as C
from quiverdf.functions import vectors as V


def column(df, c):
    return [r[0] for r in df.orderBy("vec_id").select(c).collect()]


def test_normalise_has_length_one_and_null_for_zero(vectors):
    x = np.vstack([np.random.default_rng(0).random((20, 10)), np.zeros(10)])
    out = column(vectors(x), V.normalise("embedding"))
    assert out[-1] is None
    assert np.allclose(np.linalg.norm(np.array(out[:-1]), axis=1), 1)


def test_products_and_distances(vectors):
    x = np.random.default_rng(1).standard_normal((30, 7))
    df = vectors(x)
    q = V.literal(x[0])
    assert np.allclose(column(df, V.dot("embedding", q)), x @ x[0])
    assert np.allclose(column(df, V.distance("euclidean", "embedding", q)), ((x - x[0]) ** 2).sum(1))
    cos = x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    assert np.allclose(column(df, V.distance("cosine", "embedding", q)), 1 - cos)
    with pytest.raises(ValueError):
        V.distance("manhattan", "embedding", q)


def test_soar_distance_prefers_right_angles(vectors):
    df = vectors([[0.0, 0.0]])
    along = V.soar_distance("embedding", V.literal([1, 0]), V.literal([1, 0]))
    across = V.soar_distance("embedding", V.literal([0, 1]), V.literal([1, 0]))
    nowhere = V.soar_distance("embedding", V.literal([0, 1]), V.literal([0, 0]))
    assert [column(df, c)[0] for c in (along, across, nowhere)] == [2, 1, 1]


@pytest.mark.parametrize(("dim", "want"), [(23, 24), (24, 24), (1, 24)])
def test_zero_pad_clears_every_row(vectors, dim, want):
    rows = column(vectors(np.ones((3, dim))), V.zero_pad("embedding", 24))
    assert all(len(r) == want and sum(r) == dim for r in rows)


def test_matrix_vector_identity_double_and_reversal(vectors):
    x = np.random.default_rng(2).random((4, 5))
    for m in (np.eye(5), 2 * np.eye(5), np.eye(5)[::-1]):
        got = column(vectors(x), V.matrix_vector(F.array(*[V.literal(r) for r in m]), "embedding"))
        assert np.allclose(got, x @ m.T)


def test_covariance_and_means(vectors):
    x = np.random.default_rng(3).standard_normal((200, 6)) * np.arange(1, 7)
    mean, c = V.covariance(vectors(x))
    assert np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x.T, bias=True))
    assert np.allclose(V.mean_vector(vectors(x)), x.mean(0))


@pytest.mark.parametrize("dim", [1, 32, 33, 64, 77, 79, 100])
def test_code_products(vectors, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(0, 16, (2, dim))
    df = vectors([a]).select(F.lit(0).alias("vec_id"), F.col("embedding").cast("array<int>").alias("a")).withColumn("b", F.array(*[F.lit(int(v)) for v in b]))
    packed = C.packed_dot(C.pack_nibbles("a"), C.pack_nibbles("b"))
    one = lambda c: F.transform(c, lambda v: (v > 7).cast("int"))
    bits = C.bits_dot(C.pack_bits(one("a")), C.pack_bits(one("b")))
    row = df.select(C.int_dot("a", "b"), packed, bits, C.unpack_nibbles(C.pack_nibbles("a"), dim)).first()
    assert row[0] == row[1] == int(a @ b)
    assert row[2] == int(((a > 7) & (b > 7)).sum())
    assert row[3] == a.tolist()


def test_full_byte_range(vectors):
    a = np.arange(256)
    df = vectors([a]).select(C.int_dot("embedding", "embedding"))
    assert df.first()[0] == int((a * a).sum())


def test_linear_exp_and_log_meet_at_powers(spark):
    row = spark.range(1).select(V.approx_exp2(F.lit(3.0)), V.approx_exp2(F.lit(-2.0)), V.approx_log2(F.lit(8.0)), V.approx_log2(F.lit(12.0))).first()
    assert list(row) == [8, 0.25, 3, 3.5]
