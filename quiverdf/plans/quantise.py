"""Queries over scalar, optimised, one-bit and product quantisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quiverdf.functions import vectors as V
from quiverdf.operators import evaluation as E
from quiverdf.operators import knn as K
from quiverdf.operators import kmeans as M
from quiverdf.operators import one_bit as B
from quiverdf.operators import osq as O
from quiverdf.operators import pq as P
from quiverdf.operators import scalar_quant as Q
from quiverdf.plans.registry import asked, query, r6, scaled, unit

LOW, HIGH = -0.3, 0.3


def _codes(bits: int, levels: int | None = None) -> str:
    s = levels or 2**bits - 1
    q = f"round({float(s)} / 0.6 * (least(greatest(x, -0.3), 0.3) - (-0.3)))"
    d = f"({q} / ({float(s)} / 0.6))"
    return (
        f", k AS (SELECT vec_id, list_transform(v, lambda x: {q}::BIGINT) AS c, "
        f"list_sum(list_transform(v, lambda x: -0.3 * (x + 0.15) + ((x + 0.3) - {d}) * {d})) AS p, v FROM e) "
    )


def _quantised(bits: int, levels: int | None = None):
    def run(spark, folder):
        q = Q.quantised(unit(spark, folder), LOW, HIGH, bits, levels)
        d = Q.dequantise("codes", LOW, HIGH, Q.steps_of(bits, levels))
        return q.select("vec_id", V.l1_norm("codes").alias("l1"), r6("p").alias("p"), F.round(E.quantisation_rmse("embedding", d), 6).alias("rmse"))

    return run


for _bits, _levels in ((1, None), (4, None), (8, None), (8, 256)):
    _s = float(_levels or 2**_bits - 1)
    _f = _quantised(_bits, _levels)
    _f.__name__ = f"scalar_quantise_{_bits}" + ("_levels256" if _levels else "")
    query(_codes(_bits, _levels) + f"""SELECT vec_id, list_sum(c)::BIGINT AS l1, round(p, 6) + 0.0 AS p,
    round(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - (-0.3 + z[2] * 0.6 / {_s})) * (z[1] - (-0.3 + z[2] * 0.6 / {_s}))))), 6) AS rmse FROM k""")(_f)

SQ = _codes(4) + """, d AS (SELECT b.vec_id AS qid, a.vec_id, 1 - (a.p + b.p + (0.6 / 15) * (0.6 / 15) * list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))) AS dist
FROM k a, k b WHERE b.vec_id % 100 = 0) """


@query(SQ + "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 6) + 0.0 AS dist FROM d QUALIFY rank <= 10")
def scalar_search_4(spark, folder):
    docs = unit(spark, folder)
    return Q.search(Q.quantised(docs, LOW, HIGH, 4), asked(docs), 10, LOW, HIGH, 4).withColumn("dist", r6("dist"))


EXACT = ", x AS (SELECT b.vec_id AS qid, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY 1 - list_inner_product(a.v, b.v), a.vec_id) AS r FROM e a, e b WHERE b.vec_id % 100 = 0)"


@query(SQ.rstrip() + EXACT + """, g AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM d)
SELECT m.a, round(avg(CASE WHEN g.r <= 10 + m.a THEN 1.0 ELSE 0.0 END), 6) AS recall FROM x JOIN g USING (qid, vec_id), (VALUES (0), (10), (20), (30), (40), (90)) m(a) WHERE x.r <= 10 GROUP BY m.a""")
def scalar_expansion_recall(spark, folder):
    docs = unit(spark, folder)
    ranked = Q.search(Q.quantised(docs, LOW, HIGH, 4), asked(docs), 100, LOW, HIGH, 4)
    return Q.expansion_recall(ranked, K.knn(docs, asked(docs), 10), 10).withColumn("recall", F.round("recall", 6))


@query(SQ.rstrip() + EXACT + """, g AS (SELECT qid, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 10)
SELECT x.qid, count(g.vec_id) / count(*) AS recall FROM x LEFT JOIN g USING (qid, vec_id) WHERE x.r <= 10 GROUP BY x.qid""")
def recall_by_query(spark, folder):
    docs = unit(spark, folder)
    return E.recall(K.knn(docs, asked(docs), 10), Q.search(Q.quantised(docs, LOW, HIGH, 4), asked(docs), 10, LOW, HIGH, 4))


@query(SQ.rstrip() + EXACT + """, g AS (SELECT qid, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 10),
r AS (SELECT x.qid, count(g.vec_id) / count(*) AS recall FROM x LEFT JOIN g USING (qid, vec_id) WHERE x.r <= 10 GROUP BY x.qid)
SELECT min(recall) AS low, max(recall) AS high, round(avg(recall), 6) AS mean FROM r""")
def recall_summary(spark, folder):
    return E.recall_summary(recall_by_query(spark, folder)).withColumn("mean", F.round("mean", 6))


@query(", u AS (SELECT unnest(v) AS x FROM s) SELECT round(quantile_cont(x, 0.05), 6) AS lo, round(quantile_cont(x, 0.95), 6) AS hi FROM u")
def interval_interpolated(spark, folder):
    q = Q.interpolated_interval(scaled(spark, folder), 0.9)
    return q.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(", u AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM (SELECT unnest(v) AS x FROM s)) SELECT round(max(CASE WHEN r = floor(n * 0.05 + 0.5) THEN x END), 6) AS lo, round(max(CASE WHEN r = floor(n * 0.95 + 0.5) THEN x END), 6) AS hi FROM u")
def interval_order_statistic(spark, folder):
    lo, hi = Q.central_interval(scaled(spark, folder), 0.9, None)
    return spark.createDataFrame([(round(lo, 6), round(hi, 6))], "lo double, hi double")


@query()
def interval_candidates(spark, folder):
    (a, b), (c, d) = Q.candidate_box(scaled(spark, folder), 4)
    return spark.createDataFrame([(a, b, c, d)], "low_from double, low_to double, high_from double, high_to double")


@query()
def interval_calibrated(spark, folder):
    return spark.createDataFrame([Q.calibrated_interval(unit(spark, folder), 4)], "lo double, hi double, score double")


SEGMENTS = ", g AS (SELECT vec_id % 5 AS seg_id, count(*) AS n, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM (SELECT vec_id, unnest(v) AS x FROM e) GROUP BY ALL), m AS (SELECT sum(n::DOUBLE * lo) / sum(n::DOUBLE) AS lo, sum(n::DOUBLE * hi) / sum(n::DOUBLE) AS hi FROM g) "


def _segments(spark, folder):
    long = unit(spark, folder).select((F.col("vec_id") % 5).alias("seg_id"), F.explode(V.doubles("embedding")).alias("x"))
    q = F.percentile("x", F.array(F.lit(0.01), F.lit(0.99))).alias("q")
    return long.groupBy("seg_id").agg(F.count("x").alias("n"), q).select("seg_id", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


@query(SEGMENTS + "SELECT round(m.lo, 6) AS lo, round(m.hi, 6) AS hi, (SELECT bool_or(greatest(abs(m.lo - g.lo), abs(m.hi - g.hi)) > (m.hi - m.lo) / 32) FROM g, m) AS again FROM m")
def segments_merged_interval(spark, folder):
    g = _segments(spark, folder)
    lo, hi = Q.merged_interval(g).first()
    return spark.createDataFrame([(round(lo, 6), round(hi, 6), Q.must_recompute(g, lo, hi))], "lo double, hi double, again boolean")


@query(SEGMENTS + "SELECT seg_id, g.n FROM g, m WHERE greatest(abs(m.lo - g.lo), abs(m.hi - g.hi)) > 0.2 * (g.hi - g.lo) / 256")
def segments_to_requantise(spark, folder):
    g = _segments(spark, folder)
    lo, hi = Q.merged_interval(g).first()
    return Q.to_requantise(g, lo, hi).select("seg_id", "n")


@query()
def segments_merged(spark, folder):
    g = _segments(spark, folder)
    docs = unit(spark, folder).withColumn("seg_id", F.col("vec_id") % 5).join(F.broadcast(g), "seg_id")  # five rows
    codes = docs.select("seg_id", "vec_id", Q.quantise("embedding", F.col("lo"), F.col("hi"), 256.0).alias("codes"))
    merged, _, share = Q.merge_segments(codes, g, 0.98)
    return merged.select("seg_id", "vec_id", V.l1_norm("codes").alias("l1"), F.lit(share).alias("share"))


@query()
def channel_quantised(spark, folder):
    docs = scaled(spark, folder)
    ch = Q.channels(V.mean_vector(docs))
    coded, spans = Q.channel_quantised(docs, ch, 0.99)
    back = Q.channel_dequantised(coded.withColumn("exact", F.col("embedding")), ch, spans)
    return back.select("vec_id", E.quantisation_rmse("exact", "embedding").alias("rmse"))


@query(f"SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS rmse, round(acos(least(greatest(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), -1.0), 1.0)), 5) AS angle FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def quantisation_error(spark, folder):
    docs = scaled(spark, folder)
    o = docs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return docs.join(o, "vec_id").select("vec_id", F.round(E.quantisation_rmse("embedding", "b"), 6).alias("rmse"), F.round(E.quantisation_angle("embedding", "b"), 5).alias("angle"))


# --- optimised scalar quantisation ---------------------------------------------------------------------------

OWN = """, g AS (SELECT min(list_min(v)) AS a, max(list_max(v)) AS b FROM e),
i AS (SELECT vec_id, v, least(greatest(list_avg(v) - 2.514 * sqrt(list_var_pop(v)), a), b) AS lo, least(greatest(list_avg(v) + 2.514 * sqrt(list_var_pop(v)), a), b) AS hi FROM e, g),
k AS (SELECT vec_id, v, lo, hi, list_transform(v, lambda x: round(15.0 / (hi - lo) * (least(greatest(x, lo), hi) - lo))::BIGINT) AS c FROM i) """


def _own(spark, folder):
    docs = unit(spark, folder)
    a, b = docs.agg(F.min(F.array_min(V.doubles("embedding"))), F.max(F.array_max(V.doubles("embedding")))).first()
    i = docs.withColumn("i", O.initial_interval("embedding", 4, a, b)).select("vec_id", "embedding", "i.lo", "i.hi")
    k = i.withColumn("codes", O.quantise("embedding", F.col("lo"), F.col("hi"), 4))
    return k.withColumn("l1", V.l1_norm("codes"))


@query(OWN + "SELECT vec_id, round(lo, 6) AS lo, round(hi, 6) AS hi, list_sum(c)::BIGINT AS l1, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - (lo + (hi - lo) * z[2] / 15.0)) * (z[1] - (lo + (hi - lo) * z[2] / 15.0)))), 6) AS error FROM k")
def osq_initial(spark, folder):
    k = _own(spark, folder).withColumn("error", O.squared_error("embedding", F.col("codes"), F.col("lo"), F.col("hi"), 4))
    return k.select("vec_id", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "error")], "l1")


@query(OWN + """SELECT a.vec_id, round(len(a.v) * a.lo * b.lo + b.lo * ((a.hi - a.lo) / 15.0) * list_sum(a.c) + a.lo * ((b.hi - b.lo) / 15.0) * list_sum(b.c)
+ ((a.hi - a.lo) / 15.0) * ((b.hi - b.lo) / 15.0) * list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])), 6) + 0.0 AS dot FROM k a JOIN k b ON b.vec_id = a.vec_id + 1""")
def osq_estimated_dot(spark, folder):
    k = _own(spark, folder)
    o = k.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"{c}2") for c in ("lo", "hi", "codes", "l1")])
    x, y = ({c: F.col(f"{c}{n}") for c in ("lo", "hi", "codes", "l1")} for n in ("", "2"))
    return k.join(o, "vec_id").select("vec_id", r6(O.estimated_dot(64, x, y, 4, 4)).alias("dot"))


@query()
def osq_optimised(spark, folder):
    q = O.quantise_docs(unit(spark, folder), 4)
    return q.select("vec_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "l1")


@query(f"SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) + 0.0 AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def osq_preconditioned_products(spark, folder):
    """Products of vectors after permutation and rotation: what they were before."""
    docs = unit(spark, folder).select("vec_id", "embedding")
    var = [r["var_pop"] for r in sorted(V.component_stats(docs).collect(), key=lambda r: r["pos"])]
    turned = O.precondition(docs, O.balancing_permutation(np.array(var)), O.random_orthogonal(len(var)))
    o = turned.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return turned.join(o, "vec_id").select("vec_id", r6(V.dot("embedding", "b")).alias("dot"))


# --- one bit -------------------------------------------------------------------------------------------------

BITS = """, u AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s) GROUP BY pos), c AS (SELECT list(m ORDER BY pos) AS c FROM u),
o AS (SELECT vec_id, v, c, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM s, c),
n AS (SELECT vec_id, v, c, sqrt(list_inner_product(r, r)) AS len, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS u FROM o),
d AS (SELECT vec_id, v, c, len, list_transform(u, lambda x: (x > 0)::INT::DOUBLE) AS b, list_sum(list_transform(u, lambda x: abs(x))) / sqrt(64.0) AS fit FROM n),
q AS (SELECT vec_id AS qid, v AS qv, len AS qn, list_min(u) AS lo, (list_max(u) - list_min(u)) / 15 AS delta,
list_transform(u, lambda x: floor(15.0 / (list_max(u) - list_min(u)) * (x - list_min(u)) + 0.5)) AS qc FROM n WHERE vec_id % 100 = 0),
t AS (SELECT qid, vec_id, list_inner_product(v, qv) AS exact, qn * len * ((2 * delta / 8 * list_inner_product(qc, b) + 2 * lo / 8 * list_sum(b) - delta / 8 * list_sum(qc) - 8 * lo) / fit)
+ list_inner_product(v, c) + list_inner_product(qv, c) - list_inner_product(c, c) AS estimate, len * qn * 1.9 / sqrt(63.0) * sqrt((1 - fit * fit) / (fit * fit)) AS error FROM d, q) """


@query(BITS + "SELECT qid, vec_id, round(exact, 5) + 0.0 AS exact, round(estimate, 5) + 0.0 AS estimate, round(estimate - error, 5) + 0.0 AS low, round(estimate + error, 5) + 0.0 AS high FROM t")
def one_bit_estimates(spark, folder):
    docs = scaled(spark, folder)
    t = B.estimates(docs, asked(docs), B.centre_of(docs))
    return t.select("qid", "vec_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("exact", "estimate", "low", "high")])


@query()
def one_bit_pruned_recall(spark, folder):
    docs = scaled(spark, folder)
    t = B.estimates(docs, asked(docs), B.centre_of(docs))
    return E.coverage(B.pruned(t, 10), 10, 40)


# --- product quantisation ------------------------------------------------------------------------------------


def _supplied(spark, folder, metric="dot"):
    docs = unit(spark, folder)
    return docs, P.supplied_model(docs, metric, np.zeros((1, 64)), 8, 16)


@query(""", w AS (SELECT vec_id, b, v[b * 8 + 1 : b * 8 + 8] AS x FROM e, range(8) t(b)),
k AS (SELECT w.vec_id, w.b, o.vec_id AS code, list_sum(list_transform(list_zip(w.x, o.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM w JOIN w o ON o.b = w.b AND o.vec_id < 16)
SELECT vec_id, b AS book, code FROM k QUALIFY row_number() OVER (PARTITION BY vec_id, b ORDER BY d, code) = 1""")
def pq_encode(spark, folder):
    docs, model = _supplied(spark, folder)
    codes = docs.select("vec_id", F.posexplode(P.encode_expr(V.doubles("embedding"), model.books[0])).alias("book", "code"))
    return codes.select("vec_id", F.col("book").cast("long").alias("book"), F.col("code").cast("long").alias("code"))


@query(""", w AS (SELECT vec_id, b, v[b * 8 + 1 : b * 8 + 8] AS x FROM e, range(8) t(b)),
k AS (SELECT w.vec_id, w.b, o.x AS y, row_number() OVER (PARTITION BY w.vec_id, w.b ORDER BY list_sum(list_transform(list_zip(w.x, o.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), o.vec_id) AS r FROM w JOIN w o ON o.b = w.b AND o.vec_id < 16),
d AS (SELECT k.vec_id, q.vec_id AS qid, 1 - sum(list_inner_product(q.x, k.y)) AS dist FROM k JOIN w q ON q.b = k.b AND q.vec_id % 100 = 0 WHERE k.r = 1 GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), vec_id) AS rank, vec_id, round(dist, 6) + 0.0 AS dist FROM d QUALIFY rank <= 10""")
def pq_search(spark, folder):
    docs, model = _supplied(spark, folder)
    found = P.search(P.encode_docs(docs, model), asked(docs), model, 40)
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.round("dist", 9), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return top.select("qid", "rank", "vec_id", r6("dist").alias("dist"))


@query()
def pq_trained_error(spark, folder):
    docs = P.prepared(scaled(spark, folder), "euclidean", 8)
    model = P.fit_pq(docs, "euclidean", 8, 32, 400)
    back = P.decode_docs(P.encode_docs(docs, model), model).withColumnRenamed("embedding", "b")
    return docs.join(back, "vec_id").select("vec_id", E.quantisation_rmse("embedding", "b").alias("rmse"))


@query()
def pq_anisotropic(spark, folder):
    docs = P.prepared(unit(spark, folder), "cosine", 8)
    model = P.fit_pq(docs, "cosine", 8, 32, 10**6, threshold=0.6)
    return P.search(P.encode_docs(docs, model), asked(unit(spark, folder)), model, 10)


@query()
def pq_merged(spark, folder):
    docs = P.prepared(unit(spark, folder), "cosine", 8)
    a, b = (P.fit_pq(docs.where(F.col("vec_id") % 2 == i), "cosine", 8, 16, 200, seed=i) for i in (0, 1))
    model = P.merge_models(docs, a, b, 200)
    return E.recall_summary(E.recall(K.knn(docs, asked(docs), 10), P.search(P.encode_docs(docs, model), asked(docs), model, 40)))


@query()
def pq_norms(spark, folder):
    docs = P.prepared(unit(spark, folder), "cosine", 8)
    c = M.centre_table(spark, np.stack([np.ones(64) / 8]))
    model = P.supplied_model(docs, "cosine", M.collect_centres(c)[1], 8, 16)
    return P.model_tables(spark, model)["norms"]


@query()
def compression_ratios(spark, folder):
    r = E.compression_ratio(64, 8, unit(spark, folder).count(), 4, 16)
    return spark.createDataFrame([(r["vector"], r["index"], math.log2(r["vector"]))], "vector double, index double, bits_saved double")
