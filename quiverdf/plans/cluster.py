"""Queries over clustering, inverted files, ordering, merge policies, evaluation and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quiverdf.functions import vectors as V
from quiverdf.operators import balanced as A
from quiverdf.operators import evaluation as E
from quiverdf.operators import ivf as I
from quiverdf.operators import kmeans as M
from quiverdf.operators import knn as K
from quiverdf.operators import merge_policy as G
from quiverdf.operators import ordering as R
from quiverdf.operators import pq as P
from quiverdf.operators.lineage import shared_dir
from quiverdf.plans.registry import asked, query, r6, scaled, unit
from quiverdf.plans.vectors import D2, GRAPH, MEANS, label_centres

D = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
STEP = f""", c0 AS (SELECT vec_id AS cluster, v FROM s WHERE vec_id < 16),
a0 AS (SELECT a.vec_id, a.v, b.cluster, {D} AS d2 FROM s a, c0 b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY d2, b.cluster) = 1),
m0 AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM a0) GROUP BY ALL) """


def _first(docs, k=16):
    return M.initial_centres(docs, k, "first")


def _positions(spark, c):
    return M.centre_table(spark, c).select("cluster", F.posexplode("centre").alias("pos", "x")).select(F.col("cluster").cast("long").alias("cluster"), F.col("pos").cast("long").alias("pos"), r6("x").alias("m"))


@query(STEP + "SELECT vec_id, cluster, round(d2, 6) AS d2 FROM a0")
def kmeans_assign(spark, folder):
    docs = scaled(spark, folder)
    a = M.assign(docs, _first(docs))
    return a.select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("d2", 6).alias("d2"))


@query(STEP + "SELECT vec_id, cluster, round(d2, 6) AS d2 FROM a0")
def kmeans_assign_expr(spark, folder):
    docs = scaled(spark, folder)
    return M.assign_expr(docs, _first(docs)).select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("d2", 6).alias("d2"))


@query(STEP + "SELECT cluster, pos, round(m, 6) + 0.0 AS m FROM m0")
def kmeans_lloyd_step(spark, folder):
    docs = scaled(spark, folder)
    return _positions(spark, M.lloyd_step(docs, _first(docs))[0])


@query(STEP + f""", c1 AS (SELECT cluster, list(m ORDER BY pos) AS v FROM m0 GROUP BY cluster),
a1 AS (SELECT a.vec_id, a.v, b.cluster FROM s a, c1 b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.cluster) = 1)
SELECT cluster, pos, round(avg(x), 6) + 0.0 AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM a1) GROUP BY ALL""")
def kmeans_two_steps(spark, folder):
    docs = scaled(spark, folder)
    return _positions(spark, M.kmeans_full(docs, _first(docs), 2))


SOAR = STEP + f""", r0 AS (SELECT a.vec_id, a.cluster, a.v, list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2]) AS r FROM a0 a JOIN c0 b USING (cluster)),
z0 AS (SELECT r0.vec_id, r0.cluster, r0.r, b.cluster AS other, list_transform(list_zip(r0.v, b.v), lambda z: z[1] - z[2]) AS n FROM r0 JOIN c0 b ON b.cluster <> r0.cluster),
sp AS (SELECT vec_id, cluster, other AS spilled FROM z0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(n, n)
+ CASE WHEN list_inner_product(r, r) > 0 THEN pow(list_inner_product(r, n), 2) / list_inner_product(r, r) ELSE 0 END, other) = 1) """


@query(SOAR + "SELECT vec_id, cluster, spilled FROM sp")
def soar_spill(spark, folder):
    docs = scaled(spark, folder)
    c = _first(docs)
    return M.spill(M.assign(docs, c), c).select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.col("spilled").cast("long").alias("spilled"))


@query(SOAR.rstrip() + f""", l AS (SELECT cluster, vec_id, v FROM a0 UNION ALL SELECT sp.spilled, vec_id, v FROM sp JOIN a0 USING (vec_id)),
p AS (SELECT a.vec_id AS qid, b.cluster FROM s a, c0 b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.cluster) <= 3),
h AS (SELECT p.qid, l.vec_id, {D.replace("a.v", "l.v").replace("b.v", "q.v")} AS d FROM l JOIN p USING (cluster) JOIN s q ON q.vec_id = p.qid),
u AS (SELECT qid, vec_id, min(d) AS d FROM h GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) + 0.0 AS dist FROM u QUALIFY rank <= 10""")
def ivf_search(spark, folder):
    docs = scaled(spark, folder)
    c = _first(docs)
    lists = I.postings(M.spill(M.assign(docs, c), c))
    return I.search(lists, asked(docs), c, 10, 3, "euclidean")[0].withColumn("dist", r6("dist"))


@query(SOAR.rstrip() + f""", l AS (SELECT cluster, vec_id FROM a0 UNION ALL SELECT spilled, vec_id FROM sp),
p AS (SELECT a.vec_id AS qid, b.cluster FROM s a, c0 b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {D}, b.cluster) <= 3)
SELECT qid, count(*) AS n_compared FROM l JOIN p USING (cluster) GROUP BY qid""")
def ivf_comparisons(spark, folder):
    docs = scaled(spark, folder)
    c = _first(docs)
    return I.search(I.postings(M.spill(M.assign(docs, c), c)), asked(docs), c, 10, 3, "euclidean")[1]


@query(f""", x AS (SELECT b.vec_id AS qid, a.vec_id, {D} AS d FROM s a, s b WHERE b.vec_id % 100 = 0)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) + 0.0 AS dist FROM x QUALIFY rank <= 10""")
def ivf_all_probes_join(spark, folder):
    """Probing every cluster gives the exact neighbours."""
    docs = scaled(spark, folder)
    c = _first(docs)
    return I.search_expr(I.postings(M.assign(docs, c)), asked(docs), c, 10, 99, "euclidean").withColumn("dist", r6("dist"))


@query()
def ivf_soar_recall(spark, folder):
    docs = unit(spark, folder)
    c, lists = I.build_ivf(docs, 16)
    found, compared = I.search(lists, asked(docs), c, 10, 4)
    return E.compared(E.recall(K.knn(docs, asked(docs), 10), found), compared, docs.count())


@query()
def ivf_quantised_recall(spark, folder):
    docs = unit(spark, folder)
    turned, _, c, lists = I.build_quantised_ivf(docs, 2, 64)
    found = I.search_quantised(lists, turned, asked(turned), c, 10, 6, 2)
    return E.recall(K.knn(docs, asked(docs), 10), found)


@query()
def kmeans_hierarchical_sizes(spark, folder):
    c, assigned = M.hierarchical(unit(spark, folder), 64, 8)
    return E.size_moments(E.cluster_sizes(assigned, len(c)))


@query()
def kmeans_local_spills(spark, folder):
    docs = unit(spark, folder)
    _, assigned = M.kmeans_local(docs, M.initial_centres(docs, 16), 4)
    return assigned.select("vec_id", "cluster", "spilled")


@query()
def kmeans_coarse(spark, folder):
    docs = unit(spark, folder)
    return M.centre_table(spark, M.coarse_clusters(docs, 100))


@query()
def kmeans_plus_plus_inertia(spark, folder):
    docs = unit(spark, folder)
    c = M.kmeans(docs, M.initial_centres(docs, 16), 6)
    return E.inertia(M.assign(docs, c).drop("d2"), M.centre_table(spark, c))


@query()
def kmeans_sampled_starts(spark, folder):
    docs = unit(spark, folder)
    rows = [(how, i) for how in ("forgy", "distinct") for i in range(len(M.initial_centres(docs, 16, how)))]
    return spark.createDataFrame(rows, "how string, i int")


@query()
def kmeans_hamerly(spark, folder):
    """Bounds change the work, not the result: distances between both methods' centres."""
    _, x = M.matrix(scaled(spark, folder))
    c = x[:16]
    a, b = M.hamerly(x, c, 10)[0], M.local_lloyd(x, c, 10, tolerance=-1.0)[0]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.abs(a - b).max(1))], "cluster int, apart double")


@query()
def kmeans_split_largest(spark, folder):
    c, at = M.split_largest(unit(spark, folder), 20)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.bincount(at, minlength=len(c)))], "cluster int, n long")


@query(", p AS (SELECT label AS parent, vec_id % 3 AS child FROM e) SELECT parent, child, dense_rank() OVER (ORDER BY parent, child) - 1 AS cluster, count(*) AS n FROM p GROUP BY parent, child")
def kmeans_rekeyed_splits(spark, folder):
    p = unit(spark, folder).select(F.col("label").alias("parent"), (F.col("vec_id") % 3).alias("child"))
    return M.rekey_splits(p).groupBy("parent", "child", F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def balanced_sizes(spark, folder):
    _, x = M.matrix(unit(spark, folder))
    c, at = A.balanced_clusters(x, M.plus_plus(x, 16, np.random.default_rng(0))[0], 8)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.bincount(at, minlength=len(c)))], "cluster int, n long")


@query(MEANS + f", p AS (SELECT a.vec_id, b.cluster, {D2} AS d FROM s a, c b), m AS (SELECT vec_id, cluster, d FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) <= 3), "
       "w AS (SELECT vec_id, cluster, exp((0 - d) / 5.0 - max((0 - d) / 5.0) OVER (PARTITION BY vec_id)) AS e, d FROM m), t AS (SELECT vec_id, cluster, d, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM w), "
       "v AS (SELECT cluster, 5.0 * ln(((SELECT count(*) FROM s) / 10.0) / sum(share)) AS v FROM t GROUP BY cluster), "
       "w2 AS (SELECT vec_id, cluster, exp((v - d) / 5.0 - max((v - d) / 5.0) OVER (PARTITION BY vec_id)) AS e FROM t JOIN v USING (cluster)) "
       "SELECT vec_id, cluster, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS share FROM w2")
def sinkhorn_round(spark, folder):
    docs = scaled(spark, folder)
    costs = K.support_sets(docs, label_centres(docs), 3).select("vec_id", "cluster", F.col("dist").alias("cost"))
    return A.sinkhorn_rounds(costs, 5.0, 1, docs.count(), 10).withColumn("share", F.round("share", 5))


# --- evaluation ----------------------------------------------------------------------------------------------


@query("SELECT label AS cluster, count(*) AS n FROM e GROUP BY label")
def cluster_sizes(spark, folder):
    return E.cluster_sizes(unit(spark, folder).withColumnRenamed("label", "cluster"))


@query(", n AS (SELECT count(*) AS n FROM e GROUP BY label) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, count(*) AS effective_k FROM n")
def cluster_size_moments(spark, folder):
    m = E.size_moments(E.cluster_sizes(unit(spark, folder).withColumnRenamed("label", "cluster")))
    return m.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "effective_k")


@query(MEANS + f"SELECT round(avg({D2}), 6) AS inertia FROM s a JOIN c b ON b.cluster = a.label")
def inertia(spark, folder):
    docs = scaled(spark, folder)
    return E.inertia(docs.withColumnRenamed("label", "cluster"), label_centres(docs)).withColumn("inertia", F.round("inertia", 6))


@query(MEANS + "SELECT b.cluster, round(avg(pow(list_inner_product(b.v, list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2])), 2) / list_inner_product(b.v, b.v)), 6) AS error FROM s a JOIN c b ON b.cluster = a.label GROUP BY b.cluster")
def parallel_error(spark, folder):
    docs = scaled(spark, folder)
    return E.parallel_error(docs.withColumnRenamed("label", "cluster"), label_centres(docs)).withColumn("error", F.round("error", 6))


RESULTS = """, t AS (SELECT label AS idx, CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 1000 END AS sample_size, vec_id % 3 AS m, vec_id % 5 AS ef, abs(v[1]) AS average_recall,
CASE WHEN vec_id % 4 = 0 THEN 'hnsw' WHEN vec_id % 4 = 1 THEN 'int8_hnsw' WHEN vec_id % 4 = 2 THEN 'flat' ELSE 'bbq_disk' END AS index_type, 'set' || (vec_id % 2) AS source FROM e) """


def _results(spark, folder):
    i = F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("hnsw", "int8_hnsw", "flat", "bbq_disk"))), (i % 4 + 1).cast("int"))
    return unit(spark, folder).select(
        F.col("label").alias("idx"), F.when(i % 2 == 0, 100).otherwise(1000).alias("sample_size"), (i % 3).alias("m"), (i % 5).alias("ef"),
        F.abs(V.doubles("embedding")[0]).alias("average_recall"), kind.alias("index_type"), F.concat(F.lit("set"), i % 2).alias("source"),
    )


@query(RESULTS + "SELECT sample_size, m, round(avg(average_recall), 6) AS mean, round(stddev_pop(average_recall), 6) AS sd FROM t GROUP BY ALL")
def recall_by_parameters(spark, folder):
    r = E.recall_by(_results(spark, folder), ["sample_size", "m"])
    return r.select("sample_size", "m", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(RESULTS + ", f AS (SELECT idx, avg(average_recall) AS a FROM t WHERE sample_size = 1000 GROUP BY idx), p AS (SELECT idx, sample_size, avg(average_recall) AS b FROM t WHERE sample_size <> 1000 GROUP BY ALL) SELECT sample_size, round(pow(corr(b, a), 2), 6) AS r2 FROM p JOIN f USING (idx) GROUP BY sample_size")
def recall_estimate_r2(spark, folder):
    return E.estimate_r2(_results(spark, folder), "idx", 1000).withColumn("r2", F.round("r2", 6))


@query(RESULTS + "SELECT sample_size, 'm' AS parameter, m::VARCHAR AS value, round(avg(average_recall), 6) AS recall FROM t GROUP BY ALL UNION ALL SELECT sample_size, 'ef', ef::VARCHAR, round(avg(average_recall), 6) FROM t GROUP BY ALL")
def recall_sensitivity(spark, folder):
    return E.sensitivity(_results(spark, folder), ["m", "ef"]).withColumn("recall", F.round("recall", 6))


@query(RESULTS + "SELECT index_type, source, count(*) AS n FROM t WHERE index_type IN ('hnsw', 'int8_hnsw', 'int4_hnsw', 'bbq_hnsw') AND source = 'set0' GROUP BY ALL")
def results_of_family(spark, folder):
    return E.of_family(_results(spark, folder), "hnsw", "set0").groupBy("index_type", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT m, ef, k FROM (VALUES (8), (16), (32)) a(m), (VALUES (50), (100)) b(ef), (VALUES (10), (20)) c(k)")
def parameter_grid(spark, folder):
    grid = E.parameter_grid(spark, m=[8, 16, 32], ef=[50, 100], k=[10, 20])
    return grid.select(*[F.col(c).cast("int").alias(c) for c in grid.columns])


@query(", h AS (SELECT CASE WHEN v[1] < -0.5 THEN 0 WHEN v[1] >= 0.5 THEN 21 ELSE floor((v[1] + 0.5) / 1.0 * 20) + 1 END AS bin FROM e) SELECT bin::BIGINT AS bin, count(*) AS n FROM h GROUP BY bin")
def histogram(spark, folder):
    return E.histogram(unit(spark, folder).select(V.doubles("embedding")[0].alias("x")), "x", -0.5, 0.5, 20)


@query()
def parameter_search(spark, folder):
    docs = unit(spark, folder)
    rows = []
    for target in (32, 64):
        record: dict = {}
        with E.timed(record, "s"):
            c, assigned = M.hierarchical(docs, target, 8)
            cost = E.inertia(assigned.drop("d2"), M.centre_table(spark, c)).first()[0]
        rows.append((target, float(cost), record["s"]))
    return E.best_parameters(spark.createDataFrame(rows, "target int, inertia double, seconds double")).select("target", "inertia")


# --- order, merges, streams ----------------------------------------------------------------------------------

WEIGHTS = GRAPH.rstrip() + """, am AS (SELECT src, avg(dist) AS m FROM g GROUP BY src),
gw AS (SELECT g.src, g.dst, CASE WHEN x.m + y.m > 0 THEN 5 * ((x.m + y.m) / 2) / ((x.m + y.m) / 2 + 4 * g.dist) ELSE 5.0 END AS w FROM g JOIN am x ON x.src = g.src JOIN am y ON y.src = g.dst) """


@query(WEIGHTS + "SELECT src, dst, round(w, 6) AS weight FROM gw")
def edge_weights(spark, folder):
    return R.edge_weights(K.knn_graph(unit(spark, folder), 8)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(WEIGHTS + "SELECT round(avg(w * abs(src - dst)), 5) AS cost FROM gw")
def order_cost(spark, folder):
    docs = unit(spark, folder)
    edges = R.edge_weights(K.knn_graph(docs, 8))
    return R.order_cost(edges, docs.select("vec_id", F.col("vec_id").alias("pos"))).withColumn("cost", F.round("cost", 5))


@query()
def hilbert_keys(spark, folder):
    return R.with_hilbert_key(unit(spark, folder)).select("vec_id", F.hex("hilbert").alias("hilbert"))


@query()
def annealed_order(spark, folder):
    docs = unit(spark, folder)
    c = M.kmeans(docs, M.initial_centres(docs, 48), 4)
    points = M.centre_table(spark, c).select(F.col("cluster").cast("long").alias("vec_id"), F.col("centre").alias("embedding"))
    ids, cost = R.annealed_order(points, 8, 8, "hilbert")
    return spark.createDataFrame([(p, int(v), float(cost)) for p, v in enumerate(ids)], "pos int, cluster int, cost double")


@query(", t AS (SELECT label AS merge_id, vec_id AS seq, (vec_id % 50 + 1) AS n FROM e), r AS (SELECT merge_id, n, sum(n) OVER (PARTITION BY merge_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS size FROM t) SELECT merge_id, round(0.5 * sum(n) + sum(CASE WHEN size IS NOT NULL THEN n * ln(size) ELSE 0 END), 6) AS cost FROM r GROUP BY merge_id")
def merge_costs(spark, folder):
    t = unit(spark, folder).select(F.col("label").alias("merge_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 50 + 1).alias("n"))
    return G.merge_costs(t).withColumn("cost", F.round("cost", 6))


@query()
def merge_policy_trials(spark, folder):
    return G.trials(spark, 8, (500, 2_000))


@query()
def pq_index_recall(spark, folder):
    docs = P.prepared(unit(spark, folder), "cosine", 8)
    model = P.fit_pq(docs, "cosine", 8, 32, 300)
    return E.recall_summary(E.recall(K.knn(docs, asked(docs), 10), P.search(P.encode_docs(docs, model), asked(docs), model, 50)))


@query(", p AS (SELECT q.vec_id AS qid, a.vec_id, 1 - list_inner_product(a.v, q.v) AS d FROM e a, e q WHERE q.vec_id % 100 = 0) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) + 0.0 AS dist FROM p QUALIFY rank <= 10")
def streamed_search(spark, folder):
    """The queries, arriving as a stream of files."""
    import uuid

    from quiverdf.streaming.search import search_stream

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = unit(spark, folder)
    asked(docs).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("qid long, embedding array<float>").parquet(f"{root}/in")
    sink = lambda found, n: found.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    search_stream(stream, docs, 10, sink, f"{root}/progress", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("qid", "rank", "vec_id", r6("dist").alias("dist"))
