"""Queries over vectors: functions, sources, samples and exact search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverdf.functions import codes as C
from quiverdf.functions import vectors as V
from quiverdf.operators import evaluation as E
from quiverdf.operators import knn as K
from quiverdf.operators import sampling as S
from quiverdf.operators.lineage import shared_dir
from quiverdf.plans.registry import asked, long_form, query, r6, scaled, unit
from quiverdf.sources import fvec, tables

TOP = """SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {key}, vec_id) AS rank, {out}
FROM p QUALIFY rank <= 10"""
DOT = "list_inner_product(a.v, b.v)"
COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _pairs(value: str, table: str = "s") -> str:
    return f", p AS (SELECT b.vec_id AS qid, a.vec_id, {value} AS d FROM {table} a, {table} b WHERE b.vec_id % 100 = 0) "


@query(", p AS (SELECT q.vec_id AS qid, a.vec_id, 1 - list_inner_product(a.v, q.v) AS d FROM e a, e q WHERE q.vec_id % 100 = 0) " + TOP.format(key="d", out="d AS dist"))
def knn_exact_dot(spark, folder):
    docs = unit(spark, folder)
    return K.knn_expr(docs, asked(docs), 10)


@query(_pairs(f"1 - {DOT}") + TOP.format(key="d", out="round(d, 6) + 0.0 AS dist"))
def knn_dot_scaled(spark, folder):
    docs = scaled(spark, folder)
    return K.knn(docs, asked(docs), 10).withColumn("dist", r6("dist"))


@query(_pairs(f"1 - {COS}") + TOP.format(key="d", out="round(d, 6) + 0.0 AS dist"))
def knn_cosine(spark, folder):
    docs = scaled(spark, folder)
    return K.knn(docs, asked(docs), 10, "cosine").withColumn("dist", r6("dist"))


@query(_pairs(D2) + TOP.format(key="d", out="round(d, 6) + 0.0 AS dist"))
def knn_euclidean(spark, folder):
    docs = scaled(spark, folder)
    return K.knn(docs, asked(docs), 10, "euclidean").withColumn("dist", r6("dist"))


@query(", one AS (SELECT a.vec_id, 1 - list_inner_product(a.v, b.v) AS d FROM e a, e b WHERE b.vec_id = 3) SELECT vec_id, d AS dist FROM one ORDER BY d, vec_id LIMIT 25")
def knn_single_query(spark, folder):
    docs = unit(spark, folder)
    q = docs.where("vec_id = 3").first()
    return K.nearest(docs, [float(x) for x in q["embedding"]], 25) if q else docs.select("vec_id", F.lit(0.0).alias("dist")).limit(0)


def _scores(value: str) -> str:
    return _pairs(value) + TOP.format(key="d DESC", out="round(d, 6) AS score")


@query(_scores(f"1 / (1 + {D2})"))
def knn_score_l2(spark, folder):
    docs = scaled(spark, folder)
    return K.knn_expr(docs, asked(docs), 10, "euclidean", score=True).withColumn("score", F.round("score", 6))


@query(_scores(f"0.5 + 0.5 * {COS}"))
def knn_score_cosine(spark, folder):
    docs = scaled(spark, folder)
    return K.knn_expr(docs, asked(docs), 10, "cosine", score=True).withColumn("score", F.round("score", 6))


@query(_scores(f"CASE WHEN {DOT} < 0 THEN 1 / (1 - {DOT}) ELSE 1 + {DOT} END"))
def knn_score_mip(spark, folder):
    docs = scaled(spark, folder)
    return K.knn_expr(docs, asked(docs), 10, "mip", score=True).withColumn("score", F.round("score", 6))


GRAPH = f""", p AS (SELECT b.vec_id AS src, a.vec_id AS dst, {D2} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
n AS (SELECT src, dst, d FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 8),
g AS (SELECT src, dst, min(d) AS dist FROM (SELECT src, dst, d FROM n UNION ALL SELECT dst, src, d FROM n) GROUP BY ALL) """


@query(GRAPH + "SELECT src, dst, round(dist, 6) + 0.0 AS dist FROM g")
def knn_graph(spark, folder):
    return K.knn_graph(unit(spark, folder), 8).withColumn("dist", r6("dist"))


MEANS = """, l AS (SELECT label AS cluster, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s) GROUP BY ALL),
c AS (SELECT cluster, list(m ORDER BY pos) AS v FROM l GROUP BY cluster) """


def label_centres(docs):
    """(cluster, centre): the mean vector of each label."""
    means = docs.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(F.col("label").alias("cluster")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))


@query(MEANS + f", p AS (SELECT a.cluster, b.cluster AS other, {D2} AS d FROM c a, c b WHERE a.cluster <> b.cluster) "
       "SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY d, other) AS rank, other, round(d, 6) AS dist FROM p QUALIFY rank <= 3")
def centre_neighbourhoods(spark, folder):
    near = K.neighbourhoods(label_centres(scaled(spark, folder)), 3)
    return near.select(F.col("cluster").cast("int").alias("cluster"), "rank", F.col("other").cast("int").alias("other"), F.round("dist", 6).alias("dist"))


@query(MEANS + f", p AS (SELECT a.vec_id, b.cluster, {D2} AS d FROM s a, c b) "
       "SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rank, cluster, round(d, 6) AS dist FROM p QUALIFY rank <= 3")
def support_sets(spark, folder):
    docs = scaled(spark, folder)
    return K.support_sets(docs, label_centres(docs), 3).withColumn("dist", F.round("dist", 6))


# --- functions -----------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_inner_product(v, v), 6) AS norm2, round(list_sum(v), 6) + 0.0 AS total FROM s")
def vector_norms(spark, folder):
    return scaled(spark, folder).select("vec_id", F.round(V.squared_norm("embedding"), 6).alias("norm2"), r6(V.total(F.col("embedding"))).alias("total"))


LONG = "SELECT vec_id, generate_subscripts({v}, 1) - 1 AS pos, round(unnest({v}), 6) + 0.0 AS x FROM {t}"


@query(", n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM s) " + LONG.format(v="v", t="n"))
def vector_normalise(spark, folder):
    return long_form(tables.normalised(scaled(spark, folder)))


@query(f"SELECT a.vec_id, round({DOT}, 6) + 0.0 AS dot, round({D2}, 6) AS d2 FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def vector_products(spark, folder):
    docs = scaled(spark, folder)
    other = docs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return docs.join(other, "vec_id").select("vec_id", r6(V.dot("embedding", "b")).alias("dot"), F.round(V.squared_distance("embedding", "b"), 6).alias("d2"))


@query(""", p AS (SELECT x.vec_id, list_transform(list_zip(x.v, c.v), lambda z: z[1] - z[2]) AS n, list_transform(list_zip(x.v, o.v), lambda z: z[1] - z[2]) AS r
FROM s x, s c, s o WHERE c.vec_id = 0 AND o.vec_id = 1)
SELECT vec_id, round(list_inner_product(n, n) + CASE WHEN list_inner_product(r, r) > 0 THEN pow(list_inner_product(r, n), 2) / list_inner_product(r, r) ELSE 0 END, 6) AS d FROM p""")
def soar_distances(spark, folder):
    docs = scaled(spark, folder)
    c = docs.where("vec_id = 0").select(F.col("embedding").alias("c"))
    o = docs.where("vec_id = 1").select(F.col("embedding").alias("o"))
    both = docs.join(F.broadcast(c)).join(F.broadcast(o))  # one row each
    return both.select("vec_id", F.round(V.soar_distance("embedding", "c", V.minus("embedding", "o")), 6).alias("d"))


@query(", p AS (SELECT vec_id, v || list_transform(range((24 - len(v) % 24) % 24), lambda i: 0.0::DOUBLE) AS v FROM s) SELECT vec_id, len(v) AS dim, round(list_sum(v), 6) + 0.0 AS total, v[-1] AS last FROM p")
def vector_zero_pad(spark, folder):
    p = scaled(spark, folder).withColumn("v", V.zero_pad("embedding", 24))
    return p.select("vec_id", F.size("v").cast("long").alias("dim"), r6(V.total(F.col("v"))).alias("total"), F.element_at("v", -1).alias("last"))


@query(", u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM s) SELECT vec_id, pos, round(x - avg(x) OVER (PARTITION BY pos), 6) + 0.0 AS x FROM u")
def vector_centre(spark, folder):
    docs = scaled(spark, folder)
    mean = V.mean_vector(docs)
    return long_form(docs.withColumn("embedding", V.minus("embedding", V.literal(mean))))


@query(f"SELECT a.vec_id, b.vec_id AS pos, round({DOT}, 6) + 0.0 AS x FROM s a, s b WHERE b.vec_id < 4")
def matrix_vector(spark, folder):
    docs = scaled(spark, folder)
    rows = sorted(docs.where("vec_id < 4").select("vec_id", "embedding").collect(), key=lambda r: r["vec_id"])
    m = F.array(*[V.literal(r["embedding"]) for r in rows])
    return long_form(docs.withColumn("embedding", V.matrix_vector(m, "embedding"))).withColumn("pos", F.col("pos").cast("long"))


@query(", u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM s) SELECT pos, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 6) AS var_samp, round(var_pop(x), 6) AS var_pop FROM u GROUP BY pos")
def component_stats(spark, folder):
    return V.component_stats(scaled(spark, folder)).select("pos", "n", r6("mean").alias("mean"), F.round("var_samp", 6).alias("var_samp"), F.round("var_pop", 6).alias("var_pop"))


@query(", u AS (SELECT vec_id, unnest(v) AS x FROM s) SELECT vec_id, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) AS variance, round(min(x), 6) AS low, round(max(x), 6) AS high FROM u GROUP BY vec_id")
def vector_moments(spark, folder):
    m = scaled(spark, folder).select("vec_id", V.moments("embedding").alias("m"))
    return m.select("vec_id", r6("m.mean").alias("mean"), F.round("m.variance", 6).alias("variance"), F.round("m.low", 6).alias("low"), F.round("m.high", 6).alias("high"))


@query(", u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM s) SELECT a.pos AS i, b.pos AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS c FROM u a JOIN u b USING (vec_id) GROUP BY ALL")
def covariance(spark, folder):
    _, c = V.covariance(scaled(spark, folder))
    return spark.createDataFrame([(i, j, float(round(c[i, j], 6)) + 0.0) for i in range(len(c)) for j in range(len(c))], "i int, j int, c double")


@query("SELECT vec_id, list_sum(list_transform(v, lambda x: (x > 0)::INT))::BIGINT AS ones, round(v[4] + v[8], 6) + 0.0 AS picked FROM s")
def binarise_and_pick(spark, folder):
    p = V.pick("embedding", [3, 7])
    return scaled(spark, folder).select("vec_id", V.l1_norm(V.binarise("embedding")).alias("ones"), r6(V.total(p)).alias("picked"))


@query(", u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM s WHERE true) SELECT vec_id, pos, round(pow(2, floor(x)) * (1 + x - floor(x)), 6) AS e, round(floor(log2(abs(x) + 1)) - 1 + (abs(x) + 1) / pow(2, floor(log2(abs(x) + 1))), 6) AS l FROM u")
def linear_exp_log(spark, folder):
    u = scaled(spark, folder).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return u.select("vec_id", "pos", F.round(V.approx_exp2(F.col("x")), 6).alias("e"), F.round(V.approx_log2(F.abs("x") + 1), 6).alias("l"))


@query()
def growth_of_distance(spark, folder):
    return E.growth_of_distance(unit(spark, folder), [0.25, 0.5, 1.0])


# --- sources -------------------------------------------------------------------------------------------------


@query(", n AS (SELECT count(*) AS n FROM s) SELECT vec_id, round(list_inner_product(v, v) / list_inner_product(v, v), 6) AS norm2 FROM s, n WHERE vec_id >= floor(0.25 * n) AND vec_id < floor(0.75 * n)")
def read_range(spark, folder):
    part = tables.read_range(scaled(spark, folder), 0.25, 0.75, V.normalise)
    return part.select("vec_id", F.round(V.squared_norm("embedding"), 6).alias("norm2"))


@query("SELECT i AS vec_id, j AS pos, ((i * 8 + j) * 0.5)::DOUBLE AS x FROM range(100) t(i), range(8) u(j)")
def generated(spark, folder):
    return tables.generated(spark, 100, 8, lambda p: p * 0.5).select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query(", n AS (SELECT count(*) AS n FROM e) SELECT vec_id, round(list_sum(v), 6) + 0.0 AS total FROM e UNION ALL SELECT vec_id + n, round(list_sum(v), 6) + 0.0 FROM s, n")
def concatenated(spark, folder):
    both = tables.concatenated(unit(spark, folder).withColumn("embedding", V.doubles("embedding")), scaled(spark, folder))
    return both.select("vec_id", r6(V.total(F.col("embedding"))).alias("total"))


@query("SELECT vec_id, round(list_sum(v), 4) + 0.0 AS total FROM e")
def fvec_round_trip(spark, folder):
    import uuid

    root = shared_dir(spark).removeprefix("file:").replace("//", "/")
    path = f"{root}/fvec-{uuid.uuid4().hex}"
    fvec.write_fvecs(unit(spark, folder), path)
    back = spark.read.format("fvec").load(path)
    return back.select("vec_id", (F.round(V.total(V.doubles("embedding")), 4) + F.lit(0.0)).alias("total"))


@query()
def uniform_vectors(spark, folder):
    return tables.uniform(spark, 1_000, 16).select("vec_id", V.squared_norm("embedding").alias("norm2"))


@query()
def low_rank_vectors(spark, folder):
    return tables.low_rank(spark, 1_000).select("vec_id", V.squared_norm("embedding").alias("norm2"))


@query("""SELECT sha256(concat_ws('_', label::VARCHAR, vec_id::VARCHAR)) AS config_hash, vec_id, label FROM e WHERE vec_id % 3 <> 0""")
def configs_not_run(spark, folder):
    configs = unit(spark, folder).select("vec_id", "label")
    done = tables.with_config_hash(configs.where("vec_id % 3 = 0"), ["label", "vec_id"])
    return tables.not_yet_run(configs, done, ["label", "vec_id"])


# --- samples -------------------------------------------------------------------------------------------------

PLACE = "((vec_id + 1) * 2654435761) % 4294967296"


@query(f"SELECT vec_id FROM e WHERE {PLACE} < floor(0.3 * 4294967296)")
def sample_bernoulli(spark, folder):
    return S.bernoulli(unit(spark, folder), 0.3).select("vec_id")


@query(f"SELECT vec_id FROM e ORDER BY {PLACE}, vec_id LIMIT 75")
def sample_reservoir(spark, folder):
    return S.reservoir(unit(spark, folder), 75).select("vec_id")


@query(f"SELECT label, vec_id FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY {PLACE}, vec_id) <= 5")
def sample_stratified(spark, folder):
    return S.stratified(unit(spark, folder), 5, "label").select("label", "vec_id")


@query(f", q AS (SELECT vec_id FROM e ORDER BY {PLACE}, vec_id LIMIT 20) SELECT vec_id, vec_id IN (SELECT vec_id FROM q) AS held FROM e")
def sample_split_queries(spark, folder):
    q, rest = S.split_queries(unit(spark, folder), 20)
    return q.select("vec_id", F.lit(True).alias("held")).unionByName(rest.select("vec_id", F.lit(False).alias("held")))


@query()
def sample_with_replacement(spark, folder):
    return S.with_replacement(unit(spark, folder), 0.5).select("vec_id")


@query(f"SELECT vec_id, (floor({PLACE} * 4 / 4294967296) + 1)::INT AS part FROM e")
def partition_random(spark, folder):
    return S.random_partitions(unit(spark, folder), 4).select("vec_id", "part")


@query(""", p AS (SELECT vec_id, vec_id % 7 AS k FROM e), q AS (SELECT quantile_disc(k, [0.25, 0.5, 0.75]) AS c FROM p)
SELECT vec_id, 1 + (k > c[1])::INT + (k > c[2])::INT + (k > c[3])::INT AS part FROM p, q""")
def partition_by_norm(spark, folder):
    norm = F.round(F.sqrt(V.squared_norm("embedding"))).cast("long") - 1
    return S.quantile_partitions(scaled(spark, folder), 4, norm).select("vec_id", "part")


# --- codes ---------------------------------------------------------------------------------------------------

CODES = ", k AS (SELECT vec_id, list_transform(v, lambda x: round(least(greatest((x + 0.3) / 0.6 * 15, 0), 15))::BIGINT) AS c FROM e) "


@query(CODES + "SELECT a.vec_id, list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS dot, list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2]))::BIGINT AS packed, "
       "list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] > 7 AND z[2] > 7)::INT))::BIGINT AS bits, true AS back FROM k a JOIN k b ON b.vec_id = a.vec_id + 1")
def integer_products(spark, folder):
    code = F.transform(V.doubles("embedding"), lambda x: F.round(F.least(F.greatest((x + 0.3) / 0.6 * 15, F.lit(0.0)), F.lit(15.0))).cast("int"))
    k = unit(spark, folder).select("vec_id", code.alias("c"))
    k = k.withColumn("p", C.pack_nibbles("c")).withColumn("b", C.pack_bits(F.transform("c", lambda x: (x > 7).cast("int"))))
    o = k.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("b").alias("b2"))
    return k.join(o, "vec_id").select("vec_id", C.int_dot("c", "c2").alias("dot"), C.packed_dot("p", "p2").alias("packed"), C.bits_dot("b", "b2").alias("bits"), (C.unpack_nibbles("p", F.size("c")) == F.col("c")).alias("back"))
