"""Recall, cluster statistics, errors and the tables that experiments are read from."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverdf.functions.vectors import dot, minus, squared_distance, squared_norm


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """(qid, recall): the share of each query's exact (qid, vec_id) that the approximate ones hold."""
    hit = exact.select("qid", "vec_id").join(approx.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def recall_of(exact: Column, approx: Column) -> Column:
    """The same for two arrays of ids in a row."""
    return F.size(F.array_intersect(exact, approx)) / F.size(exact)


def recall_summary(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.min("recall").alias("low"), F.max("recall").alias("high"), F.avg("recall").alias("mean"))


def compared(recalls: DataFrame, comparisons: DataFrame, n: int) -> DataFrame:
    """(recall, comparisons, percent) averaged over (qid, recall) and (qid, n_compared)."""
    both = recalls.join(comparisons, "qid")
    return both.agg(F.avg("recall").alias("recall"), F.avg("n_compared").alias("comparisons"), (F.avg("n_compared") * 100 / n).alias("percent"))


def coverage(estimates: DataFrame, k: int, m: int) -> DataFrame:
    """(recall, covered): mean share of the exact top ``k`` among the estimated top ``m``, and how often the exact
    value lies within its bounds. ``estimates``: qid, vec_id, exact, estimate, low, high."""
    from pyspark.sql import Window

    top = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "vec_id"))
    inside = F.col("exact").between(F.col("low"), F.col("high")).cast("double")
    ranked = estimates.withColumn("re", top("exact")).withColumn("ra", top("estimate")).withColumn("in", inside)
    per = ranked.groupBy("qid").agg(F.avg(F.when(F.col("re") <= k, (F.col("ra") <= m).cast("double"))).alias("r"), F.avg("in").alias("c"))
    return per.agg(F.avg("r").alias("recall"), F.avg("c").alias("covered"))


def recall_by(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of ``average_recall`` for each set of parameters."""
    return results.groupBy(*by).agg(F.avg("average_recall").alias("mean"), F.stddev_pop("average_recall").alias("sd"))


def estimate_r2(results: DataFrame, key: str, full: int) -> DataFrame:
    """(sample_size, r2): squared correlation, over ``key``, of each sample size's recall with the full set's."""
    exact = results.where(F.col("sample_size") == full).groupBy(key).agg(F.avg("average_recall").alias("__full"))
    each = results.where(F.col("sample_size") != full).groupBy(key, "sample_size").agg(F.avg("average_recall").alias("__part"))
    return each.join(exact, key).groupBy("sample_size").agg(F.pow(F.corr("__part", "__full"), 2).alias("r2"))


def sensitivity(results: DataFrame, parameters: list[str]) -> DataFrame:
    """(sample_size, parameter, value, recall): mean recall by each parameter alone, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters]))
    long = results.select("sample_size", "average_recall", each.alias("p")).where("p.value IS NOT NULL")
    return long.groupBy("sample_size", F.col("p.parameter").alias("parameter"), F.col("p.value").alias("value")).agg(F.avg("average_recall").alias("recall"))


#: Index types of each family.
FAMILIES = {
    "hnsw": ("hnsw", "int8_hnsw", "int4_hnsw", "bbq_hnsw"),
    "flat": ("flat", "int8_flat", "int4_flat", "bbq_flat"),
    "disk": ("bbq_disk",),
}


def of_family(results: DataFrame, family: str, source: str | None = None) -> DataFrame:
    """Rows of an index family (``all`` for any) and, if given, of one source."""
    kept = results if family == "all" else results.where(F.col("index_type").isin(*FAMILIES[family]))
    return kept if source is None else kept.where(F.col("source") == source)


def parameter_grid(spark: SparkSession, **options: list) -> DataFrame:
    """One row for each combination, in order."""
    rows = list(product(*options.values()))
    return spark.createDataFrame(rows, list(options))


def cluster_sizes(assigned: DataFrame, k: int | None = None) -> DataFrame:
    """(cluster, n); clusters without points too if ``k`` is given."""
    n = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return n
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(n, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def size_moments(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.sum((F.col("n") > 0).cast("int")).alias("effective_k"))


def with_centres(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    return assigned.join(centres, "cluster")


def inertia(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """(inertia): mean squared distance to the point's own centre."""
    return with_centres(assigned, centres).agg(F.avg(squared_distance("embedding", "centre")).alias("inertia"))


def parallel_error(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, error): mean square of the residual's part along the centre, by cluster."""
    residual = minus("embedding", "centre")
    along = dot("centre", residual)
    norm = squared_norm("centre")
    return with_centres(assigned, centres).groupBy("cluster").agg(F.avg(F.when(norm > 0, along * along / norm).otherwise(0.0)).alias("error"))


def quantisation_rmse(exact: Column | str, decoded: Column | str) -> Column:
    return F.sqrt(squared_distance(exact, decoded))


def quantisation_angle(exact: Column | str, decoded: Column | str) -> Column:
    cos = dot(exact, decoded) / F.sqrt(squared_norm(exact) * squared_norm(decoded))
    return F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in equal bins; values outside go to bins 0 and bins + 1."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compression_ratio(dim: int, books: int, n: int, clusters: int, book_size: int) -> dict[str, float]:
    """Bytes of raw vectors over bytes of codes, alone and with codebooks, rotations and cluster numbers."""
    raw, vector = 4.0 * dim, float(books)
    extra = clusters * (4.0 * dim + 4.0 * dim * dim + 4.0 * dim * book_size)
    return {"vector": raw / vector, "index": n * raw / (n * (vector + 2) + extra)}


def growth_of_distance(points: DataFrame, fractions: list[float], k: int = 10, seed: int = 0) -> DataFrame:
    """(slope, intercept, r2) of the logarithm of the mean k-NN distance against that of the sample size."""
    from quiverdf.operators.knn import knn_all
    from quiverdf.operators.sampling import bernoulli

    rows = []
    for f in fractions:
        part = bernoulli(points, f, seed)
        near = knn_all(part, k, "euclidean")
        rows.append((part.count(), near.agg(F.avg(F.sqrt(F.greatest("dist", F.lit(0.0))))).first()[0]))
    table = points.sparkSession.createDataFrame(rows, "n long, d double").select(F.log("n").alias("x"), F.log("d").alias("y"))
    return table.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def best_parameters(trials: DataFrame) -> DataFrame:
    """The row with the least 10 x inertia / least inertia + seconds / least seconds."""
    least = trials.agg(F.min("inertia").alias("li"), F.min("seconds").alias("ls"))
    scored = trials.join(F.broadcast(least)).withColumn("score", 10 * F.col("inertia") / F.col("li") + F.col("seconds") / F.col("ls"))  # one row
    return scored.drop("li", "ls").orderBy("score").limit(1)


@contextmanager
def timed(record: dict, name: str):
    """Seconds that a block takes, under ``name``."""
    began = time.perf_counter()
    yield
    record[name] = time.perf_counter() - began


def queries_per_second(run: Callable[[], object], n: int) -> float:
    began = time.perf_counter()
    run()
    return n / (time.perf_counter() - began)
