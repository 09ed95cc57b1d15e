"""One-bit quantisation with error bounds: signs of centred vectors against queries of four bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverdf.functions.vectors import binarise, dot, literal, mean_vector, minus, normalise, squared_norm, total

#: Width of the bound in standard deviations of a random rotation's error: a fixed value.
BOUND = 1.9


def quantise_query(q: Column, bits: int = 4, dither: float = 0.5, low: Column | None = None, high: Column | None = None) -> Column:
    """Struct (lo, hi, codes): floor(steps (x - lo) / (hi - lo) + dither)."""
    lo = F.array_min(q) if low is None else low
    hi = F.array_max(q) if high is None else high
    steps = F.when(hi > lo, F.lit(float(2**bits - 1)) / (hi - lo)).otherwise(0.0)
    codes = F.transform(q, lambda x: F.floor(steps * (F.least(F.greatest(x, lo), hi) - lo) + F.lit(dither)).cast("double"))
    return F.struct(lo.alias("lo"), hi.alias("hi"), codes.alias("codes"))


def signs(docs: DataFrame, centre: list[float]) -> DataFrame:
    """``docs`` with the sign ``bits`` of the centred vector, its length, its product with its own signs (``fit``)
    and with the centre."""
    d = len(centre)
    c = literal(centre)
    unit = normalise(F.col("__o"))
    return (
        docs.withColumn("__o", minus("embedding", c))
        .withColumn("__u", unit)
        .withColumn("bits", binarise("__u"))
        .withColumn("length", F.sqrt(squared_norm("__o")))
        .withColumn("fit", total(F.transform("__u", F.abs)) / math.sqrt(d))
        .withColumn("c_dot", dot("embedding", c))
        .drop("__o", "__u")
    )


def estimates(docs: DataFrame, queries: DataFrame, centre: list[float], dither: float = 0.5) -> DataFrame:
    """(qid, vec_id, exact, estimate, low, high) of the inner products, for a bounded set of queries."""
    if queries.count() > 10_000:
        raise ValueError("more than 10000 queries at once")
    d, c = len(centre), literal(centre)
    root = F.lit(math.sqrt(d))
    q = queries.withColumn("__r", minus("embedding", c)).withColumn("__q", quantise_query(normalise("__r"), 4, dither))
    q = q.select(
        "qid", F.col("embedding").alias("qv"), F.sqrt(squared_norm("__r")).alias("qn"), F.col("__q.lo").alias("lo"),
        ((F.col("__q.hi") - F.col("__q.lo")) / 15).alias("delta"), F.col("__q.codes").alias("qc"), total(F.col("__q.codes")).alias("qsum"), dot("embedding", c).alias("qc_dot"),
    )
    both = signs(docs, centre).join(F.broadcast(q))  # checked above
    ones = F.aggregate("bits", F.lit(0), lambda s, x: s + x)
    unit = (2 * F.col("delta") / root * dot("qc", "bits") + 2 * F.col("lo") / root * ones - F.col("delta") / root * F.col("qsum") - root * F.col("lo")) / F.col("fit")
    value = F.col("qn") * F.col("length") * unit + F.col("c_dot") + F.col("qc_dot") - F.lit(sum(x * x for x in centre))
    return (
        both.withColumn("estimate", value)
        .withColumn("error", error_bound(d))
        .select("qid", "vec_id", dot("embedding", "qv").alias("exact"), "estimate", (F.col("estimate") - F.col("error")).alias("low"), (F.col("estimate") + F.col("error")).alias("high"))
    )


def error_bound(d: int) -> Column:
    """How far an estimate may be off: |o| |q| 1.9 / sqrt(d - 1) sqrt((1 - fit^2) / fit^2)."""
    fit2 = F.col("fit") * F.col("fit")
    return F.col("length") * F.col("qn") * F.lit(BOUND / math.sqrt(d - 1)) * F.sqrt((1 - fit2) / fit2)


def pruned(estimated: DataFrame, k: int) -> DataFrame:
    """The rows whose upper bound reaches the k-th largest lower bound of their query: no other can be in its top k."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.desc("low"), "vec_id")
    kth = estimated.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("qid").agg(F.min("low").alias("least"))
    return estimated.join(kth, "qid").where(F.col("high") >= F.col("least")).drop("least")


def with_quantised_constant(df: DataFrame, name: str, bits: int = 8) -> DataFrame:
    """A column replaced by what is left of it after quantising it over its own range: one pass for the range."""
    low, high = df.agg(F.min(name), F.max(name)).first()
    if low is None or high <= low:
        return df
    step = (high - low) / (2**bits - 1)
    return df.withColumn(name, F.lit(float(low)) + F.floor((F.col(name) - F.lit(float(low))) / F.lit(step) + 0.5) * F.lit(step))


def centre_of(docs: DataFrame) -> list[float]:
    return mean_vector(docs)
