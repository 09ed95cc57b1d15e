"""Samples that are the same for the same rows and seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A multiplicative hash to 32 bits that SQL engines can repeat.
MULTIPLIER, RANGE = 2_654_435_761, 4_294_967_296


def place(id_col: str = "vec_id", seed: int = 0) -> Column:
    """A pseudo-random number below RANGE for each id."""
    return F.pmod((F.col(id_col).cast("bigint") + seed + 1) * F.lit(MULTIPLIER).cast("bigint"), F.lit(RANGE).cast("bigint"))


def bernoulli(df: DataFrame, p: float, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """Each row with probability ``p``, decided by its id: all rows from 1 on, none up to 0. No shuffle."""
    if p >= 1:
        return df
    if p <= 0:
        return df.limit(0)
    return df.where(place(id_col, seed) < int(p * RANGE))


def reservoir(df: DataFrame, size: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """Exactly ``size`` rows (or all, if fewer), each set as likely as any: the top of a hash order."""
    return df.orderBy(place(id_col, seed), id_col).limit(size)


def stratified(df: DataFrame, size: int, by: str, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """At most ``size`` rows of each group; the limit applies before the shuffle too."""
    order = Window.partitionBy(by).orderBy(place(id_col, seed), id_col)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).drop("__r")


def with_replacement(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def split_queries(df: DataFrame, n: int, seed: int = 0, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(queries, corpus): ``n`` rows held out, and the rest."""
    queries = reservoir(df, n, seed, id_col)
    return queries, df.join(F.broadcast(queries.select(id_col)), id_col, "left_anti")  # n rows


def random_partitions(df: DataFrame, parts: int, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """A column ``part`` in 1..parts by hash."""
    return df.withColumn("part", (F.floor(place(id_col, seed) * parts / RANGE) + 1).cast("int"))


def quantile_partitions(df: DataFrame, parts: int, value: Column, accuracy: int = 100_000) -> DataFrame:
    """A column ``part`` in 1..parts by the quantiles of ``value``, found without a global sort."""
    from pyspark.sql import functions as F

    valued = df.withColumn("__v", value)
    at = [i / parts for i in range(1, parts)]
    cuts = valued.agg(F.percentile_approx("__v", at, accuracy)).first()[0] if at else []
    part = F.lit(1)
    for c in cuts or []:
        part = part + (F.col("__v") > F.lit(c)).cast("int")
    return valued.withColumn("part", part).drop("__v")
