"""Tables of vectors made, cut and joined; stores of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverdf.functions.vectors import doubles, normalise


def read_range(vectors: DataFrame, low: float, high: float, prepare: Callable[[Column], Column] | None = None, n: int | None = None) -> DataFrame:
    """The rows from a fraction ``low`` of the ids to a fraction ``high``, each ``prepare``d. Ids are dense from 0,
    so the bounds are pushed to the scan; ``n``, the number of rows, is counted if it is not given."""
    n = vectors.count() if n is None else n
    part = vectors.where((F.col("vec_id") >= int(low * n)) & (F.col("vec_id") < int(high * n)))
    return part.withColumn("embedding", prepare(doubles("embedding"))) if prepare else part


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", normalise("embedding"))


def generated(spark: SparkSession, n: int, dim: int, value: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, embedding): component j of row i is ``value(i * dim + j)``."""
    place = lambda j: F.col("vec_id") * dim + j
    return spark.range(n).select(F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: value(place(j)).cast("float")))


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Random vectors in the unit cube."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.random.default_rng((seed, int(i))).random(dim, np.float32) for i in b["id"]]
            yield pd.DataFrame({"vec_id": b["id"], "embedding": x})

    return spark.range(n).mapInPandas(make, "vec_id long, embedding array<float>")


def low_rank(spark: SparkSession, n: int, dim: int = 256, rank: int = 20, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Random vectors of ``rank`` dimensions turned into ``dim``, with some noise."""
    basis = np.random.default_rng(seed).standard_normal((rank, dim)) / np.sqrt(rank)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = np.random.default_rng((seed, 1, int(i)))
                rows.append((rng.standard_normal(rank) @ basis + noise * rng.standard_normal(dim)).astype(np.float32))
            yield pd.DataFrame({"vec_id": b["id"], "embedding": rows})

    return spark.range(n).mapInPandas(make, "vec_id long, embedding array<float>")


def concatenated(*tables: DataFrame) -> DataFrame:
    """Tables one after the other, ids of the later ones moved behind those of the earlier. Dimensions must agree."""
    dims = {r[0] for t in tables for r in t.where("embedding IS NOT NULL").select(F.size("embedding")).limit(1).collect()}
    if len(dims) > 1:
        raise ValueError(f"dimensions differ: {sorted(dims)}")
    out, first = None, 0
    for t in tables:
        part = t.select((F.col("vec_id") + first).alias("vec_id"), "embedding")
        first += t.count()
        out = part if out is None else out.unionByName(part)
    return out


def scan_partitions(vectors: DataFrame, visit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each partition's batches given to a callback, in parallel; every row once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield visit(b)

    return vectors.mapInPandas(each, schema)


# --- results -------------------------------------------------------------------------------------------------


def append_results(results: DataFrame, path: str) -> None:
    """Rows added to a store of CSV files with a header; the store is made if there is none."""
    results.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def with_config_hash(configs: DataFrame, columns: list[str]) -> DataFrame:
    """A column ``config_hash`` that names a configuration, whatever else its row holds."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    return configs.withColumn("config_hash", F.sha2(F.concat_ws("_", *parts), 256))


def not_yet_run(configs: DataFrame, done: DataFrame, columns: list[str]) -> DataFrame:
    """The configurations whose hash no finished row has."""
    return with_config_hash(configs, columns).join(done.select("config_hash").distinct(), "config_hash", "left_anti")
