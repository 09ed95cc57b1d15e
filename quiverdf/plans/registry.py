"""How a query and the SQL it is held against are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What the SQL begins with: vectors in double precision, and scaled so that metrics differ.
WITH = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT vec_id, list_transform(v, lambda x: x * (1 + vec_id % 7)) AS v, label FROM e)
"""

#: Columns that count or number things, 64 bits wide as SQL has them.
COUNTED = {"rank", "pos", "i", "j"}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name; ``sql`` goes on after WITH."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int" and c in COUNTED})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = WITH + sql
        return f

    return add


def unit(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, embedding, label): vectors of length 1."""
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    """The same, vector i being 1 + i % 7 times as long."""
    by = F.col("vec_id") % 7 + 1
    return unit(spark, folder).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * by))


def asked(docs: DataFrame) -> DataFrame:
    """The queries that searches answer: every row whose id is divisible by 100."""
    return docs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long_form(df: DataFrame, vector: str = "embedding", name: str = "x") -> DataFrame:
    """(vec_id, pos, x), rounded."""
    return df.select("vec_id", F.posexplode(vector).alias("pos", "__x")).select("vec_id", "pos", r6("__x").alias(name))
