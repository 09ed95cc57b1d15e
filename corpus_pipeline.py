"""Stages of corpus preparation, each written as Parquet and read again by the next.

Toxic documents go; one document of each group of near copies stays; documents with benchmark passages go;
sources are mixed to their target weights, repeating documents where a source's budget asks for it; what is
left is put into balanced shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverdf.llm._shared import Scratch
from quiverdf.llm.decontamination import without_contaminated
from quiverdf.llm.jaccard import without_near_copies
from quiverdf.llm.mixing import mixed_documents
from quiverdf.llm.sharding import sharded_documents
from quiverdf.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The learnt scores of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if i:
            scratch.free(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {}
