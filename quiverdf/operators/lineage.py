"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quiverdf-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the folder that driver and executors share; ``batch_rows``: rows of a Python batch meanwhile."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    conf = df.sparkSession.conf
    before = conf.get(BATCH)
    if batch_rows:
        conf.set(BATCH, str(batch_rows))
    try:
        return df.checkpoint()
    finally:
        if batch_rows:
            conf.set(BATCH, before)
