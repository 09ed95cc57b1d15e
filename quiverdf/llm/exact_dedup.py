"""Exact deduplication with a heavy-hitter split.

A Misra-Gries sketch over the digests names those that may be frequent. Each of these is then counted
exactly, map-side first, and its winner broadcast, so that rows of large groups never meet in one task.
All other digests take the ordinary shuffle, combined before it; what the sketch let pass is no larger there than
its error, and split off by its exact count if it is.

Defined results: a null text is an empty one; null ids come last; of equal rows with equal ids exactly one
stays; an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.llm._shared import SPACE, Scratch, heavy_hitters, join_counted, text_of

#: Counters of the sketch, and at most so many digests taken as frequent: this bounds what is broadcast.
SKETCH_COUNTERS, MOST_HEAVY = 16_384, 2_048


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, over the whole text with white space made even."""
    even = F.regexp_replace(text_of(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(even, 256)).alias("digest"))


def heavy_digests(table: DataFrame, counters: int = SKETCH_COUNTERS, most: int = MOST_HEAVY) -> DataFrame:
    """Candidates for frequent digests, by their first 8 bytes: column ``head``. At most ``most`` rows."""
    found = heavy_hitters(table.select(_head().alias("head")), "head", most, counters)
    return found.where("n > 1").select(F.col("item").alias("head"))


def _head():
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = SKETCH_COUNTERS, most: int = MOST_HEAVY
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary)."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(digests(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()))
    heavy = scratch.keep(heavy_digests(table, counters, most))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    marked = table.withColumn("head", _head())
    # Verified on the full digest: exact counts and least ids, combined before the shuffle.
    winners = (
        marked.join(F.broadcast(heavy), "head", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    )
    hot = marked.join(F.broadcast(winners), "digest").select(  # at most `most` heads; more only if digests collide
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"), "digest",
    )
    # The rest is combined before the shuffle too; groups that the sketch let pass and are still large are broadcast.
    rest = marked.join(F.broadcast(heavy), "head", "left_anti").select("doc_id", "digest", "row_id")
    groups = scratch.keep(rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first")))
    rest = join_counted(rest, groups, "digest", "group_size", table.count()).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"), "digest",
    )
    return hot.unionByName(rest)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
