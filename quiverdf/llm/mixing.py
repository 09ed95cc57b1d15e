"""Mixing sources to target weights.

Every row gets a hash-random key. Keys are cut into ranges of a source (many for a large source), sorted
within each range, and prefix sums of the sizes run first over the ranges and then within each, so that no
task sees a whole source. Each source is cut at its exact budget; budgets above a source's size repeat it.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows that repeat an
id are separate rows, in a fixed order; an empty table gives an empty mix; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.llm._shared import Scratch, identified, join_groups, prefix_of, rows_of, text_of, unused, with_rank

WEIGHTS = (5, 2, 1)
#: Rows of a range at least, and ranges of all large sources at most: what is broadcast has no more rows.
RANGE_ROWS, MOST_RANGES = 4_096, 65_536


def word_count(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(scratch: Scratch, sources: DataFrame, share: float, most: int, weights=WEIGHTS) -> DataFrame:
    """Add ``target`` to (skey, source_size, n): weighted shares of the whole budget, each at most
    ``most`` times the source's size, what exceeds that shared again by weight."""
    ranked = with_rank(scratch, sources, ["skey"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranked.select("skey", "source_size", "n", weight.cast("double").alias("w")))
    cap = F.col("source_size") * most
    whole = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped, before = 0.0, F.lit(False), -1
    while True:  # the set of capped sources only grows; each turn reads one row of sums
        held, n, free = ranked.agg(
            F.sum(F.when(capped, cap)), F.count(F.when(capped, True)), F.sum(F.when(~capped, F.col("w")))
        ).first()
        if n == before or not free:
            break
        level, before = (whole - (held or 0)) / free, n
        capped = F.lit(level) * F.col("w") > cap
    return ranked.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.lit(level) * F.col("w")))


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: __row, doc_id, size, source_size, target, taken (words, repeats
    counted; a source's sum is its whole budget) and copies (whole documents, the one at the cut included)."""
    scratch = Scratch(docs.sparkSession)
    columns = _columns(id_col, text_col, source_col)
    sizes = rows_of(scratch, docs, row_col, **columns)
    sizes = scratch.keep(sizes.withColumn("key", _key(seed)))
    return _mixed(scratch, sizes, share, most, weights, range_rows)[0]


def _columns(id_col: str, text_col: str, source_col: str) -> dict:
    return {
        "doc_id": F.col(id_col),
        # Nulls last and never equal to a source's name.
        "skey": F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")),
        "size": word_count(text_of(text_col)),
    }


def _key(seed: str):
    """A hash of the id; of the row's number where there is no id, so that such rows are in many ranges too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "__row"))))


def _mixed(scratch: Scratch, sizes: DataFrame, share: float, most: int, weights, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """(the mix of ``sizes`` (__row, doc_id, skey, size, key), (skey, source_size, n, target))."""
    sources = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = scratch.keep(source_targets(scratch, sources, share, most, weights))
    rows = sizes.count()
    span = max(range_rows, -(-rows // MOST_RANGES))
    large = sources.where(F.col("n") > span).select("skey", F.ceil(F.col("n") / span).alias("ranges"))
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = sizes.join(F.broadcast(large), "skey", "left").withColumn(  # at most MOST_RANGES rows are large
        "bucket", F.coalesce(F.shiftright(unit * F.col("ranges"), 32), F.lit(0).cast("long"))
    )
    sums = ranged.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = prefix_of(sums, ["skey"], ["bucket"], "bucket_size", "start").join(
        sources.select("skey", "source_size", "target"), "skey"
    )
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "__row")
    placed = ranged.select("__row", "doc_id", "skey", "bucket", "size", "key").withColumn(
        "inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("start") - F.col("inside")))
    return placed.join(starts, ["skey", "bucket"]).select(
        "__row", "doc_id", "size", "source_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        (whole + (part > 0).cast("long")).cast("int").alias("copies"),
        "skey", "key", whole.cast("int").alias("whole"),
    ), sources


def mixed_documents(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, whole, with its own columns.

    What a source takes beyond whole repeats ends at one place of its order, so that rows are chosen by that place
    where they are read: a row for each source travels, not the rows."""
    scratch = Scratch(docs.sparkSession)
    row, copies, found = (unused(docs, c) for c in ("__row", "__copies", "__found"))
    numbered = identified(scratch, docs, row)
    columns = _columns(id_col, text_col, source_col)
    sizes = scratch.keep(rows_of(scratch, numbered, row, **columns).withColumn("key", _key(seed)))
    mix, sources = _mixed(scratch, sizes, share, most, weights, range_rows)
    place = F.struct("key", "doc_id", "__row")
    cuts = mix.groupBy("skey").agg(F.first("whole").alias("whole"), F.max(F.when(F.col("copies") > F.col("whole"), place)).alias("last"))
    cuts = scratch.keep(cuts.join(sources.select("skey", "n"), "skey"))
    # The columns of docs go along whole under one name, whatever theirs are; of a size only whether it is 0 matters.
    columns["size"] = text_of(text_col).rlike(r"[^\x20\x09-\x0D]").cast("int")
    own = numbered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(found), F.col(f"`{row}`").alias("__row"), *[c.alias(n) for n, c in columns.items()])
    chosen = join_groups(own.withColumn("key", _key(seed)), cuts, "skey", "n", sizes.count())
    often = F.col("whole") + F.when((F.col("size") > 0) & (place <= F.col("last")), 1).otherwise(0)
    return (
        chosen.select(found, often.alias(copies)).where(F.col(copies) > 0)
        .withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*[F.col(found)[c].alias(c) for c in docs.columns])
    )


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS sz, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(sz) OVER () * 1.5 AS whole,
         coalesce(sum(2 * sz) OVER (ORDER BY sz / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY sz / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), c AS (
  SELECT *, (whole - before) / rest * w > 2 * sz AS capped FROM o
), t AS (
  SELECT source, sz::BIGINT AS source_size,
         CASE WHEN capped THEN 2 * sz
              ELSE (max(whole) OVER () - coalesce(sum(CASE WHEN capped THEN 2 * sz END) OVER (), 0))
                   / sum(CASE WHEN NOT capped THEN w END) OVER () * w END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS times FROM p
)
SELECT doc_id, size, source_size, target,
       times * size + greatest(0, least(size, budget - times * source_size - before)) AS taken
FROM q
"""
