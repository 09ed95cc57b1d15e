"""Plumbing that the corpus operators share: scratch tables, ranks and text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"
#: What parts words: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quiverdf-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that Python workers get at once; rows here are texts, so Spark's default of 10000 holds much memory.
BATCH_ROWS, BATCH_BYTES = 500, "8m"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean_batches(spark: SparkSession) -> None:
    """Let Python workers take fewer rows and bytes at once, where the session leaves that at Spark's default."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
        spark.conf.set(_BYTES, BATCH_BYTES)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, to cut lineage so that lost executors cost no recomputation.

    Tables that a returned DataFrame still reads stay until the driver's JVM ends;
    ``free`` drops those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        lean_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quiverdf-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def keep(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the table that was written; ``batch_rows``: rows of a Python batch meanwhile."""
        if not self.paths:
            fs, where = self._fs(self.root)
            fs.mkdirs(where)
            fs.deleteOnExit(where)
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        conf = self.spark.conf
        # What is written needs its shuffle files no more.
        wanted = {CLEAN_UP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
        before = {k: conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]
        return out

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            fs, where = self._fs(self.paths[id(table)])
            fs.delete(where, True)


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of a text: runs of digits, ASCII letters (lower-cased) and all that is not ASCII."""
    # Two cheap ways to the same: only texts of ASCII alone may be lower-cased as a whole, and one blank parts fastest.
    ascii_only = F.octet_length(text) == F.length(text)
    parted = F.translate(text, UPPER + ASCII_GAPS, LOWER + " " * len(ASCII_GAPS))
    return F.array_remove(F.when(ascii_only, F.split(F.lower(text), NOT_WORD)).otherwise(F.split(parted, " ")), "")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def with_rank(scratch: Scratch, df: DataFrame, order: list, name: str) -> DataFrame:
    """Add a gapless 0-based rank in the given total order, without one task seeing all rows.

    A range sort is written out; its rows' positions in their partitions come from
    ``monotonically_increasing_id`` and each partition's offset from a table with one row a partition.
    """
    at = "__at"
    sorted_rows = scratch.keep(df.sort(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first"))
    offsets = prefix_of(counts, [], ["__part"], "__n", "__offset").select("__part", "__offset", "__first")
    return (
        sorted_rows.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row for each partition of the sort
        .withColumn(name, F.col("__offset") + F.col(at) - F.col("__first"))
        .drop("__part", "__offset", "__first", at)
    )


def prefix_of(df: DataFrame, keys: list, order: list, value: str, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each group, for small per-partition or per-range tables."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0)).cast("long"))


#: Lots, in turn, that ``first_rows`` draws from.
LOTS = (4096, 64)


def first_rows(df: DataFrame, order: list, by: list, most: int) -> DataFrame:
    """The first ``most`` rows in ``order``, in that order; ``by``: columns whose hash deals rows out evenly.

    Each lot keeps its own first ``most``, in levels, so that the last step gets 64 times ``most`` rows at the utmost,
    in however many partitions the rows are.
    """
    for lots in LOTS:
        over = Window.partitionBy("__lot").orderBy(*order)
        df = df.withColumn("__lot", F.pmod(F.xxhash64(*by), F.lit(lots)))
        df = df.withColumn("__place", F.row_number().over(over)).where(F.col("__place") <= most).drop("__lot", "__place")
    return df.orderBy(*order).limit(most)


#: Files of a scan whose names are sent to all tasks, to number their rows; rows of more files are numbered by a copy.
MOST_FILES = 100_000


def identified(scratch: Scratch, docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` with a row number that is the same on every reading, however files are dealt to tasks.

    Rows of a scan of Parquet files are numbered by their file and their place in it. All else is written out
    with its numbers first, as its rows may come in another order when they are computed again.
    """
    nodes = set(_plan_nodes(docs._jdf.queryExecution().optimizedPlan()))
    numbered = _by_place(scratch, docs, name) if nodes <= {"LogicalRelation", "Project", "Filter"} else None
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id())) if numbered is None else numbered


def _by_place(scratch: Scratch, docs: DataFrame, name: str) -> DataFrame | None:
    """``docs`` numbered by file and place, or None if the files do not tell a row's place or are too many."""
    if {"_metadata", "__file", "__at"} & {c.lower() for c in docs.columns}:
        return None
    try:
        placed = docs.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:
        return None
    files = scratch.keep(placed.groupBy("__file").agg((F.max("__at") + 1).alias("__n")))
    if files.count() > MOST_FILES:
        return None
    firsts = prefix_of(files, [], ["__file"], "__n", "__first").drop("__n")  # a row for each file
    return placed.join(F.broadcast(firsts), "__file").withColumn(name, F.col("__first") + F.col("__at")).drop("__file", "__at", "__first")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(scratch: Scratch, docs: DataFrame, row_col: str | None, **columns: Column) -> DataFrame:
    """(__row, and the named columns) of ``docs``; numbered here unless ``row_col`` holds numbers already."""
    named = [c.alias(n) for n, c in columns.items()]
    if row_col:
        return docs.select(F.col(f"`{row_col}`").alias("__row"), *named)
    return identified(scratch, docs.select(*named))


def _plan_nodes(plan):
    yield plan.nodeName().split(" ")[0]
    children = plan.children()
    for i in range(children.size()):
        yield from _plan_nodes(children.apply(i))


#: Rows that a table may have, counted, to be broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of narrow rows), to be broadcast if it has at most ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def heavy_hitters(df: DataFrame, value: str, most: int, counters: int) -> DataFrame:
    """(item): values of ``df`` (a written table) that a Misra-Gries sketch finds frequent; ``most`` rows at most.

    Sketches meet in two levels, as many groups as each has members, so that no task gathers those of all tasks.
    """
    groups = int(df.rdd.getNumPartitions() ** 0.5) + 1
    parts = df.groupBy((F.spark_partition_id() % groups).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate({value}, {int(counters)})").alias("sketch")
    )
    whole = parts.groupBy((F.col("g") * 0).alias("g")).agg(  # no row for no rows: nothing combines to nothing
        F.expr(f"approx_top_k_combine(sketch, {int(counters)})").alias("sketch")
    )
    top = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(most)})")).alias("t"))
    return top.select(F.col("t.item").alias("item"), F.col("t.count").alias("n"))


#: Groups with at least one in so many of all rows are few: at most this many.
MOST_LARGE = 10_000


def join_counted(big: DataFrame, groups: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """Inner join of rows to their groups (one row a group, ``count`` its size), whatever their sizes.

    The large groups, at most MOST_LARGE, are broadcast; so no task gathers the rows of one.
    """
    large = F.col(count) > max(1_000, rows // MOST_LARGE)
    some, rest = F.broadcast(groups.where(large)), groups.where(~large)
    return big.join(some, key).unionByName(big.join(some.select(key), key, "left_anti").join(rest, key))


def join_groups(big: DataFrame, groups: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """The same for ``groups`` that are a written table: a plain broadcast if they are few."""
    return big.join(F.broadcast(groups), key) if groups.count() <= BROADCAST_ROWS else join_counted(big, groups, key, count, rows)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component.

    Each turn takes the least label over the neighbours and then jumps to the label's own label, so that
    turns grow with the logarithm of a component's diameter; labels are written out after each. Nodes with very
    many neighbours and labels of very many nodes are met by broadcast.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.where("a <> b").distinct())
    rows = both.count()
    labels = scratch.keep(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("degree"))
    )
    while True:
        of_node = labels.select(F.col("node").alias("b"), "label", "degree")
        near = join_counted(both, of_node, "b", "degree", rows).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", "degree", "label", F.least("label", "low").alias("low")
        )
        lower = scratch.keep(lower)
        sizes = lower.groupBy("low").agg(F.count(F.lit(1)).alias("size"))
        own = scratch.keep(lower.select(F.col("node").alias("low"), F.col("low").alias("far")).join(sizes, "low"))
        jumped = join_counted(lower, own, "low", "size", lower.count())
        jumped = scratch.keep(
            jumped.select("node", "degree", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved"))
        )
        done = jumped.where("moved").isEmpty()
        scratch.free(lower, labels, own)
        labels = jumped
        if done:
            scratch.free(both)
            return labels.select("node", "label")
