"""Sharding by balanced label propagation.

Documents start in shards of equal count, dealt by a hash. In each turn documents look where their neighbours are
and want to move to the shard that holds most of them. Neighbours are the other documents of a group (equal texts,
or equal values of a column): there each group names its fullest shard. Or they are the ends of given links, an edge
table: there each document counts its neighbours' shards, and one half of the documents, drawn anew each turn, may
move, so that two ends do not keep changing places. Every move is paired with one the other way - another that
wants it, else a document without neighbours - so counts never change; those that gain most go first. All decisions
about quotas are made on tables with one row for each pair of shards. What the turns leave apart is reported.

The law is ``rows``: counts are at most one apart, before, during and after. A group larger than a shard is split by
a hash into whole shards and a rest. Null texts count as empty; rows that repeat an id are separate, and each is an
end of the id's links; links to ids that are not there, and of a document to itself, are ignored, and links that
repeat count once; empty tables give empty results; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.llm._shared import Scratch, identified, join_counted, join_groups, rows_of, text_of, unused, utf8_bytes, with_rank

SHARDS, TURNS = 40, 8
#: Bytes that a document takes besides its text.
OVERHEAD = 16


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, turns: int = TURNS, id_col: str = "doc_id", text_col: str = "text",
    group_col: str | None = None, row_col: str | None = None, links: DataFrame | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: __row, doc_id, size, text_crc32, shard, slot, and n_links (its neighbours),
    cut_before and cut (those in other shards before the first and after the last turn).

    ``links`` (a, b), ids: the neighbours, in place of groups."""
    scratch = Scratch(docs.sparkSession)
    text = text_of(text_col)
    group = F.col(group_col).cast("string") if group_col else F.sha2(text, 256)
    rows = rows_of(
        scratch, docs, row_col, doc_id=F.col(id_col), size=utf8_bytes(text) + OVERHEAD,
        text_crc32=F.crc32(text.cast("binary")), grp=F.unhex(F.md5(group)),
    )
    # By id, so that shards do not depend on how the files are split; rows without one by their number.
    key = F.xxhash64(F.lit("shard"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "__row")))
    ranked = with_rank(scratch, scratch.keep(rows.withColumn("key", key)), ["key", "__row"], "rank")
    state = scratch.keep(ranked.withColumn("shard", (F.col("rank") % shards).cast("int")).drop("rank"))
    total = state.count()
    # Documents with neighbours are the graph, the others make room.
    if links is None:
        linked, wants, cuts = _groups(scratch, state, max(1, total // shards), total)
    else:
        linked, wants, cuts = _edges(scratch, state, links, total)
    first = cuts(linked, "cut_before")
    free = scratch.keep(state.join(linked.select("__row"), "__row", "left_anti").select("__row", "key", "shard"))
    for turn in range(turns):
        moved = _one_turn(scratch, linked, free, wants(linked, turn))
        if moved is None:
            break
        if turn:
            scratch.free(linked)
        scratch.free(free)
        linked, free = moved
    labels = linked.select("__row", "shard").join(first, "__row").join(cuts(linked, "cut").drop("n_links"), "__row")
    none = [F.lit(0).cast("long").alias(c) for c in ("n_links", "cut_before", "cut")]
    labels = labels.unionByName(free.select("__row", "shard", *none))
    done = scratch.keep(state.drop("shard").join(labels, "__row"))
    return rank_in(scratch, done, ["shard"], ["key", "__row"], "slot")


def _groups(scratch: Scratch, state: DataFrame, quota: int, total: int):
    """((__row, key, shard, grp, members, hub) of documents in groups of two or more, what they want, their cuts)."""
    sizes = scratch.keep(state.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    part = F.floor(F.pmod("key", "members") / quota)  # whole shards and what is left, 0 for most groups
    linked = scratch.keep(
        join_counted(state, sizes, "grp", "members", total).select("__row", "key", "shard", "grp", "members", F.xxhash64("grp", part).alias("hub"))
    )

    def wants(linked: DataFrame, turn: int) -> DataFrame:
        held = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # The fullest shard of each group; a hash of group and shard breaks ties evenly.
        best = held.groupBy("hub").agg(
            F.max(F.struct("n", F.xxhash64("hub", "shard"), F.col("shard").alias("to")))["to"].alias("to")
        )
        # Members of small pieces go first.
        gain = held.alias("h").join(best, "hub").select("hub", "shard", "to", F.col("n").alias("here")).where("shard <> to")
        return linked.join(gain, ["hub", "shard"]).select("__row", "shard", "to", "here", "key")

    def cuts(linked: DataFrame, name: str) -> DataFrame:
        """(__row, n_links, ``name``): members of a document's group, and those in other shards."""
        each = linked.select("__row", "members", F.struct("grp", "shard").alias("piece"))
        pieces = each.groupBy("piece").agg(F.count(F.lit(1)).alias("here"))
        return join_counted(each, pieces, "piece", "here", total).select(
            "__row", (F.col("members") - 1).alias("n_links"), (F.col("members") - F.col("here")).alias(name)
        )

    return linked, wants, cuts


def _edges(scratch: Scratch, state: DataFrame, links: DataFrame, total: int):
    """((__row, key, shard) of documents with links, what they want, their cuts)."""
    ids = state.select(F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    pairs = links.select("a", "b").where("a <> b").distinct()
    pairs = pairs.join(ids.select(F.col("id").alias("a"), F.col("row").alias("u")), "a").join(ids.select(F.col("id").alias("b"), F.col("row").alias("v")), "b")
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = scratch.keep(both.distinct())
    degrees = scratch.keep(both.groupBy("v").agg(F.count(F.lit(1)).alias("degree")))
    ends = both.count()
    linked = scratch.keep(state.select("__row", "key", "shard").join(degrees.select(F.col("v").alias("__row")), "__row", "left_semi"))

    def votes(linked: DataFrame) -> DataFrame:
        """(u, there, n): neighbours of each document in each shard that has any."""
        where = linked.select(F.col("__row").alias("v"), F.col("shard").alias("there")).join(degrees, "v")
        met = join_groups(both, scratch.keep(where), "v", "degree", ends)
        return met.groupBy("u", "there").agg(F.count(F.lit(1)).alias("n"))

    def wants(linked: DataFrame, turn: int) -> DataFrame:
        own = linked.select(F.col("__row").alias("u"), "shard", "key")
        seen = votes(linked).join(own, "u").groupBy("u", "shard", "key").agg(
            F.max(F.struct("n", F.xxhash64("there", "u"), F.col("there").alias("to"))).alias("best"),
            F.coalesce(F.max(F.when(F.col("there") == F.col("shard"), F.col("n"))), F.lit(0)).alias("here"),
        )
        gain = F.col("best.n") - F.col("here")
        may = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
        return seen.where((gain > 0) & may).select(F.col("u").alias("__row"), "shard", F.col("best.to").alias("to"), (-gain).alias("here"), "key")

    def cuts(linked: DataFrame, name: str) -> DataFrame:
        met = votes(linked).join(linked.select(F.col("__row").alias("u"), "shard"), "u")
        return met.groupBy(F.col("u").alias("__row")).agg(
            F.sum("n").alias("n_links"), F.sum(F.when(F.col("there") != F.col("shard"), F.col("n")).otherwise(0)).alias(name)
        )

    return linked, wants, cuts


def rank_in(scratch: Scratch, rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add a rank, gapless from 0, in each of few groups, without one task seeing a whole group."""
    ranked = with_rank(scratch, rows, [*groups, *order], "__rank")
    starts = ranked.groupBy(*groups).agg(F.min("__rank").alias("__start"))
    return ranked.join(F.broadcast(starts), groups).withColumn(  # a row for each (pair of) shards
        name, F.col("__rank") - F.col("__start")
    ).drop("__rank", "__start")


def _leavers(scratch: Scratch, free: DataFrame, counts: dict[int, int], spare: dict[int, int]) -> DataFrame:
    """The rows of ``free`` that leave their shards, ``counts`` of each, those with the least keys, and their rank ``r``.

    Keys are hashes, so that those below a bound are about as many as it says; only they are ranked. Where they are
    too few after all, all are."""
    spark = free.sparkSession
    for slack in (1.25, None):
        low = {b: 2.0**63 if slack is None else min(2.0**63, -(2.0**63) + 2.0**64 * (slack * n + 64) / max(1, spare[b])) for b, n in counts.items()}
        bounds = spark.createDataFrame([(b, v) for b, v in low.items()], "shard int, bound double")
        near = scratch.keep(free.join(F.broadcast(bounds), "shard").where(F.col("key") <= F.col("bound")).drop("bound"))  # a row for each shard
        got = {r["shard"]: r["n"] for r in near.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        if slack is None or all(got.get(b, 0) >= n for b, n in counts.items()):
            return rank_in(scratch, near, ["shard"], ["key", "__row"], "r")
    raise AssertionError


def _one_turn(scratch: Scratch, linked: DataFrame, free: DataFrame, wanting: DataFrame):
    """The next (linked, free), or None if nothing can move. ``wanting``: __row, shard, to, here (least goes first), key."""
    wanting = scratch.keep(wanting)
    flow = {(r["shard"], r["to"]): r["n"] for r in wanting.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not flow:  # at most shards^2 rows
        return None
    spare = {r["shard"]: r["n"] for r in free.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves, fill = {}, {}
    for (a, b), n in sorted(flow.items(), key=lambda x: (-x[1], x[0])):
        back = min(n, flow.get((b, a), 0))
        room = min(n - back, spare.get(b, 0))  # documents without links that leave b for a
        if room:
            spare[b] -= room
            fill[b, a] = fill.get((b, a), 0) + room
        if back + room:
            moves[a, b] = back + room
    if not moves:
        return None
    spark = linked.sparkSession
    allowed = spark.createDataFrame([(*k, v) for k, v in moves.items()], "shard int, to int, allowed long")
    movers = (
        rank_in(scratch, wanting, ["shard", "to"], ["here", "key", "__row"], "r")
        .join(F.broadcast(allowed), ["shard", "to"])  # a row for each pair of shards
        .where("r < allowed")
        .select("__row", "to")
    )
    linked = scratch.keep(
        linked.join(movers, "__row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    )
    if fill:
        cut: dict[int, int] = {}
        spans = []
        for (b, a), n in sorted(fill.items()):
            spans.append((b, a, cut.get(b, 0), cut.get(b, 0) + n))
            cut[b] = cut.get(b, 0) + n
        spans = spark.createDataFrame(spans, "shard int, to int, low long, high long")
        leaving = (
            _leavers(scratch, free, cut, {b: spare[b] + n for b, n in cut.items()})
            .join(F.broadcast(spans), "shard")  # a row for each pair of shards
            .where("r >= low AND r < high")
            .select("__row", "to")
        )
        free = scratch.keep(
            free.join(leaving, "__row", "left").select("__row", "key", F.coalesce("to", "shard").alias("shard"))
        )
    else:
        free = scratch.keep(free)
    return linked, free


def sharded_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with columns ``shard`` and ``slot``, replacing any of those names."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    row = unused(docs, "__row")
    numbered = identified(scratch, docs, row)
    placed = balanced_shards(numbered, row_col=row, **options).select(F.col("__row").alias(row), "shard", "slot")
    return numbered.join(placed, row).drop(row)


def op2_balanced_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_links", "cut_before", "cut",
    )
