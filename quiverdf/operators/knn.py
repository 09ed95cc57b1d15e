"""Exact nearest neighbours: blocks of queries against all rows.

A few queries are collected in blocks of a bounded size and sent with the task; each partition of the corpus keeps
only its own top k for each query, so what is shuffled is (partitions x queries x k) rows, never pairs. Where all
rows ask (``knn_all``), blocks meet blocks on the executors. Either way a task holds distances of TILE pairs at once.
Matrix products choose candidates, with a margin for their rounding; these are compared by sums in component order,
so that equal vectors are equally far. Ties go to the smaller id. Null vectors and, for ``cosine``, zero vectors
match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.functions.vectors import distance, doubles, engine_score
from quiverdf.operators.lineage import cut_lineage

#: Numbers of query components that one block holds at most (32 MB of doubles).
BLOCK_NUMBERS = 4_000_000
#: Distances that a task holds at once, and numbers of a block of rows that meets others, at most.
TILE, ROW_NUMBERS = 1_000_000, 32_768
#: Blocks that a task holds to meet others (32 MB), blocks that go to Python at once (1 MB), and tasks at least.
HELD_BLOCKS, BATCH_BLOCKS, LOTS = 128, 4, 32


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of the pairs of rows, added up in component order as SQL does."""
    add = lambda a, b: np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))
    if metric == "euclidean":
        return add(x - q, x - q)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - add(x, q) / (np.sqrt(add(x, x)) * np.sqrt(add(q, q)))
    return 1 - add(x, q)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of one query's distances, ties to the smaller id."""
    ok = ~np.isnan(dist)
    dist, ids = dist[ok], ids[ok]
    if len(dist) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        dist, ids = dist[near], ids[near]
    order = np.lexsort((ids, dist))[:k]
    return dist[order], ids[order]


class Nearest:
    """The k nearest rows that a block of queries has met so far, by distance and id."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.qids, self.q, self.k, self.metric, self.exclude_self = qids, q, k, metric, exclude_self
        self.at, self.ids, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.kth = np.full(len(qids), np.inf)
        self.unit = self._unit(q)
        self.norm = (self.unit * self.unit).sum(1)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows = max(1, min(len(ids), TILE // max(1, min(len(self.qids), 2_048))))
        queries = max(1, TILE // rows)
        for i in range(0, len(ids), rows):
            unit = self._unit(x[i : i + rows])
            norm = (unit * unit).sum(1)
            for j in range(0, len(self.qids), queries):
                self._tile(slice(j, min(j + queries, len(self.qids))), ids[i : i + rows], x[i : i + rows], unit, norm)

    def _tile(self, block: slice, ids: np.ndarray, x: np.ndarray, unit: np.ndarray, norm: np.ndarray) -> None:
        q, qn = self.unit[block], self.norm[block]
        near = q @ unit.T
        if self.metric == "euclidean":
            near *= -2
            near += norm
            near += qn[:, None]
        else:
            np.subtract(1, near, out=near)
        if self.exclude_self:
            order = np.argsort(ids, kind="stable")
            low, high = (np.searchsorted(ids[order], self.qids[block], side=s) for s in ("left", "right"))
            times = high - low
            own = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
            near[np.repeat(np.arange(len(q)), times), order[own]] = np.nan
        # What rounding may move a sum of products by; vectors without a norm have no candidates.
        margin = 1e-15 * (q.shape[1] + 8) * (1 + qn + norm[np.isfinite(norm)].max(initial=0.0))
        most = self.kth[block] + margin
        hit = near <= most[:, None]
        if near.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(q):
            least = np.where(np.isnan(near), np.inf, near)
            least.partition(self.k - 1, axis=1)
            hit = near <= np.minimum(most, least[:, self.k - 1] + 2 * margin)[:, None]
            del least
        at, of = np.nonzero(hit)
        del near, hit
        step = max(1, TILE // max(1, 2 * x.shape[1]))
        for i in range(0, len(at), step):
            a, o = at[i : i + step] + block.start, of[i : i + step]
            self._merge(a, ids[o], _exact(self.metric, self.q[a], x[o]))

    def _merge(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        ok = dist <= self.kth[at]  # not a number: no distance
        at, ids, dist = at[ok], ids[ok], dist[ok]
        if not len(at):
            return
        lo, hi = np.searchsorted(self.at, [at.min(), at.max() + 1])
        a, i, d = (np.concatenate(z) for z in ((self.at[lo:hi], at), (self.ids[lo:hi], ids), (self.dist[lo:hi], dist)))
        order = np.lexsort((i, d, a))
        a = a[order]
        first = np.searchsorted(a, a)
        place = np.arange(len(a)) - first
        keep = place < self.k
        full = order[place == self.k - 1]
        self.kth[a[place == self.k - 1]] = d[full]
        order, a = order[keep], a[keep]
        self.at = np.concatenate([self.at[:lo], a, self.at[hi:]])
        self.ids = np.concatenate([self.ids[:lo], i[order], self.ids[hi:]])
        self.dist = np.concatenate([self.dist[:lo], d[order], self.dist[hi:]])

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qids[self.at], "vec_id": self.ids, "dist": self.dist})


def blocks_of(queries: DataFrame, dim_limit: int = BLOCK_NUMBERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, block by block."""
    ids, vectors = [], []
    held = 0
    for r in queries.select("qid", doubles("embedding").alias("v")).where("v IS NOT NULL").toLocalIterator():
        ids.append(r["qid"])
        vectors.append(r["v"])
        held += len(r["v"])
        if held >= dim_limit:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", exclude_self: bool = False) -> DataFrame:
    """(qid, rank, vec_id, dist) of the ``k`` nearest of ``docs`` (vec_id, embedding) to each of ``queries`` (qid, embedding)."""
    found = None
    rows = docs.select("vec_id", doubles("embedding").alias("v")).where("v IS NOT NULL")
    for qids, q in blocks_of(queries):

        def scan(batches: Iterator[pd.DataFrame], qids=qids, q=q) -> Iterator[pd.DataFrame]:
            best = Nearest(qids, q, k, metric, exclude_self)
            for b in batches:
                if len(b):
                    best.meet(b["vec_id"].to_numpy(np.int64), np.stack(b["v"].to_list()))
            yield best.table()

        part = rows.mapInPandas(scan, "qid long, vec_id long, dist double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "qid long, vec_id long, dist double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "vec_id", "dist")


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(ids, vectors): blocks of ``most`` rows (vec_id, v) at most, as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [b.iloc[i : i + most] for i in range(0, len(b), most)]
            vectors = [np.stack(p["v"].to_list()).astype(np.float64).tobytes() for p in blocks]
            yield pd.DataFrame({"ids": [p["vec_id"].to_numpy(np.int64).tobytes() for p in blocks], "vectors": vectors})

    return rows.mapInPandas(pack, "ids binary, vectors binary")


def knn_all(points: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """(qid, rank, vec_id, dist) of the ``k`` nearest others of each of ``points`` (vec_id, embedding).

    Blocks of points go to files once. A task holds HELD_BLOCKS of them at most and lets others ask, one at a time; no
    row holds more than one block and none is sent twice to a task. The driver sees no vector, and what is shuffled is
    the blocks for each group that asks or is held, and points x k rows for each group that is held."""
    rows = points.select("vec_id", doubles("embedding").alias("v")).where("v IS NOT NULL")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, ROW_NUMBERS // max(1, dim or 1))
    count = max(1, -(-n // most))
    blocks = cut_lineage(packed(rows.repartition(count), most))
    held = min(count, max(4, -(-count // HELD_BLOCKS)))
    asking = min(count, max(1, -(-max(LOTS, 2 * points.sparkSession.sparkContext.defaultParallelism) // held)))
    # Lot i * held + j: group i of the blocks asks group j.
    no = F.spark_partition_id()
    meets = lambda n, lot, asks: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(lot(i).alias("lot"), F.lit(asks).alias("asks")))
    both = F.concat(
        meets(asking, lambda i: i * held + F.col("no") % held, False),
        meets(held, lambda j: F.col("no") % asking * held + j, True),
    )
    lots = blocks.withColumn("no", no).select(F.explode(both).alias("m"), "ids", "vectors").select("m.lot", "m.asks", "ids", "vectors")
    lots = lots.repartitionById(asking * held, F.col("lot")).sortWithinPartitions("asks")  # those that are held come first

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        others = None
        for b in batches:
            for asks, ids, vectors in zip(b["asks"], b["ids"], b["vectors"], strict=True):
                i = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors).reshape(len(i), -1)
                if not asks:
                    held.append((i, x))
                    continue
                if held:
                    others, held = [np.concatenate(c) for c in zip(*held, strict=True)], []
                if others is None:  # a group may have no rows
                    continue
                best = Nearest(i, x, k, metric, True)
                best.meet(*others)
                yield best.table()

    return cut_lineage(_ranked(lots.mapInPandas(scan, "qid long, vec_id long, dist double"), k), BATCH_BLOCKS)


def knn_expr(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", score: bool = False) -> DataFrame:
    """The same as array expressions, for few queries over small tables: bit-exact sums in component order."""
    if queries.count() > 10_000:
        raise ValueError("knn_expr broadcasts its queries and is for 10000 at most; use knn")
    q = F.broadcast(queries.select("qid", F.col("embedding").alias("__q")))  # checked above
    value = engine_score(metric, "embedding", "__q") if score else distance(metric, "embedding", "__q")
    pairs = docs.select("vec_id", "embedding").join(q).select("qid", "vec_id", value.alias("dist")).where("dist IS NOT NULL")
    order = Window.partitionBy("qid").orderBy(F.desc("dist") if score else F.asc("dist"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = out.select("qid", "rank", "vec_id", "dist")
    return out.withColumnRenamed("dist", "score") if score else out


def nearest(docs: DataFrame, query: list[float], k: int, metric: str = "dot") -> DataFrame:
    """(vec_id, dist) for one query: a top-k without any shuffle of the rest."""
    from quiverdf.functions.vectors import literal

    return docs.select("vec_id", distance(metric, "embedding", literal(query)).alias("dist")).where("dist IS NOT NULL").orderBy("dist", "vec_id").limit(k)


def knn_graph(points: DataFrame, k: int = 32, metric: str = "euclidean") -> DataFrame:
    """(src, dst, dist): each point joined to its ``k`` nearest others, both ways, once."""
    near = knn_all(points, k, metric)
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = near.select(F.explode(F.array(ends("qid", "vec_id"), ends("vec_id", "qid"))).alias("e"), "dist")
    return both.groupBy("e.src", "e.dst").agg(F.min("dist").alias("dist"))


def neighbourhoods(centres: DataFrame, m: int) -> DataFrame:
    """(cluster, rank, other, dist): the ``m`` nearest other centres of each of (cluster, centre)."""
    c = centres.select(F.col("cluster").cast("long").alias("vec_id"), F.col("centre").alias("embedding"))
    near = knn(c, c.withColumnRenamed("vec_id", "qid"), m, "euclidean", exclude_self=True)
    return near.select(F.col("qid").alias("cluster"), "rank", F.col("vec_id").alias("other"), "dist")


def support_sets(points: DataFrame, centres: DataFrame, m: int, metric: str = "euclidean") -> DataFrame:
    """(vec_id, rank, cluster, dist): the ``m`` nearest centres of each point, point by point."""
    from quiverdf.operators.kmeans import centre_array, collect_centres

    ids, c = collect_centres(centres)
    at = centre_array(c)
    each = F.transform(F.arrays_zip(at.alias("c"), F.array(*[F.lit(int(i)) for i in ids]).alias("i")), lambda z: F.struct(distance(metric, "embedding", z["c"]).alias("dist"), z["i"].alias("cluster")))
    top = F.slice(F.array_sort(each), 1, m)
    return points.select("vec_id", F.posexplode(top).alias("r", "s")).select("vec_id", (F.col("r") + 1).alias("rank"), F.col("s.cluster").alias("cluster"), F.col("s.dist").alias("dist"))
