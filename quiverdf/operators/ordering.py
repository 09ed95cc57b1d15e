"""One-dimensional orders of vectors: a Hilbert curve for any table, annealed cuts for few points (centroids)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverdf.functions.vectors import doubles

ORDER = 16
#: Temperatures of a cut; parts that are cut no further; margin in mean vertex weights; rounds of polishing.
TEMPERATURES, LEAST_PART, MARGIN, ROUNDS = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25), 8, 0.08, 128


def hilbert_cells(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert numbers of whole-number cells (rows x dims, below 2^order), as big-endian bytes.

    Neighbours on the curve differ by 1 in exactly one dimension, whatever the dimension."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (order - 1)
    while bit > 1:  # undo the rotations and reflections of each level, from the highest bit
        low = bit - 1
        for i in range(n):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    bit = 1 << (order - 1)
    while bit > 1:
        t = np.where((x[-1] & bit) != 0, t ^ (bit - 1), t)
        bit >>= 1
    x ^= t
    bits = ((x[None, :, :] >> np.arange(order - 1, -1, -1)[:, None, None]) & 1).reshape(order * n, -1).T
    return np.packbits(bits.astype(np.uint8), axis=1)


def with_hilbert_key(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` with a binary column ``hilbert`` that sorts along the curve over the components' overall range."""
    values = docs.select(F.array_min(doubles("embedding")).alias("a"), F.array_max(doubles("embedding")).alias("b"))
    low, high = values.agg(F.min("a"), F.max("b")).first()
    low, width = (low or 0.0), ((high - low) if high is not None and high > low else 1.0)

    @F.pandas_udf("binary")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack(s.to_list()) if len(s) else np.empty((0, 1))
            cells = np.clip(((x - low) / width * (1 << order)).astype(np.int64), 0, (1 << order) - 1)
            yield pd.Series([row.tobytes() for row in hilbert_cells(cells, order)])

    return docs.withColumn("hilbert", key(doubles("embedding")))


def hilbert_order(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` sorted along the curve; ties by id. A range sort: no task sees all rows."""
    return with_hilbert_key(docs, order).orderBy("hilbert", "vec_id")


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, dist, weight): 5 a / (a + 4 dist) with a the mean of both ends' mean lengths; 5 where a is 0."""
    mean = edges.groupBy("src").agg(F.avg("dist").alias("m"))
    a = (F.col("ms") + F.col("md")) / 2
    both = edges.join(mean.select("src", F.col("m").alias("ms")), "src").join(mean.select(F.col("src").alias("dst"), F.col("m").alias("md")), "dst")
    return both.select("src", "dst", "dist", F.when(a > 0, 5 * a / (a + 4 * F.col("dist"))).otherwise(5.0).alias("weight"))


def order_cost(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(cost): mean over edges of weight x distance between positions. ``positions``: vec_id, pos."""
    at = lambda c: positions.select(F.col("vec_id").alias(c), F.col("pos").alias(f"p_{c}"))
    both = edges.join(at("src"), "src").join(at("dst"), "dst")
    return both.agg(F.avg(F.col("weight") * F.abs(F.col("p_src") - F.col("p_dst"))).alias("cost"))


class Graph:
    """Adjacency of few vertices on the driver or in a task."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.n, self.src, self.dst, self.weight = n, src[order], dst[order], weight[order]
        self.first = np.searchsorted(self.src, np.arange(n + 1))

    def cost(self, place: np.ndarray) -> float:
        return float((self.weight * np.abs(place[self.src] - place[self.dst])).mean()) if len(self.src) else 0.0

    def of(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        cut = slice(self.first[v], self.first[v + 1])
        return self.dst[cut], self.weight[cut]


def cut_order(g: Graph, order: np.ndarray, margin: float, rng: np.random.Generator) -> np.ndarray:
    """An order in which halves, quarters and so on are cut lightly: pairs across a cut swap with a chance that
    grows with what the swap saves, less and less at random."""
    order = order.copy()
    place = np.empty(g.n, np.int64)
    place[order] = np.arange(g.n)
    todo = [(0, g.n)]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAST_PART:
            continue
        mid = (a + b) // 2
        for heat in TEMPERATURES:
            left = place[g.dst] < mid
            pull = np.bincount(g.src, np.where(left, -g.weight, g.weight), g.n)  # towards the right, by vertex
            gain = pull[order[a:b]]
            out = a + np.argsort(-gain[: mid - a], kind="stable")
            back = mid + np.argsort(gain[mid - a :], kind="stable")[: mid - a]
            logit = (pull[order[out]] - pull[order[back]] - margin) / (heat * max(margin, 1e-12))
            chance = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            swap = rng.random(len(logit)) < np.where(logit < -10, 0, chance)
            i, j = out[swap], back[swap]
            order[i], order[j] = order[j], order[i]
            place[order[a:b]] = np.arange(a, b)
        todo += [(a, mid), (mid, b)]
    return order


def polish(g: Graph, order: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Neighbours in the order swap while that lowers the cost."""
    order = order.copy()
    place = np.empty(g.n, np.int64)
    place[order] = np.arange(g.n)
    for _ in range(rounds):
        swaps = 0
        for i in range(1, g.n):
            u, v = order[i], order[i - 1]
            change = 0.0
            for w, at, to in ((u, i, i - 1), (v, i - 1, i)):
                other, weight = g.of(w)
                k = place[other]
                keep = (k != i) & (k != i - 1)
                change += float((weight[keep] * (np.abs(k[keep] - to) - np.abs(k[keep] - at))).sum())
            if change < -1e-12:
                order[i], order[i - 1] = v, u
                place[u], place[v] = i - 1, i
                swaps += 1
        if not swaps:
            break
    return order


def annealed_order(points: DataFrame, k: int = 32, probes: int = 24, start: str = "identity", seed: int = 0) -> tuple[list[int], float]:
    """(ids in order, cost) of few points (centroids): independent probes as tasks, the best polished.

    ``start`` is ``identity`` or ``hilbert``; a second wave of probes goes on from the first wave's best."""
    from quiverdf.operators.knn import knn_graph

    edges = edge_weights(knn_graph(points, k)).collect()  # points x 2 k rows
    ids = sorted(r["vec_id"] for r in points.select("vec_id").collect())
    at = {v: i for i, v in enumerate(ids)}
    g = Graph(len(ids), np.array([at[r["src"]] for r in edges]), np.array([at[r["dst"]] for r in edges]), np.array([r["weight"] for r in edges]))
    margin = MARGIN * float(g.weight.sum() / g.n)
    first = np.arange(g.n)
    if start == "hilbert":
        first = np.array([at[r["vec_id"]] for r in hilbert_order(points).select("vec_id").collect()])
    place = lambda o: np.argsort(o, kind="stable")
    best, cost = first, g.cost(place(first))
    spark = points.sparkSession
    for wave in (0, 1):
        n = max(1, probes // 2)

        def probe(batches: Iterator[pd.DataFrame], best=best, wave=wave) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"]:
                    order = cut_order(g, best, margin, np.random.default_rng((seed, wave, int(i))))
                    yield pd.DataFrame({"cost": [g.cost(np.argsort(order, kind="stable"))], "id": [i], "order": [order]})

        row = spark.range(0, n, 1, min(n, 64)).mapInPandas(probe, "cost double, id long, order array<long>").orderBy("cost", "id").first()
        if row["cost"] < cost:
            best, cost = np.array(row["order"]), row["cost"]
    best = polish(g, best)
    return [ids[i] for i in best], g.cost(place(best))
