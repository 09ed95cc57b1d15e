"""Inverted-file indexes: postings of clusters, second assignments, quantised scans and re-ranking.

Postings are a table partitioned by cluster; a query's probes are few (cluster, qid) rows, so the scan reads
only the clusters that any query probes, and each task keeps each query's own top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.functions.vectors import doubles
from quiverdf.operators import osq
from quiverdf.operators.kmeans import assign, hierarchical, initial_centres, kmeans_full, sendable, spill, squared_distances
from quiverdf.operators.knn import _best, blocks_of


def postings(assigned: DataFrame) -> DataFrame:
    """(cluster, vec_id, embedding): every point under its cluster, and under its second if it has one."""
    own = assigned.select("cluster", "vec_id", "embedding")
    if "spilled" not in assigned.columns:
        return own
    more = assigned.where("spilled >= 0").select(F.col("spilled").alias("cluster"), "vec_id", "embedding")
    return own.unionByName(more)


def build_ivf(docs: DataFrame, k: int, metric: str = "dot", iterations: int = 5, weight: float = 1.0, seed: int = 0, how: str = "plus_plus") -> tuple[np.ndarray, DataFrame]:
    """(centres, postings): k-means, then a second cluster for each point if ``weight`` is above 0."""
    spherical = metric == "cosine"
    c = kmeans_full(docs, initial_centres(docs, k, how, seed), iterations, 1e-6, spherical)
    assigned = assign(docs, c)
    return c, postings(spill(assigned, c, weight) if weight > 0 else assigned)


def write_postings(table: DataFrame, path: str) -> None:
    """A folder for each cluster, so that probes prune what is read."""
    table.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)


def probes(queries: DataFrame, c: np.ndarray, n: int, metric: str = "dot") -> DataFrame:
    """(qid, cluster, query): the ``n`` nearest clusters of each query; no more than there are."""
    sendable(c)
    n = max(1, min(n, len(c)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = np.stack(b["query"].to_list())
                dist = squared_distances(q, c) if metric == "euclidean" else -q @ c.T
                at = np.argsort(dist, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"qid": np.repeat(b["qid"].to_numpy(), n), "cluster": at.ravel(), "query": [v for v in b["query"] for _ in range(n)]})

    return queries.select("qid", doubles("embedding").alias("query")).mapInPandas(near, "qid long, cluster int, query array<double>")


def _scan(lists: DataFrame, queries: DataFrame, c: np.ndarray, n: int, metric: str):
    """Joined (qid, vec_id, embedding, query) of the probed lists."""
    return lists.join(probes(queries, c, n, metric), "cluster")


def search(lists: DataFrame, queries: DataFrame, c: np.ndarray, k: int, n: int, metric: str = "dot") -> tuple[DataFrame, DataFrame]:
    """((qid, rank, vec_id, dist), (qid, n_compared)): postings of the probed clusters, twice-listed points once.

    The comparisons count a point each time that it is listed."""
    found = None
    counted = None
    for qids, q in blocks_of(queries):
        order = np.argsort(squared_distances(q, c) if metric == "euclidean" else -q @ c.T, axis=1, kind="stable")[:, : max(1, min(n, len(c)))]
        wanted = {int(k_): np.flatnonzero((order == k_).any(1)) for k_ in np.unique(order)}

        def scan(batches: Iterator[pd.DataFrame], q=q, qids=qids, wanted=wanted) -> Iterator[pd.DataFrame]:
            best = [(np.empty(0), np.empty(0, np.int64)) for _ in qids]
            seen = np.zeros(len(qids), np.int64)
            for b in batches:
                if not len(b):
                    continue
                x, ids, own = np.stack(b["embedding"].to_list()), b["vec_id"].to_numpy(np.int64), b["cluster"].to_numpy()
                for cluster in np.unique(own):
                    rows, at = np.flatnonzero(own == cluster), wanted[int(cluster)]
                    dist = squared_distances(q[at], x[rows]) if metric == "euclidean" else 1 - q[at] @ x[rows].T
                    seen[at] += len(rows)
                    for j, i in enumerate(at):
                        d, v = np.concatenate([best[i][0], dist[j]]), np.concatenate([best[i][1], ids[rows]])
                        v, first = np.unique(v, return_index=True)  # a point that is listed twice counts once
                        best[i] = _best(d[first], v, k)
            sizes = [len(d) for d, _ in best]
            yield pd.DataFrame({
                "qid": np.concatenate([np.repeat(qids, sizes), qids]), "vec_id": np.concatenate([*[v for _, v in best], np.full(len(qids), -1)]),
                "dist": np.concatenate([*[d for d, _ in best], np.zeros(len(qids))]), "n": np.concatenate([np.zeros(sum(sizes), np.int64), seen]),
            })

        part = lists.where(F.col("cluster").isin(list(wanted))).select("cluster", "vec_id", doubles("embedding").alias("embedding")).mapInPandas(scan, "qid long, vec_id long, dist double, n long")
        hits = part.where("vec_id >= 0").groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
        n_of = part.groupBy("qid").agg(F.sum("n").alias("n_compared"))
        found = hits if found is None else found.unionByName(hits)
        counted = n_of if counted is None else counted.unionByName(n_of)
    if found is None:  # no queries
        spark = lists.sparkSession
        return spark.createDataFrame([], "qid long, rank int, vec_id long, dist double"), spark.createDataFrame([], "qid long, n_compared long")
    top = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist"), counted


def search_expr(lists: DataFrame, queries: DataFrame, c: np.ndarray, k: int, n: int, metric: str = "dot") -> DataFrame:
    """The same top k as a join of probes and postings; with postings partitioned by cluster, Spark prunes them."""
    from quiverdf.functions.vectors import squared_distance, dot

    near = probes(queries, c, n, metric)
    dist = squared_distance("embedding", "query") if metric == "euclidean" else F.lit(1.0) - dot("embedding", "query")
    hits = lists.join(near, "cluster").select("qid", "vec_id", dist.alias("dist")).groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
    top = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


# --- quantised lists -----------------------------------------------------------------------------------------


def quantise_lists(lists: DataFrame, c: np.ndarray, bits: int, metric: str = "dot") -> DataFrame:
    """(cluster, vec_id, lo, hi, codes, l1, bias): residuals quantised, and what a distance needs of the vector:
    c . x, or the squared length of the residual for ``euclidean``."""
    sendable(c)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, own = np.stack(b["embedding"].to_list()), b["cluster"].to_numpy()
                r = x - c[own]
                lo, hi = osq.optimised(r, bits)
                q = osq.codes_of(r, lo, hi, bits)
                bias = (r * r).sum(1) if metric == "euclidean" else (c[own] * x).sum(1)
                yield pd.DataFrame({"cluster": own, "vec_id": b["vec_id"], "lo": lo, "hi": hi, "codes": list(q), "l1": q.sum(1).astype(np.int64), "bias": bias})

    return lists.select("cluster", "vec_id", doubles("embedding").alias("embedding")).mapInPandas(scan, "cluster int, vec_id long, lo double, hi double, codes array<int>, l1 long, bias double")


def estimate(q: np.ndarray, centre: np.ndarray, lo, hi, codes: np.ndarray, l1, bias, bits: int, metric: str) -> np.ndarray:
    """Estimated distances of one query to the quantised residuals of a cluster; the query takes 3 more bits."""
    r = (q - centre)[None, :]
    wide = min(8, bits + 3)
    qlo, qhi = osq.optimised(r, wide)
    qc = osq.codes_of(r, qlo, qhi, wide)[0].astype(np.float64)
    sx, sq = (hi - lo) / (2**bits - 1), float((qhi[0] - qlo[0]) / (2**wide - 1))
    product = len(q) * lo * qlo[0] + qlo[0] * sx * l1 + lo * sq * qc.sum() + sx * sq * (codes @ qc)
    if metric == "euclidean":
        return (r[0] ** 2).sum() + bias - 2 * product
    return 1 + (centre @ centre) - centre @ q - bias - product


def _estimated(lists: DataFrame, qids: np.ndarray, q: np.ndarray, c: np.ndarray, most: int, n: int, bits: int, metric: str) -> DataFrame:
    """(qid, vec_id, dist): of each partition of the lists the ``most`` best estimates for each of a block of queries."""
    order = np.argsort(squared_distances(q, c) if metric == "euclidean" else -q @ c.T, axis=1, kind="stable")[:, : max(1, min(n, len(c)))]
    wanted = {int(v): np.flatnonzero((order == v).any(1)) for v in np.unique(order)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in qids]
        for b in batches:
            if not len(b):
                continue
            own = b["cluster"].to_numpy()
            for cluster in np.unique(own):
                rows = np.flatnonzero(own == cluster)
                g = b.iloc[rows]
                codes = np.stack(g["codes"].to_list()).astype(np.float64)
                for i in wanted[int(cluster)]:
                    d = estimate(q[i], c[cluster], g["lo"].to_numpy(), g["hi"].to_numpy(), codes, g["l1"].to_numpy(), g["bias"].to_numpy(), bits, metric)
                    v = np.concatenate([best[i][1], g["vec_id"].to_numpy(np.int64)])
                    d = np.concatenate([best[i][0], d])
                    order_ = np.lexsort((d, v))
                    v, first = np.unique(v[order_], return_index=True)
                    best[i] = _best(d[order_][first], v, most)
        sizes = [len(d) for d, _ in best]
        yield pd.DataFrame({"qid": np.repeat(qids, sizes), "vec_id": np.concatenate([v for _, v in best]), "dist": np.concatenate([d for d, _ in best])})

    return lists.where(F.col("cluster").isin(list(wanted))).mapInPandas(scan, "qid long, vec_id long, dist double")


def search_quantised(lists: DataFrame, docs: DataFrame, queries: DataFrame, c: np.ndarray, k: int, n: int, bits: int, rerank: int = 4, metric: str = "dot") -> DataFrame:
    """(qid, rank, vec_id, dist): the best rerank x k by estimates, put in order by exact distances."""
    most, found = rerank * k, None
    for qids, q in blocks_of(queries):
        part = _estimated(lists, qids, q, c, most, n, bits, metric)
        found = part if found is None else found.unionByName(part)
    if found is None:  # no queries
        return docs.sparkSession.createDataFrame([], "qid long, rank int, vec_id long, dist double")
    found = found.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
    top = Window.partitionBy("qid").orderBy("dist", "vec_id")
    short = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= most).select("qid", "vec_id")
    from quiverdf.functions.vectors import dot, squared_distance

    exact = squared_distance("embedding", "query") if metric == "euclidean" else F.lit(1.0) - dot("embedding", "query")
    asked = queries.select("qid", doubles("embedding").alias("query"))
    checked = short.join(docs.select("vec_id", "embedding"), "vec_id").join(asked, "qid").select("qid", "vec_id", exact.alias("dist"))
    return checked.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


def build_quantised_ivf(docs: DataFrame, bits: int = 1, target: int = 512, metric: str = "dot", block: int = 32, seed: int = 0):
    """(preconditioned docs, (order, blocks), centres, quantised lists): hierarchical k-means with second
    clusters over rotated vectors, residuals quantised in each list."""
    from quiverdf.functions.vectors import component_stats
    from quiverdf.operators.kmeans import kmeans_local

    stats = sorted(component_stats(docs).collect(), key=lambda r: r["pos"])  # a row a component
    order = osq.balancing_permutation(np.array([r["var_pop"] for r in stats]), block)
    blocks = osq.random_orthogonal(len(stats), block)
    turned = osq.precondition(docs.select("vec_id", "embedding"), order, blocks)
    c, _ = hierarchical(turned, target, seed=seed)
    c, assigned = kmeans_local(turned, c, seed=seed)
    return turned, (order, blocks), c, quantise_lists(postings(assigned), c, bits, metric)
