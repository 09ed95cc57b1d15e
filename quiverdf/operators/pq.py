"""Product quantisation in two levels: coarse clusters, and in each a rotation and codebooks of residuals.

Everything that is learnt is small and trained on bounded samples of each cluster (``fit_cluster`` runs once a
cluster, as a task); encoding and scanning pass over all documents without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.functions.vectors import doubles, literal, squared_norm
from quiverdf.operators.kmeans import assign, coarse_clusters, forgy, local_lloyd, lloyd_step, plus_plus, sendable, squared_distances, some_of
from quiverdf.operators.sampling import stratified

#: Published defaults: books, centres of each, steps to build and to refresh, restarts, sample for the restarts.
BOOKS, BOOK_SIZE, BUILD_STEPS, REFRESH_STEPS, RESTARTS, RESTART_SAMPLE = 24, 256, 8, 3, 5, 8_192
#: Points of a cluster that its rotation and codebooks are trained on, for each dimension and each centre.
PCA_POINTS, BOOK_POINTS = 64, 128


# --- learning, on bounded samples ----------------------------------------------------------------------------


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvectors as rows, eigenvalues), largest first, of the population covariance."""
    y = x - x.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / len(y))
    return vectors[:, ::-1].T, np.maximum(values[::-1], 0)


def balanced_subspaces(vectors: np.ndarray, values: np.ndarray, books: int) -> np.ndarray:
    """A rotation whose consecutive blocks of rows have near equal products of eigenvalues.

    Eigenvectors go, largest first, to the block with the least product so far that has room."""
    d = len(values)
    if d % books:
        raise ValueError(f"{d} dimensions do not divide into {books} books")
    if len(vectors) != d or (np.diff(values) > 1e-9 * max(1.0, values[0])).any():
        raise ValueError("as many eigenvectors as eigenvalues are needed, largest first")
    if values[0] <= 0:
        return np.eye(d)
    logs = np.log(np.maximum(values, 1e-8 * values[0]))
    blocks: list[list[int]] = [[i] for i in range(books)]
    room = [(logs[i], i) for i in range(books)] if d > books else []
    heapq.heapify(room)
    for j in range(books, d):
        product, b = heapq.heappop(room)
        blocks[b].append(j)
        if len(blocks[b]) < d // books:
            heapq.heappush(room, (product + logs[j], b))
    return vectors[[j for b in blocks for j in b]]


def fit_codebooks(x: np.ndarray, books: int, size: int, steps: int = BUILD_STEPS, seed: int = 0, start: np.ndarray | None = None) -> np.ndarray:
    """Centres (books, size, width): k-means in each part of the components, from the best of several starts."""
    rng = np.random.default_rng(seed)
    width, size = x.shape[1] // books, min(size, len(x))
    out = np.empty((books, size, width))
    few = x[rng.permutation(len(x))[:RESTART_SAMPLE]]
    for b in range(books):
        cut = slice(b * width, (b + 1) * width)
        first = start[b] if start is not None else min((local_lloyd(few[:, cut], forgy(few[:, cut], size, rng), 4) for _ in range(RESTARTS)), key=lambda t: t[2])[0]
        out[b] = local_lloyd(x[:, cut], first, steps, tolerance=1e-4)[0]
    return out


def encode(x: np.ndarray, centres: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    """Codes (rows, books): the nearest centre of each part, the first among equals.

    With a threshold T above 0 the error along the vector weighs more: by T^2 / (1 - T^2) (d - 1)."""
    books, size, width = centres.shape
    out = np.empty((len(x), books), np.int32)
    norm = np.maximum((x * x).sum(1), 1e-300)[:, None]
    weight = threshold**2 / (1 - threshold**2) * (x.shape[1] - 1) - 1 if threshold > 0 else 0.0
    for b in range(books):
        part = x[:, b * width : (b + 1) * width]
        cost = squared_distances(part, centres[b])
        if threshold > 0:
            cost = cost + weight * ((part * part).sum(1)[:, None] - part @ centres[b].T) ** 2 / norm
        out[:, b] = cost.argmin(1)
    return out


def decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([centres[b][codes[:, b]] for b in range(len(centres))], axis=1)


@dataclass
class PqModel:
    """Coarse centres, and for each cluster a rotation (rows are directions) and codebooks."""

    metric: str
    centres: np.ndarray
    rotations: np.ndarray
    books: np.ndarray
    threshold: float = 0.0
    norms: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        sendable(self.rotations)
        width = self.books.shape[3]
        turned = np.einsum("kij,kj->ki", self.rotations, self.centres).reshape(len(self.centres), -1, width)
        # For each cluster, book and code: centre . word, and word . word.
        self.norms = (np.einsum("kbw,kbcw->kbc", turned, self.books), (self.books**2).sum(3))

    def encode(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.books.shape[1]), np.int32)
        for k in np.unique(cluster):
            at = np.flatnonzero(cluster == k)
            out[at] = encode((x[at] - self.centres[k]) @ self.rotations[k].T, self.books[k], self.threshold)
        return out

    def decode(self, codes: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.centres.shape[1]))
        for k in np.unique(cluster):
            if not 0 <= k < len(self.centres):
                raise IndexError(f"no cluster {k}")
            at = np.flatnonzero(cluster == k)
            out[at] = decode(codes[at], self.books[k]) @ self.rotations[k] + self.centres[k]
        return out / np.linalg.norm(out, axis=1, keepdims=True) if self.metric == "cosine" else out

    def table(self, k: int, q: np.ndarray) -> tuple[float, np.ndarray]:
        """(base, parts by book and code) of a query against a cluster: their sum is the similarity."""
        width = self.books.shape[3]
        if self.metric == "euclidean":
            turned = (self.rotations[k] @ (q - self.centres[k])).reshape(-1, 1, width)
            return 1.0, -((turned - self.books[k]) ** 2).sum(2)
        turned = (self.rotations[k] @ q).reshape(-1, width)
        return float(q @ self.centres[k]), np.einsum("bw,bcw->bc", turned, self.books[k])

    def distances(self, q: np.ndarray, codes: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """1 - the similarity of a query to coded documents, by table look-ups."""
        out = np.empty(len(codes))
        b = np.arange(codes.shape[1])
        for k in np.unique(cluster):
            at = np.flatnonzero(cluster == k)
            base, parts = self.table(k, q)
            similar = base + parts[b, codes[at]].sum(1)
            if self.metric == "cosine":
                cy, yy = (n[k][b, codes[at]].sum(1) for n in self.norms)
                similar = similar / np.sqrt(np.maximum((self.centres[k] ** 2).sum() + 2 * cy + yy, 1e-300))
            out[at] = 1 - similar
        return out


# --- tables --------------------------------------------------------------------------------------------------


def prepared(docs: DataFrame, metric: str, books: int | None = None) -> DataFrame:
    """Vectors normalised for ``cosine`` and padded with zeros to a multiple of ``books``."""
    from quiverdf.functions.vectors import normalise, zero_pad

    v = normalise("embedding") if metric == "cosine" else doubles("embedding")
    return docs.withColumn("embedding", zero_pad(v, books) if books else v).where("embedding IS NOT NULL")


def fit_pq(docs: DataFrame, metric: str = "cosine", books: int = BOOKS, size: int = BOOK_SIZE, per_cluster: int = 524_288, threshold: float = 0.0, seed: int = 0, centres: np.ndarray | None = None, old: PqModel | None = None) -> PqModel:
    """Centres (unless given), rotations and codebooks, from bounded samples of each cluster.

    With ``old`` (a model with as many clusters) its rotations stay and its codebooks are only refreshed."""
    c = coarse_clusters(docs, per_cluster, seed=seed, spherical=metric == "cosine") if centres is None else centres
    d = c.shape[1]
    most = max(PCA_POINTS * d, BOOK_POINTS * size)
    sample = stratified(assign(docs, c).select("vec_id", "embedding", "cluster"), most, "cluster", seed)

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        x = np.stack(g.sort_values("vec_id")["embedding"].to_list()) - c[k]
        turn = old.rotations[k] if old is not None else balanced_subspaces(*pca(some_of(x, PCA_POINTS * d, seed)), books)
        y = some_of(x, BOOK_POINTS * size, seed) @ turn.T
        book = fit_codebooks(y, books, size, BUILD_STEPS if old is None else REFRESH_STEPS, seed, None if old is None else old.books[k])
        return pd.DataFrame({"cluster": [k], "rotation": [turn.ravel()], "books": [book.ravel()], "size": [book.shape[1]]})

    rows = sample.groupBy("cluster").applyInPandas(fit, "cluster int, rotation array<double>, books array<double>, size int").collect()
    turns, found = np.stack([np.eye(d)] * len(c)), np.zeros((len(c), books, size, d // books))
    for r in rows:  # one row a cluster
        book = np.array(r["books"]).reshape(books, r["size"], -1)
        turns[r["cluster"]] = np.array(r["rotation"]).reshape(d, d)
        found[r["cluster"]] = book[:, np.minimum(np.arange(size), r["size"] - 1)]
    return PqModel(metric, c, turns, found, threshold)


def supplied_model(docs: DataFrame, metric: str, c: np.ndarray, books: int, size: int) -> PqModel:
    """Identity rotations, and as codebooks the parts of the residuals of the first ``size`` ids."""
    rows = sorted(docs.orderBy("vec_id").limit(size).select("vec_id", doubles("embedding").alias("v")).collect(), key=lambda r: r["vec_id"])
    x = np.array([r["v"] for r in rows])
    one = np.stack([x[:, b * (x.shape[1] // books) : (b + 1) * (x.shape[1] // books)] for b in range(books)])
    return PqModel(metric, c, np.stack([np.eye(x.shape[1])] * len(c)), np.stack([one] * len(c)))


def encode_docs(docs: DataFrame, model: PqModel) -> DataFrame:
    """(vec_id, cluster, codes) of all documents, without a shuffle."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_list())
                codes = model.encode(x, b["cluster"].to_numpy())
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": b["cluster"], "codes": list(codes)})

    return assign(docs, model.centres).mapInPandas(scan, "vec_id long, cluster int, codes array<int>")


def decode_docs(coded: DataFrame, model: PqModel) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = model.decode(np.stack(b["codes"].to_list()), b["cluster"].to_numpy())
                yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": list(x)})

    return coded.mapInPandas(scan, "vec_id long, embedding array<double>")


def search(coded: DataFrame, queries: DataFrame, model: PqModel, k: int) -> DataFrame:
    """(qid, rank, vec_id, dist): every document's table distance, each partition keeping its own top k."""
    from quiverdf.operators.knn import _best, blocks_of

    found = None
    for qids, q in blocks_of(prepared(queries, model.metric), 400_000):

        def scan(batches: Iterator[pd.DataFrame], qids=qids, q=q) -> Iterator[pd.DataFrame]:
            best = [(np.empty(0), np.empty(0, np.int64)) for _ in qids]
            for b in batches:
                if len(b):
                    ids, codes, at = b["vec_id"].to_numpy(np.int64), np.stack(b["codes"].to_list()), b["cluster"].to_numpy()
                    for i, v in enumerate(q):
                        d = model.distances(v, codes, at)
                        best[i] = _best(np.concatenate([best[i][0], d]), np.concatenate([best[i][1], ids]), k)
            sizes = [len(d) for d, _ in best]
            yield pd.DataFrame({"qid": np.repeat(qids, sizes), "vec_id": np.concatenate([v for _, v in best] or [[]]), "dist": np.concatenate([d for d, _ in best] or [[]])})

        part = coded.mapInPandas(scan, "qid long, vec_id long, dist double")
        found = part if found is None else found.unionByName(part)
    if found is None:  # no queries
        return coded.sparkSession.createDataFrame([], "qid long, rank int, vec_id long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


def model_tables(spark, model: PqModel) -> dict[str, DataFrame]:
    """clusters(cluster, centre, rotation), codebooks(cluster, book, code, centre) and
    norms(cluster, book, code, c_dot_r, r_norm2) of a model."""
    clusters = [(k, c.tolist(), r.tolist()) for k, (c, r) in enumerate(zip(model.centres, model.rotations, strict=True))]
    cells = [(k, b, i) for k in range(len(model.books)) for b in range(model.books.shape[1]) for i in range(model.books.shape[2])]
    return {
        "clusters": spark.createDataFrame(clusters, "cluster int, centre array<double>, rotation array<array<double>>"),
        "codebooks": spark.createDataFrame([(*c, model.books[c].tolist()) for c in cells], "cluster int, book int, code int, centre array<double>"),
        "norms": spark.createDataFrame([(*c, float(model.norms[0][c]), float(model.norms[1][c])) for c in cells], "cluster int, book int, code int, c_dot_r double, r_norm2 double"),
    }


def merge_models(docs: DataFrame, a: PqModel, b: PqModel, per_cluster: int, seed: int = 0) -> PqModel:
    """A model of all ``docs`` from those of two parts: centres chosen by k-means++ among both models' centres,
    documents assigned anew, rotations and codebooks of the chosen centres refreshed."""
    if a.metric != b.metric or a.books.shape[1:] != b.books.shape[1:] or a.centres.shape[1] != b.centres.shape[1]:
        raise ValueError("the indexes differ in metric, books or dimensions")
    union = np.concatenate([a.centres, b.centres])
    k = min(len(union), max(1, -(-docs.count() // per_cluster)))
    chosen = plus_plus(union, k, np.random.default_rng(seed))[1][:, 0]
    c = lloyd_step(docs, union[chosen], a.metric == "cosine")[0]
    old = PqModel(a.metric, c, np.concatenate([a.rotations, b.rotations])[chosen], np.concatenate([a.books, b.books])[chosen], a.threshold)
    return fit_pq(docs, a.metric, a.books.shape[1], a.books.shape[2], threshold=a.threshold, seed=seed, centres=c, old=old)


# --- the same steps as array expressions, for few clusters ---------------------------------------------------


def encode_expr(residual: Column, book: np.ndarray) -> Column:
    """Codes of a vector under one set of codebooks (books, size, width): no Python."""
    width = book.shape[2]

    def code(b: int) -> Column:
        part = F.slice(residual, b * width + 1, width)
        each = F.transform(F.array(*[literal(c) for c in book[b]]), lambda c, i: F.struct(squared_norm(F.zip_with(part, c, lambda x, y: x - y)).alias("d"), i.cast("int").alias("code")))
        return F.array_min(each)["code"]

    return F.array(*map(code, range(len(book))))
