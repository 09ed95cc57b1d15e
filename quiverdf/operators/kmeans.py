"""k-means and its kin. Points stay distributed; centres, few and small, travel with the tasks.

A step is one pass: each partition assigns its points with matrix products and returns sums of its own, so a
step shuffles (partitions x clusters) rows. Ties go to the cluster that comes first; empty clusters keep their
centre. What trains on the driver trains on a sample whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.functions.vectors import doubles, literal, soar_distance, squared_distance
from quiverdf.operators.knn import packed
from quiverdf.operators.lineage import cut_lineage
from quiverdf.operators.sampling import reservoir, stratified

#: Numbers that a set of centres may have to be sent to every task (256 MB of doubles).
MOST_NUMBERS = 32_000_000
#: Points that the driver trains on at most.
SAMPLE = 262_144
#: Distances between points and centres that are held at once.
TILE = 4_000_000
#: Clusters whose sums travel as one row.
SUMMED = 256


def collect_centres(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of (cluster, centre), by id."""
    rows = sorted(centres.select("cluster", doubles("centre").alias("c")).collect(), key=lambda r: r["cluster"])
    return np.array([r["cluster"] for r in rows], np.int64), sendable(np.array([r["c"] for r in rows], np.float64))


def sendable(c: np.ndarray) -> np.ndarray:
    if c.size > MOST_NUMBERS:
        raise ValueError(f"{c.size} numbers in the centres; {MOST_NUMBERS} are the most that is broadcast")
    return c


def centre_array(c: np.ndarray) -> Column:
    return F.array(*[literal(row) for row in c])


def centre_table(spark, c: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    ids = range(len(c)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, c, strict=True)], "cluster int, centre array<double>")


def matrix(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a bounded sample, by id."""
    rows = sorted(points.select("vec_id", doubles("embedding").alias("v")).collect(), key=lambda r: r["vec_id"])
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def nearest_centres(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of each point's nearest centre, a bounded number of points at a time."""
    at, low = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, TILE // max(1, len(c)))
    for i in range(0, len(x), step):
        dist = squared_distances(x[i : i + step], c)
        at[i : i + step] = dist.argmin(1)
        low[i : i + step] = dist[np.arange(len(dist)), at[i : i + step]]
    return at, low


# --- on the driver, over a bounded sample --------------------------------------------------------------------


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, subspaces: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """k-means++ in each of ``subspaces`` equal parts of the components: (centres, chosen rows of x: k by parts).

    Where all points coincide with chosen centres the next is any point."""
    n, d = x.shape
    width = d // subspaces
    chosen = np.empty((k, subspaces), np.int64)
    for s in range(subspaces):
        part = x[:, s * width : (s + 1) * width]
        chosen[0, s] = rng.integers(n)
        low = ((part - part[chosen[0, s]]) ** 2).sum(1)
        for i in range(1, k):
            mass = low.sum()
            chosen[i, s] = rng.choice(n, p=low / mass) if mass > 0 else rng.integers(n)
            low = np.minimum(low, ((part - part[chosen[i, s]]) ** 2).sum(1))
    centres = np.concatenate([x[chosen[:, s], s * width : (s + 1) * width] for s in range(subspaces)], axis=1)
    return centres, chosen


def forgy(x: np.ndarray, k: int, rng: np.random.Generator, subspaces: int = 1) -> np.ndarray:
    """k different rows for each part of the components."""
    width = x.shape[1] // subspaces
    return np.concatenate([x[rng.choice(len(x), k, replace=False), s * width : (s + 1) * width] for s in range(subspaces)], axis=1)


def local_lloyd(x: np.ndarray, c: np.ndarray, iterations: int, spherical: bool = False, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, assignment, mean squared distance) after at most ``iterations`` steps."""
    c, last = c.copy(), np.inf
    at, cost = np.zeros(len(x), int), np.inf
    for _ in range(max(1, iterations)):
        at, low = nearest_centres(x, c)
        cost = float(low.mean())
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if spherical:
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        if last - cost <= tolerance * max(cost, 1e-300):
            break
        last = cost
    return c, at, cost


def hamerly(x: np.ndarray, c: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's steps that skip points whose bounds show that their centre is still the nearest."""
    dist = np.sqrt(squared_distances(x, c))
    at = dist.argmin(1)
    two = np.partition(dist, 1, axis=1)[:, :2] if len(c) > 1 else np.stack([dist[:, 0], np.full(len(x), np.inf)], 1)
    upper, lower = two[:, 0].copy(), two[:, 1].copy()
    for _ in range(iterations):
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        moved_to = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        step = np.sqrt(((moved_to - c) ** 2).sum(1))
        c = moved_to
        upper += step[at]
        lower -= step.max()
        apart = np.sqrt(squared_distances(c, c))
        np.fill_diagonal(apart, np.inf)
        unsure = np.flatnonzero(upper > np.maximum(lower, apart.min(1)[at] / 2))
        if len(unsure):
            near = np.sqrt(squared_distances(x[unsure], c))
            at[unsure] = near.argmin(1)
            low = np.partition(near, 1, axis=1)[:, :2] if len(c) > 1 else np.stack([near[:, 0], np.full(len(near), np.inf)], 1)
            upper[unsure], lower[unsure] = low[:, 0], low[:, 1]
        if not step.any():
            break
    return c, at


def initial_centres(points: DataFrame, k: int, how: str = "plus_plus", seed: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """k centres: ``first`` (smallest ids), ``forgy`` or ``plus_plus`` over a sample, or ``distinct`` points."""
    if how == "first":
        return matrix(points.orderBy("vec_id").limit(k))[1]
    if how == "distinct":
        one = points.groupBy(doubles("embedding").alias("embedding")).agg(F.min("vec_id").alias("vec_id"))
        return matrix(reservoir(one, k, seed))[1]
    x = matrix(reservoir(points, sample, seed))[1]
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    return forgy(x, k, rng) if how == "forgy" else plus_plus(x, k, rng)[0]


# --- over all points -----------------------------------------------------------------------------------------


def assign(points: DataFrame, c: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """``vec_id, embedding, cluster, d2``: every point with its nearest centre."""
    sendable(c)
    names = np.arange(len(c)) if ids is None else np.asarray(ids)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_list()).astype(np.float64)
            at = nearest_centres(x, c)[0]
            yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": b["embedding"], "cluster": names[at], "d2": ((x - c[at]) ** 2).sum(1)})

    return points.select("vec_id", doubles("embedding").alias("embedding")).mapInPandas(scan, "vec_id long, embedding array<double>, cluster int, d2 double")


def assign_expr(points: DataFrame, c: np.ndarray) -> DataFrame:
    """The same (vec_id, cluster, d2) as an array expression, for few centres: no Python, no shuffle."""
    each = F.transform(centre_array(c), lambda v, i: F.struct(squared_distance("embedding", v).alias("d2"), i.cast("int").alias("cluster")))
    best = F.array_min(each)
    return points.select("vec_id", best["cluster"].alias("cluster"), best["d2"].alias("d2"))


def cluster_sums(assigned: DataFrame) -> DataFrame:
    """(cluster, pos, s, n): sums of the components of each cluster's points, added up within partitions first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_list())
            names, at = np.unique(b["cluster"].to_numpy(), return_inverse=True)
            part = np.zeros((len(names), x.shape[1]))
            np.add.at(part, at, x)
            for name, s, n in zip(names, part, np.bincount(at), strict=True):
                held = sums.setdefault(int(name), [0.0, 0])
                held[0], held[1] = held[0] + s, held[1] + int(n)
        yield pd.DataFrame([(k, s.tolist(), n) for k, (s, n) in sums.items()], columns=["cluster", "s", "n"])

    part = assigned.select("cluster", "embedding").mapInPandas(add, "cluster int, s array<double>, n long")
    return part.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))


def new_centres(assigned: DataFrame, c: np.ndarray, ids: np.ndarray | None = None, spherical: bool = False) -> np.ndarray:
    """Means of the assigned points; a cluster without any keeps its centre."""
    place = {int(v): i for i, v in enumerate(range(len(c)) if ids is None else ids)}
    out = c.copy()
    for r in cluster_sums(assigned).collect():  # clusters x components, both bounded by sendable()
        out[place[r["cluster"]], r["pos"]] = r["s"] / r["n"]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300) if spherical else out


def lloyd_step(points: DataFrame, c: np.ndarray, spherical: bool = False) -> tuple[np.ndarray, float]:
    """(centres, mean squared distance before they moved)."""
    assigned = assign(points, c)
    cost = assigned.agg(F.avg("d2")).first()[0]
    return new_centres(assigned, c, spherical=spherical), cost


def kmeans(points: DataFrame, c: np.ndarray, iterations: int = 8, sample: int = SAMPLE, seed: int = 0, spherical: bool = False) -> np.ndarray:
    """Lloyd's algorithm: all passes but the last over a sample, the last over all points."""
    if len(c) == 1:
        return new_centres(assign(points, c), c, spherical=spherical)
    x = matrix(reservoir(points, sample, seed))[1]
    if iterations > 1 and len(x):
        c = local_lloyd(x, c, iterations - 1, spherical)[0]
    return lloyd_step(points, c, spherical)[0]


def kmeans_full(points: DataFrame, c: np.ndarray, iterations: int = 8, tolerance: float = 0.0, spherical: bool = False) -> np.ndarray:
    """Lloyd's algorithm with every pass over all points."""
    last = None
    for _ in range(iterations):
        c, cost = lloyd_step(points, c, spherical)
        if last is not None and last - cost <= tolerance * max(cost, 1e-300):
            break
        last = cost
    return c


def lloyd_steps(points: DataFrame, starts: list[np.ndarray], spherical: bool = False) -> list[tuple[np.ndarray, float]]:
    """What ``lloyd_step`` gives for each of some sets of as many centres, in one pass over (vec_id, embedding).

    Partitions send sums of SUMMED clusters a row, which are added in the order of the partitions; the driver gets
    the new centres alone."""
    k, dim = starts[0].shape
    sendable(np.concatenate(starts))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n, cost, part = [np.zeros((k, dim)) for _ in starts], [np.zeros(k) for _ in starts], [0.0] * len(starts), TaskContext.get().partitionId()
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_list()).astype(np.float64)
            for i, c in enumerate(starts):
                at, low = nearest_centres(x, c)
                np.add.at(sums[i], at, x)
                n[i] += np.bincount(at, minlength=k)
                cost[i] += float(low.sum())
        for i in range(len(starts)):
            for j in range(0, k, SUMMED):
                if n[i][j : j + SUMMED].any():
                    held = np.column_stack([sums[i][j : j + SUMMED], n[i][j : j + SUMMED]]).tobytes()
                    yield pd.DataFrame({"start": [i], "first": [j], "part": [part], "sums": [held], "cost": [cost[i] * (j == 0)]})
            if not n[i][:SUMMED].any():  # the cost goes with the first clusters
                yield pd.DataFrame({"start": [i], "first": [0], "part": [part], "sums": [np.zeros((min(k, SUMMED), dim + 1)).tobytes()], "cost": [cost[i]]})

    def total(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        held = np.zeros_like(np.frombuffer(g["sums"].iloc[0]))
        for s in g["sums"]:
            held = held + np.frombuffer(s)
        return pd.DataFrame({"start": [key[0]], "first": [key[1]], "sums": [held.tobytes()], "cost": [float(g["cost"].cumsum().iloc[-1])]})

    rows = points.select(doubles("embedding").alias("embedding")).where("embedding IS NOT NULL")
    sent = rows.mapInPandas(add, "start int, first int, part int, sums binary, cost double")
    out, costs, count = [c.copy() for c in starts], [0.0] * len(starts), [0.0] * len(starts)
    for r in sent.groupBy("start", "first").applyInPandas(total, "start int, first int, sums binary, cost double").toLocalIterator():
        held = np.frombuffer(r["sums"]).reshape(-1, dim + 1)
        some = np.flatnonzero(held[:, -1])
        out[r["start"]][r["first"] + some] = held[some, :-1] / held[some, -1:]
        costs[r["start"]] += r["cost"]
        count[r["start"]] += held[:, -1].sum()
    if spherical:
        out = [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) for c in out]
    return [(c, cost / max(n, 1)) for c, cost, n in zip(out, costs, count, strict=True)]


def _rows_at(points: DataFrame, ids: np.ndarray) -> np.ndarray:
    """The vectors of the points with these ids, in their order."""
    wanted = points.sparkSession.createDataFrame(pd.DataFrame({"vec_id": np.unique(ids)}))
    found = packed(points.select("vec_id", F.col("embedding").alias("v")).join(F.broadcast(wanted), "vec_id"), 4_096).collect()  # bounded as centres are
    have = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in found])
    x = np.concatenate([np.frombuffer(r["vectors"]).reshape(len(r["ids"]) // 8, -1) for r in found])
    order = np.argsort(have, kind="stable")
    return x[order[np.searchsorted(have[order], ids)]]


def coarse_clusters(points: DataFrame, per_cluster: int, sample: int = SAMPLE, restarts: int = 5, iterations: int = 10, seed: int = 0, spherical: bool = False) -> np.ndarray:
    """ceil(n / per_cluster) centres: the best of several starts over a sample, then one pass over all points.

    The sample stays distributed; the driver has its ids and the centres, and all starts share each pass."""
    rows = points.select("vec_id", doubles("embedding").alias("embedding")).where("embedding IS NOT NULL")
    n = points.count()
    k = max(1, -(-n // per_cluster))
    sample = max(sample, k)
    some = rows if n <= sample else reservoir(rows, sample, seed)
    some = cut_lineage(some.repartition(max(1, -(-min(n, sample) // 8_192)), "vec_id"))
    ids = np.sort(some.select("vec_id").toPandas()["vec_id"].to_numpy(np.int64))
    if not len(ids):
        return np.empty((0, 0))
    rng = np.random.default_rng(seed)
    if k == 1:
        return lloyd_steps(some, [_rows_at(some, ids[:1])])[0][0]
    chosen = [ids[rng.choice(len(ids), k, replace=False)] for _ in range(restarts)]
    best, least = None, np.inf
    together = max(1, MOST_NUMBERS // (4 * k * len(_rows_at(some, ids[:1])[0])))
    for first in range(0, restarts, together):
        tries = [_rows_at(some, c) for c in chosen[first : first + together]]
        cost, going = [np.inf] * len(tries), list(range(len(tries)))
        for _ in range(max(1, iterations)):
            moved = lloyd_steps(some, [tries[i] for i in going], spherical)
            last = {i: cost[i] for i in going}
            for i, (c, now) in zip(going, moved, strict=True):
                tries[i], cost[i] = c, now
            going = [i for i in going if last[i] - cost[i] > 0]
            if not going:
                break
        i = int(np.argmin(cost))
        if best is None or cost[i] < least:
            best, least = tries[i], cost[i]
    return lloyd_steps(rows, [best], spherical)[0][0]


def _neighbours(c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest other centres of each centre, nearest first, ties to the first."""
    dist = squared_distances(c, c)
    np.fill_diagonal(dist, np.inf)
    return np.argsort(dist, axis=1, kind="stable")[:, : min(m, len(c) - 1)]


def assign_local(assigned: DataFrame, c: np.ndarray, near: np.ndarray) -> DataFrame:
    """Assign again, looking only at each point's centre and that centre's neighbours."""
    sendable(c)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, own = np.stack(b["embedding"].to_list()), b["cluster"].to_numpy().copy()
            d2 = np.empty(len(x))
            for k in np.unique(own):
                rows = np.flatnonzero(b["cluster"].to_numpy() == k)
                names = np.append(k, near[k])
                dist = squared_distances(x[rows], c[names])
                best = dist.argmin(1)
                own[rows], d2[rows] = names[best], dist[np.arange(len(rows)), best]
            yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": b["embedding"], "cluster": own, "d2": d2})

    return assigned.select("vec_id", "embedding", "cluster").mapInPandas(scan, "vec_id long, embedding array<double>, cluster int, d2 double")


def spill(assigned: DataFrame, c: np.ndarray, weight: float = 1.0, near: np.ndarray | None = None) -> DataFrame:
    """``vec_id, embedding, cluster, d2, spilled``: a second cluster for each point, at the least SOAR distance;
    never its own; among its centre's neighbours only, if those are given. -1 where there is no other."""
    sendable(c)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, own = np.stack(b["embedding"].to_list()), b["cluster"].to_numpy()
            second = np.full(len(x), -1)
            if len(c) > 1:
                r = x - c[own]
                norm = (r * r).sum(1)
                for k in np.unique(own):
                    rows = np.flatnonzero(own == k)
                    names = np.delete(np.arange(len(c)), k) if near is None else np.sort(near[k])
                    dist = squared_distances(x[rows], c[names])
                    along = (r[rows] * x[rows]).sum(1)[:, None] - r[rows] @ c[names].T
                    dist += weight * np.where(norm[rows, None] > 0, along**2 / np.maximum(norm[rows, None], 1e-300), 0)
                    second[rows] = names[dist.argmin(1)]
            yield b.assign(spilled=second)[["vec_id", "embedding", "cluster", "d2", "spilled"]]

    return assigned.mapInPandas(scan, "vec_id long, embedding array<double>, cluster int, d2 double, spilled int")


def spill_expr(points: DataFrame, c: np.ndarray, weight: float = 1.0) -> DataFrame:
    """(vec_id, cluster, spilled) as array expressions, for few centres."""
    own = assign_expr(points, c).select("vec_id", "cluster")
    at = centre_array(c)
    with_own = points.join(own, "vec_id").withColumn("own", F.element_at(at, F.col("cluster") + 1))
    residual = F.zip_with(doubles("embedding"), F.col("own"), lambda a, b: a - b)
    each = F.transform(at, lambda v, i: F.struct(soar_distance("embedding", v, residual, weight).alias("d"), i.cast("int").alias("cluster")))
    other = F.array_min(F.filter(each, lambda s: s["cluster"] != F.col("cluster")))
    return with_own.select("vec_id", "cluster", other["cluster"].alias("spilled"))


def kmeans_local(points: DataFrame, c: np.ndarray, m: int = 128, iterations: int = 6, sample: int = SAMPLE, seed: int = 0, weight: float = 1.0) -> tuple[np.ndarray, DataFrame]:
    """(centres, assigned with spills): Lloyd's passes among the neighbours of each point's centre."""
    if len(c) == 1:
        c = new_centres(assign(points, c), c)
        return c, assign(points, c).withColumn("spilled", F.lit(-1))
    near = _neighbours(c, m)
    some = assign(reservoir(points, sample, seed), c)
    for _ in range(max(0, iterations - 1)):
        c = new_centres(assign_local(some, c, near), c)
    c = new_centres(assign_local(assign(points, c), c, near), c)
    last = assign_local(assign(points, c), c, near)
    return c, spill(last, c, weight, near)


def some_of(x: np.ndarray, most: int, seed: int) -> np.ndarray:
    """``most`` rows of ``x`` at most, drawn from all of them, in their order."""
    return x if len(x) <= most else x[np.sort(np.random.default_rng(seed).permutation(len(x))[:most])]


def _splitter(split: dict[int, int], per_centre: int, iterations: int, seed: int):
    """A function that fits as many children as ``split`` says to a sample of one cluster."""

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = some_of(np.stack(g.sort_values("vec_id")["embedding"].to_list()), per_centre * split[key[0]], seed)
        start = np.unique(x, axis=0)
        start = start[np.random.default_rng(seed).permutation(len(start))[: split[key[0]]]]
        c = local_lloyd(x, start, 2 * iterations)[0]
        return pd.DataFrame({"cluster": int(key[0]), "child": range(len(c)), "centre": list(c)})

    return fit


def hierarchical(points: DataFrame, target: int = 512, most: int = 128, iterations: int = 6, per_centre: int = 256, seed: int = 0, levels: int = 16) -> tuple[np.ndarray, DataFrame]:
    """(centres, assigned): clusters above 1.34 times ``target`` are split again, level by level.

    Every level trains on a sample of each cluster to be split (``per_centre`` points for each new centre) and
    then moves all of its points, so no task sees a whole cluster."""
    rows = points.select("vec_id", doubles("embedding").alias("embedding"))
    state = rows.withColumn("cluster", F.lit(0)).withColumn("d2", F.lit(0.0))
    centres = {0: None}
    settled: set[int] = set()
    for _ in range(levels):
        state = cut_lineage(state)
        sizes = {r["cluster"]: r["count"] for r in state.groupBy("cluster").count().collect()}  # one row a cluster
        split = {k: min(most, max(2, round(n / target))) for k, n in sizes.items() if 100 * n > 134 * target and k not in settled}
        if not split:
            break
        wanted = state.where(F.col("cluster").isin(list(split)))
        sample = stratified(wanted, per_centre * max(split.values()), "cluster", seed)

        children: dict[int, list] = {}
        for r in sample.groupBy("cluster").applyInPandas(_splitter(split, per_centre, iterations, seed), "cluster int, child int, centre array<double>").collect():
            children.setdefault(r["cluster"], []).append((r["child"], r["centre"]))
        names: dict[int, np.ndarray] = {}
        fresh = max(centres) + 1
        for k, found in sorted(children.items()):
            ids = [k, *range(fresh, fresh + len(found) - 1)]  # the first child takes its parent's number
            fresh += len(found) - 1
            names[k] = np.array(ids)
            for i, (_, c) in zip(ids, sorted(found), strict=True):
                centres[i] = c
            if len(found) == 1:
                settled.add(k)
        tables = {k: (names[k], sendable(np.array([c for _, c in sorted(found)]))) for k, found in children.items()}

        def move(batches: Iterator[pd.DataFrame], tables=tables) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = b["cluster"].to_numpy().copy()
                for k in set(own.tolist()) & set(tables):
                    at = np.flatnonzero(b["cluster"].to_numpy() == k)
                    ids, c = tables[k]
                    own[at] = ids[squared_distances(np.stack(b["embedding"].iloc[at].to_list()), c).argmin(1)]
                yield b.assign(cluster=own)

        state = state.mapInPandas(move, "vec_id long, embedding array<double>, cluster int, d2 double")
    found = cluster_sums(state).collect()
    ids = sorted({r["cluster"] for r in found})
    dense = {k: i for i, k in enumerate(ids)}
    c = np.zeros((len(ids), 1 + max((r["pos"] for r in found), default=-1)))
    for r in found:
        c[dense[r["cluster"]], r["pos"]] = r["s"] / r["n"]
    number = F.create_map(*[F.lit(x) for k, i in dense.items() for x in (k, i)]) if len(ids) <= 4_096 else None
    if number is not None:
        state = state.withColumn("cluster", number[F.col("cluster")])
    else:
        table = state.sparkSession.createDataFrame(list(dense.items()), "cluster int, dense int")
        state = state.join(F.broadcast(table), "cluster").drop("cluster").withColumnRenamed("dense", "cluster")  # a row a cluster
    return c, state.select("vec_id", "embedding", "cluster", "d2")


def split_largest(points: DataFrame, k: int, per_split: int = 8, iterations: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, assignment) of a bounded sample on the driver: the largest cluster is split until there are k."""
    x = matrix(points)[1]
    at = np.zeros(len(x), int)
    while (have := at.max() + 1) < k:
        rows = np.flatnonzero(at == np.bincount(at).argmax())
        ways = min(per_split, k - have + 1, len(rows))
        if ways < 2:
            break
        start = np.unique(x[rows], axis=0)[:ways]
        if len(start) < 2:
            break
        own = local_lloyd(x[rows], start, iterations)[1]
        own = np.unique(own, return_inverse=True)[1]
        if own.max() == 0:
            break
        at[rows] = np.where(own == 0, at[rows], have - 1 + own)
    return np.array([x[at == i].mean(0) for i in range(at.max() + 1)]), at


def rekey_splits(assigned: DataFrame) -> DataFrame:
    """Dense numbers for (parent, child) pairs, in their order, without a window over all rows."""
    pairs = assigned.select("parent", "child").distinct()
    numbered = pairs.withColumn("cluster", F.dense_rank().over(Window.orderBy("parent", "child")) - 1)
    return assigned.join(F.broadcast(numbered), ["parent", "child"])  # a row a cluster
