"""Scalar quantisation with one interval for all components.

With S = 2^bits - 1 steps over [low, high], a component becomes round(S / (high - low) * (clamp(x) - low)). A
per-vector correction makes the estimated product of two vectors the sum of their corrections and of
the scaled product of their codes. An interval of no width gives codes of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverdf.functions.codes import int_dot
from quiverdf.functions.vectors import doubles, total
from quiverdf.operators.knn import knn
from quiverdf.operators.sampling import RANGE, place, reservoir

SAMPLE = 25_000


def steps_of(bits: int, levels: int | None = None) -> float:
    return float(levels if levels is not None else 2**bits - 1)


def _in(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def quantise(v: Column | str, low, high, steps: float) -> Column:
    """Codes of a vector; halves round away from zero."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    s = F.when(high > low, F.lit(steps) / (high - low)).otherwise(F.lit(0.0))
    return F.transform(doubles(v), lambda x: F.round(s * (_in(x, low, high) - low)).cast("int"))


def dequantise(codes: Column | str, low, high, steps: float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.transform(F.col(codes) if isinstance(codes, str) else codes, lambda q: low + q * (high - low) / F.lit(steps))


def correction(v: Column | str, low: float, high: float, steps: float) -> Column:
    """The part of a product that does not depend on the other vector."""
    s = steps / (high - low) if high > low else 0.0

    def part(x: Column) -> Column:
        d = F.round(F.lit(s) * (_in(x, F.lit(low), F.lit(high)) - F.lit(low))) / F.lit(s) if s else F.lit(0.0)
        return F.lit(low) * (x - F.lit(low / 2)) + ((x - F.lit(low)) - d) * d

    return total(F.transform(doubles(v), part))


def quantised(docs: DataFrame, low: float, high: float, bits: int, levels: int | None = None) -> DataFrame:
    """``docs`` with ``codes`` and ``p`` (the correction)."""
    steps = steps_of(bits, levels)
    return docs.withColumn("codes", quantise("embedding", low, high, steps)).withColumn("p", correction("embedding", low, high, steps))


def estimated_distance(low: float, high: float, steps: float, codes: Column, p: Column, qcodes: Column, qp: Column) -> Column:
    inverse = (high - low) / steps
    return F.lit(1.0) - (p + qp + F.lit(inverse * inverse) * int_dot(codes, qcodes))


def search(docs: DataFrame, queries: DataFrame, k: int, low: float, high: float, bits: int) -> DataFrame:
    """(qid, rank, vec_id, dist) of the ``k`` nearest by quantised products. ``docs``: vec_id, codes, p.

    Blocks of queries against all rows; each partition keeps its own top k."""
    steps = steps_of(bits)
    unit = ((high - low) / steps) ** 2
    q = quantised(queries, low, high, bits).select("qid", "codes", "p")
    if (n := q.count()) > 100_000:
        raise ValueError(f"{n} queries; search blocks of at most 100000")
    rows = q.orderBy("qid").collect()
    qids, qp = np.array([r["qid"] for r in rows], np.int64), np.array([r["p"] for r in rows])
    codes = np.array([r["codes"] for r in rows], np.float64)
    from quiverdf.operators.knn import _best

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in qids]
        for b in batches:
            if len(b):
                ids = b["vec_id"].to_numpy(np.int64)
                products = codes @ np.stack(b["codes"].to_list()).astype(np.float64).T  # whole numbers below 2^53: exact
                dist = 1 - (b["p"].to_numpy()[None, :] + qp[:, None] + unit * products)
                best = [_best(np.concatenate([d, dist[i]]), np.concatenate([v, ids]), k) for i, (d, v) in enumerate(best)]
        sizes = [len(d) for d, _ in best]
        yield pd.DataFrame({"qid": np.repeat(qids, sizes), "vec_id": np.concatenate([v for _, v in best] or [[]]), "dist": np.concatenate([d for d, _ in best] or [[]])})

    found = docs.select("vec_id", "codes", "p").mapInPandas(scan, "qid long, vec_id long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


def expansion_recall(ranked: DataFrame, exact: DataFrame, k: int, more: tuple[int, ...] = (0, 10, 20, 30, 40, 90)) -> DataFrame:
    """(a, recall): mean share of the ``k`` exact neighbours among the first k + a, for each a, from one ranking."""
    truth = exact.where(F.col("rank") <= k).select("qid", "vec_id")
    hit = truth.join(ranked.select("qid", "vec_id", F.col("rank").alias("r")), ["qid", "vec_id"], "left")
    each = hit.select("qid", F.explode(F.array(*map(F.lit, more))).alias("a"), "r")
    per = each.groupBy("qid", "a").agg(F.avg(F.coalesce((F.col("r") <= F.col("a") + k).cast("double"), F.lit(0.0))).alias("x"))
    return per.groupBy("a").agg(F.avg("x").alias("recall"))


# --- intervals -----------------------------------------------------------------------------------------------


def central_interval(docs: DataFrame, ci: float, sample: int | None = SAMPLE, seed: int = 0) -> tuple[float, float]:
    """Order statistics of all components at n (1 -+ ci) / 2, over a sample of documents (all if None)."""
    rows = docs if sample is None else reservoir(docs, sample, seed)
    values = rows.select(F.explode(doubles("embedding")).alias("x"))
    n = values.count()
    at = sorted({min(n - 1, max(0, int(n * (1 - ci) / 2 + 0.5))), min(n - 1, max(0, int(n * (1 + ci) / 2 + 0.5)))})
    # Exact and with bounded state: percentile counts equal values, then interpolates between whole places.
    got = values.agg(F.percentile("x", F.array(*[F.lit(a / max(1, n - 1)) for a in at]))).first()[0]
    return float(got[0]), float(got[-1])


def interpolated_interval(docs: DataFrame, ci: float) -> DataFrame:
    """(lo, hi): interpolated quantiles at (1 -+ ci) / 2 of all components."""
    values = docs.select(F.explode(doubles("embedding")).alias("x"))
    q = values.agg(F.percentile("x", F.array(F.lit(0.5 * (1 - ci)), F.lit(0.5 * (1 + ci)))).alias("q"))
    return q.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def candidate_box(docs: DataFrame, bits: int, sample: int | None = SAMPLE) -> tuple[tuple[float, float], tuple[float, float]]:
    """((low from, low to), (high from, high to)) to look for an interval in."""
    d = len(docs.select("embedding").first()[0])
    wide, narrow = (0.8, 0.2) if bits == 1 else (1 - 1 / (d + 1), 1 - min(32, d / 10) / (d + 1))
    (a, b), (c, e) = central_interval(docs, wide, sample), central_interval(docs, narrow, sample)
    return (a, c), (e, b)


def maximise(f, probes: int, x_range: tuple[float, float], y_range: tuple[float, float], rng: np.random.Generator) -> tuple[float, float, float]:
    """(x, y, value) of the best of ``probes`` evaluations of ``f`` over a box.

    A quarter are random; each further one goes where the upper bound, from a running estimate of how fast
    the function changes, is highest among the box's centre and a grid of random lines."""
    grid = [np.sort(rng.uniform(*r, 2 * probes))[::2] for r in (x_range, y_range)]
    points = np.array([(sum(x_range) / 2, sum(y_range) / 2), *((x, y) for x in grid[0] for y in grid[1])])
    open_, seen, values, steep = np.ones(len(points), bool), [], [], 0.0
    order = rng.permutation(len(points))
    for i in range(min(probes, len(points))):
        if i < max(1, probes // 4):
            at = int(order[i])
        else:
            far = np.linalg.norm(points[:, None, :] - points[seen][None, :, :], axis=2)
            bound = (np.array(values)[None, :] + steep * far).min(1)
            at = int(np.where(open_, bound, -np.inf).argmax())
        value = f(*points[at])
        for j, v in zip(seen, values, strict=True):
            gap = np.linalg.norm(points[at] - points[j])
            if gap > 0:
                steep = max(steep, abs(value - v) / gap)
        open_[at] = False
        seen.append(at)
        values.append(value)
    best = int(np.argmax(values))
    return (*map(float, points[seen[best]]), float(values[best]))


def calibrated_interval(docs: DataFrame, bits: int, sample: int = 1_000, k: int = 10, coarse: int = 32, fine: int = 16, seed: int = 0) -> tuple[float, float, float]:
    """(low, high, score): the interval whose estimated products with near neighbours vary least from the exact.

    Scores of candidate intervals are computed over a bounded sample, on the driver."""
    few = reservoir(docs, sample, seed)
    near = knn(few, few.withColumnRenamed("vec_id", "qid"), k, "dot", exclude_self=True)
    rows = {r["vec_id"]: np.array(r["v"]) for r in few.select("vec_id", doubles("embedding").alias("v")).collect()}
    pairs: dict[int, list[int]] = {}
    for r in near.collect():  # sample x k rows
        pairs.setdefault(r["qid"], []).append(r["vec_id"])
    pairs = {q: v for q, v in pairs.items() if len(v) >= 2}
    ids = list(rows)
    x = np.array([rows[i] for i in ids])
    at = {v: i for i, v in enumerate(ids)}
    left = np.array([at[q] for q in pairs for _ in pairs[q]])
    right = np.array([at[v] for q in pairs for v in pairs[q]])
    owner = np.repeat(np.arange(len(pairs)), [len(v) for v in pairs.values()])
    exact = (x[left] * x[right]).sum(1)
    steps = steps_of(bits)

    def variance(y: np.ndarray) -> np.ndarray:
        n = np.bincount(owner)
        mean = np.bincount(owner, y) / n
        return np.bincount(owner, (y - mean[owner]) ** 2) / (n - 1)

    def score(low: float, high: float) -> float:
        if high <= low:
            return -1e9
        s = steps / (high - low)
        q = np.floor(s * (np.clip(x, low, high) - low) + 0.5)
        d = q / s
        p = (low * (x - low / 2) + ((x - low) - d) * d).sum(1)
        estimate = p[left] + p[right] + (q[left] * q[right]).sum(1) / s**2
        spread = variance(exact)
        return float(np.mean(1 - variance(estimate - exact)[spread > 0] / spread[spread > 0])) if (spread > 0).any() else 0.0

    xr, yr = candidate_box(docs, bits)
    rng = np.random.default_rng(seed)
    best = maximise(score, coarse, xr, yr, rng)
    dx, dy = (xr[1] - xr[0]) / 12, (yr[1] - yr[0]) / 12
    better = maximise(score, fine, (best[0] - dx, best[0] + dx), (best[1] - dy, best[1] + dy), rng)
    return max(best, better, key=lambda b: b[2])


# --- channels and segments -----------------------------------------------------------------------------------


def channels(means: list[float], n: int = 3, iterations: int = 50) -> list[int]:
    """A channel for each component: one-dimensional k-means of the components' means, from their quantiles."""
    m = np.array(means)
    c = np.quantile(m, (np.arange(n) + 0.5) / n)
    at = np.zeros(len(m), int)
    for _ in range(iterations):
        at = np.abs(m[:, None] - c[None, :]).argmin(1)
        c = np.array([m[at == i].mean() if (at == i).any() else c[i] for i in range(n)])
    return at.tolist()


def channel_quantised(docs: DataFrame, channel: list[int], ci: float, levels: int = 16) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """(docs with ``codes`` in component order, intervals): each channel has an interval of its own."""
    spread = docs.select(F.posexplode(doubles("embedding")).alias("pos", "x"))
    of = F.element_at(F.array(*map(F.lit, channel)), F.col("pos") + 1)
    q = F.percentile("x", F.array(F.lit(0.5 * (1 - ci)), F.lit(0.5 * (1 + ci)))).alias("q")
    spans = {r["c"]: (r["q"][0], r["q"][1]) for r in spread.withColumn("c", of).groupBy("c").agg(q).collect()}  # a row a channel
    low = F.array(*[F.lit(float(spans[c][0])) for c in channel])
    high = F.array(*[F.lit(float(spans[c][1])) for c in channel])
    triple = F.arrays_zip(doubles("embedding").alias("x"), low.alias("l"), high.alias("h"))
    code = F.transform(triple, lambda t: F.round(F.when(t["h"] > t["l"], levels / (t["h"] - t["l"])).otherwise(0.0) * (_in(t["x"], t["l"], t["h"]) - t["l"])).cast("int"))
    return docs.withColumn("codes", code), spans


def channel_dequantised(docs: DataFrame, channel: list[int], spans: dict[int, tuple[float, float]], levels: int = 16) -> DataFrame:
    low = F.array(*[F.lit(float(spans[c][0])) for c in channel])
    width = F.array(*[F.lit(float(spans[c][1] - spans[c][0])) for c in channel])
    triple = F.arrays_zip(F.col("codes").alias("q"), low.alias("l"), width.alias("w"))
    return docs.withColumn("embedding", F.transform(triple, lambda t: t["l"] + t["w"] * t["q"] / F.lit(float(levels))))


def merged_interval(segments: DataFrame) -> DataFrame:
    """(lo, hi): the segments' intervals weighted by their counts. ``segments``: seg_id, n, lo, hi."""
    n = F.col("n").cast("double")
    return segments.agg((F.sum(n * F.col("lo")) / F.sum(n)).alias("lo"), (F.sum(n * F.col("hi")) / F.sum(n)).alias("hi"))


def _moved(low: Column, high: Column) -> Column:
    return F.greatest(F.abs(low - F.col("lo")), F.abs(high - F.col("hi")))


def must_recompute(segments: DataFrame, low: float, high: float) -> bool:
    """Whether any segment's interval is further than a 32nd of the merged width from the merged one."""
    tolerance = (high - low) / 32
    return bool(segments.agg(F.bool_or(_moved(F.lit(low), F.lit(high)) > tolerance)).first()[0])


def to_requantise(segments: DataFrame, low: float, high: float, levels: float = 256.0) -> DataFrame:
    """The segments whose own interval is further from the merged one than a fifth of their own step."""
    return segments.where(_moved(F.lit(low), F.lit(high)) > 0.2 * (F.col("hi") - F.col("lo")) / levels)


def recomputed_interval(codes: DataFrame, segments: DataFrame, ci: float, levels: float = 256.0, sample: int = SAMPLE, seed: int = 0) -> tuple[float, float]:
    """The interval of a sample of all segments, in proportion to their sizes. ``codes``: seg_id, vec_id, codes."""
    n = codes.count()
    some = codes.where(place("vec_id", seed) < int(min(1.0, sample / max(1, n)) * RANGE)) if n > sample else codes
    values = some.join(F.broadcast(segments.select("seg_id", "lo", "hi")), "seg_id").select(  # a row a segment
        F.explode(dequantise("codes", F.col("lo"), F.col("hi"), levels)).alias("x")
    )
    q = values.agg(F.percentile("x", F.array(F.lit(0.5 * (1 - ci)), F.lit(0.5 * (1 + ci))))).first()[0]
    return float(q[0]), float(q[1])


def merge_segments(codes: DataFrame, segments: DataFrame, ci: float = 0.99, levels: float = 256.0) -> tuple[DataFrame, tuple[float, float], float]:
    """(codes under one interval, that interval, share of vectors quantised again)."""
    low, high = merged_interval(segments).first()
    if must_recompute(segments, low, high):
        low, high = recomputed_interval(codes, segments, ci, levels)
    again = to_requantise(segments, low, high, levels).select("seg_id", F.lit(True).alias("again"))
    table = segments.select("seg_id", "n", "lo", "hi").join(again, "seg_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    share = table.agg(F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
    new = quantise(dequantise("codes", F.col("lo"), F.col("hi"), levels), low, high, levels)
    out = codes.join(F.broadcast(table), "seg_id").select("seg_id", "vec_id", F.when(F.col("again"), new).otherwise(F.col("codes")).alias("codes"))  # a row a segment
    return out, (low, high), float(share or 0.0)
