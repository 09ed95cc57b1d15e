"""Optimised scalar quantisation: an interval for each vector, fitted to the error that matters for products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverdf.functions.codes import int_dot
from quiverdf.functions.vectors import doubles, moments, total

#: Half-widths, in standard deviations, of the best uniform quantiser of a normal variable with 1 to 8 bits: fixed values.
SPREAD = (0.798, 1.493, 2.051, 2.514, 2.916, 3.278, 3.611, 3.922)
#: Weight of the error at right angles to the vector; steps at most; least move.
LAMBDA, STEPS, LEAST_MOVE = 0.1, 5, 1e-8


def initial_interval(v: Column | str, bits: int, low: float, high: float) -> Column:
    """Struct (lo, hi): mean -+ so many deviations, within the components' overall range."""
    m = moments(v)
    half = F.lit(SPREAD[bits - 1]) * F.sqrt(m["variance"])
    within = lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    return F.struct(within(m["mean"] - half).alias("lo"), within(m["mean"] + half).alias("hi"))


def starts(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = x.mean(1), x.std(1)
    return (np.clip(mean + s * SPREAD[bits - 1] * sd, x.min(), x.max()) for s in (-1, 1))


def codes_of(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    width = np.where(hi > lo, hi - lo, 1.0)[:, None]
    q = np.floor((2**bits - 1) * (np.clip(x, lo[:, None], hi[:, None]) - lo[:, None]) / width + 0.5)
    return np.where((hi > lo)[:, None], q, 0).astype(np.int32)


def decoded(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    return lo[:, None] + (hi - lo)[:, None] * q / (2**bits - 1)


def loss(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int, lam: float = LAMBDA) -> np.ndarray:
    """(1 - lambda) (x . e)^2 / |x|^2 + lambda |e|^2 of the error e of each row."""
    e = x - decoded(codes_of(x, lo, hi, bits), lo, hi, bits)
    norm = np.maximum((x * x).sum(1), 1e-300)
    return (1 - lam) * (x * e).sum(1) ** 2 / norm + lam * (e * e).sum(1)


def one_step(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int, lam: float = LAMBDA) -> tuple[np.ndarray, np.ndarray]:
    """The ends that are best for the present codes: a system of two equations for each row."""
    s = codes_of(x, lo, hi, bits) / (2**bits - 1)
    r = 1 - s
    aa, ab, bb = (r * r).sum(1), (r * s).sum(1), (s * s).sum(1)
    ax, bx = (x * r).sum(1), (x * s).sum(1)
    g = (1 - lam) / np.maximum((x * x).sum(1), 1e-300)
    m11, m12, m22 = g * ax * ax + lam * aa, g * ax * bx + lam * ab, g * bx * bx + lam * bb
    det = m11 * m22 - m12 * m12
    ok = np.abs(det) > 1e-30
    safe = np.where(ok, det, 1.0)
    return np.where(ok, (m22 * ax - m12 * bx) / safe, lo), np.where(ok, (m11 * bx - m12 * ax) / safe, hi)


def optimised(x: np.ndarray, bits: int, lam: float = LAMBDA, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of each row: steps until one does not help (and is taken back) or hardly moves."""
    lo, hi = starts(x, bits)
    now, active = loss(x, lo, hi, bits, lam), np.ones(len(x), bool)
    for _ in range(steps):
        a, b = one_step(x, lo, hi, bits, lam)
        new = loss(x, a, b, bits, lam)
        better = active & (new <= now) & (a < b)
        moved = np.maximum(np.abs(a - lo), np.abs(b - hi))
        lo, hi, now = np.where(better, a, lo), np.where(better, b, hi), np.where(better, new, now)
        active = better & (moved >= LEAST_MOVE)
        if not active.any():
            break
    return lo, hi


def optimised_with_codes(x: np.ndarray, bits: int, lam: float = LAMBDA, rounds: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, codes): interval steps in turn with moving each code up or down by one where the loss falls."""
    lo, hi = optimised(x, bits, lam)
    q = codes_of(x, lo, hi, bits).astype(np.float64)
    norm = np.maximum((x * x).sum(1), 1e-300)
    step = (hi - lo) / (2**bits - 1)
    for _ in range(rounds):
        e = x - (lo[:, None] + step[:, None] * q)
        along, changed = (x * e).sum(1), False
        for j in range(x.shape[1]):
            best = np.zeros(len(x))
            for move in (-1.0, 1.0):
                d = -step * move  # change of the error in component j
                fits = (q[:, j] + move >= 0) & (q[:, j] + move < 2**bits)
                gain = (1 - lam) * ((along + x[:, j] * d) ** 2 - along**2) / norm + lam * ((e[:, j] + d) ** 2 - e[:, j] ** 2)
                take = fits & (gain < -1e-12) & (best == 0)
                best = np.where(take, move, best)
            q[:, j] += best
            along += x[:, j] * -step * best
            e[:, j] -= step * best
            changed |= bool(best.any())
        if not changed:
            break
    return lo, hi, q.astype(np.int32)


def quantise_docs(docs: DataFrame, bits: int, lam: float = LAMBDA) -> DataFrame:
    """``vec_id, lo, hi, codes, l1`` of every vector; the range that starts are clamped to is each batch's own."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_list())
                lo, hi = optimised(x, bits, lam)
                q = codes_of(x, lo, hi, bits)
                yield pd.DataFrame({"vec_id": b["vec_id"], "lo": lo, "hi": hi, "codes": list(q), "l1": q.sum(1).astype(np.int64)})

    return docs.select("vec_id", doubles("embedding").alias("embedding")).mapInPandas(scan, "vec_id long, lo double, hi double, codes array<int>, l1 long")


def quantise(v: Column | str, lo: Column, hi: Column, bits: int) -> Column:
    """Codes under the row's own interval."""
    from quiverdf.operators.scalar_quant import quantise as q

    return q(v, lo, hi, float(2**bits - 1))


def dequantise(codes: Column, lo: Column, hi: Column, bits: int) -> Column:
    return F.transform(codes, lambda c: lo + (hi - lo) * c / F.lit(float(2**bits - 1)))


def squared_error(v: Column | str, codes: Column, lo: Column, hi: Column, bits: int) -> Column:
    return total(F.zip_with(doubles(v), dequantise(codes, lo, hi, bits), lambda a, b: (a - b) * (a - b)))


def estimated_dot(dim: int, x: dict[str, Column], y: dict[str, Column], bits_x: int, bits_y: int) -> Column:
    """Product of two quantised vectors (lo, hi, codes, l1 each) from their codes alone."""
    sx = (x["hi"] - x["lo"]) / F.lit(float(2**bits_x - 1))
    sy = (y["hi"] - y["lo"]) / F.lit(float(2**bits_y - 1))
    return F.lit(float(dim)) * x["lo"] * y["lo"] + y["lo"] * sx * x["l1"] + x["lo"] * sy * y["l1"] + sx * sy * int_dot(x["codes"], y["codes"])


# --- preconditioning -----------------------------------------------------------------------------------------


def random_orthogonal(dim: int, block: int = 32, seed: int = 215_873_873) -> list[np.ndarray]:
    """Random orthogonal blocks along the diagonal; the last may be smaller."""
    rng = np.random.default_rng(seed)
    sizes = [min(block, dim - i) for i in range(0, dim, block)]
    return [np.linalg.qr(rng.standard_normal((n, n)))[0] for n in sizes]


def balancing_permutation(variances: np.ndarray, block: int = 32) -> np.ndarray:
    """The components' order in which blocks have near equal variance: each, largest first, goes to the block
    with the least variance that has room."""
    d = len(variances)
    sizes = [min(block, d - i) for i in range(0, d, block)]
    held, blocks = np.zeros(len(sizes)), [[] for _ in sizes]
    for j in np.argsort(-variances, kind="stable"):
        open_ = [b for b in range(len(sizes)) if len(blocks[b]) < sizes[b]]
        b = min(open_, key=lambda b: (held[b], b))
        blocks[b].append(int(j))
        held[b] += variances[j]
    return np.array([j for b in blocks for j in b])


def precondition(docs: DataFrame, order: np.ndarray, blocks: list[np.ndarray]) -> DataFrame:
    """Vectors with their components permuted and each block rotated: products and distances stay the same."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, at, out = np.stack(b["embedding"].to_list())[:, order], 0, []
                for m in blocks:
                    out.append(x[:, at : at + len(m)] @ m.T)
                    at += len(m)
                yield b.assign(embedding=list(np.concatenate(out, axis=1)))

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("embedding", doubles("embedding")).mapInPandas(turn, schema)
