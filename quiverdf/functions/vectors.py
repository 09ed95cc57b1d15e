"""Functions of vector columns, as array expressions that stay in the JVM.

Sums run over a vector's components in order and in double precision, so results do not depend on how rows are
partitioned. A null vector gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("dot", "cosine", "euclidean")


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(vector) -> Column:
    """A vector known to the driver, as a column."""
    return F.array(*[F.lit(float(x)) for x in vector])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def squared_norm(v: Column | str) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def l1_norm(v: Column | str) -> Column:
    """Sum of the (non-negative) components of a code vector."""
    return F.aggregate((F.col(v) if isinstance(v, str) else v).cast("array<bigint>"), F.lit(0).cast("bigint"), lambda s, x: s + x)


def scale(v: Column | str, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def normalise(v: Column | str) -> Column:
    """The vector divided by its length; null where that is 0."""
    norm = F.sqrt(squared_norm(v))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def soar_distance(x: Column | str, centre: Column | str, residual: Column | str, weight: float = 1.0) -> Column:
    """Squared distance to a second centre, plus ``weight`` times the square of the new residual's part along
    the old one: small where the new residual is near right angles to the old. A residual of 0 has no direction."""
    new = minus(x, centre)
    along, norm = dot(residual, new), squared_norm(residual)
    return squared_norm(new) + F.when(norm > 0, weight * along * along / norm).otherwise(0.0)


def zero_pad(v: Column | str, multiple: int) -> Column:
    """Zeros appended up to the next multiple of ``multiple`` components."""
    col = doubles(v)
    return F.concat(col, F.array_repeat(F.lit(0.0), F.pmod(-F.size(col), F.lit(multiple))))


def matrix_vector(rows: Column, v: Column | str) -> Column:
    """Product of a matrix (array of rows) and a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def binarise(v: Column | str) -> Column:
    return F.transform(doubles(v), lambda x: (x > 0).cast("int"))


def pick(v: Column | str, dims: list[int]) -> Column:
    """The components with the given 0-based numbers."""
    col = doubles(v)
    return F.array(*[F.element_at(col, i + 1) for i in dims])


def moments(v: Column | str) -> Column:
    """Struct of a vector's own mean, population variance, least and largest component."""
    col = doubles(v)
    mean = total(col) / F.size(col)
    return F.struct(
        mean.alias("mean"),
        (total(F.transform(col, lambda x: (x - mean) * (x - mean))) / F.size(col)).alias("variance"),
        F.array_min(col).alias("low"),
        F.array_max(col).alias("high"),
    )


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """1 - dot for ``dot`` and (over vectors that are normalised first) ``cosine``; else the squared distance."""
    if metric == "euclidean":
        return squared_distance(a, b)
    if metric == "cosine":
        return F.lit(1.0) - dot(normalise(a), normalise(b))
    if metric == "dot":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def engine_score(metric: str, a: Column | str, b: Column | str) -> Column:
    """The score that search engines give: larger is nearer, always positive."""
    if metric == "euclidean":
        return F.lit(1.0) / (F.lit(1.0) + squared_distance(a, b))
    if metric == "cosine":
        return F.lit(0.5) + F.lit(0.5) * dot(normalise(a), normalise(b))
    if metric == "mip":
        s = dot(a, b)
        return F.when(s < 0, F.lit(1.0) / (F.lit(1.0) - s)).otherwise(s + 1.0)
    raise ValueError(f"unknown metric {metric!r}")


def approx_exp2(x: Column) -> Column:
    """2 to the power x, linear between whole numbers."""
    return F.pow(F.lit(2.0), F.floor(x)) * (F.lit(1.0) + x - F.floor(x))


def approx_log2(x: Column) -> Column:
    """Logarithm to base 2, linear between powers of 2."""
    whole = F.floor(F.log2(x))
    return whole - 1 + x / F.pow(F.lit(2.0), whole)


def component_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, n, mean, var_samp, var_pop) of each component over all rows."""
    return (
        df.select(F.posexplode(doubles(vector)).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var_samp"), F.var_pop("x").alias("var_pop"))
    )


def mean_vector(df: DataFrame, vector: str = "embedding") -> list[float]:
    """The mean of all rows: one number for each component."""
    return [r["mean"] for r in sorted(component_stats(df, vector).collect(), key=lambda r: r["pos"])]


def covariance(df: DataFrame, vector: str = "embedding") -> tuple:
    """(mean, population covariance) as NumPy arrays, from one sum of outer products a partition."""
    import numpy as np
    import pandas as pd

    def sums(batches):
        n, s, ss = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_list()).astype(np.float64)
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    parts = df.select(doubles(vector).alias("v")).mapInPandas(sums, "n long, s array<double>, ss array<double>")
    # Summed in a tree of tasks by component; what reaches the driver is d + d * d numbers.
    rows = (
        parts.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    )
    if not rows:
        raise ValueError("no vectors")
    x = np.array([r["x"] for r in sorted(rows, key=lambda r: r["i"])])
    n, d = rows[0]["n"], int((np.sqrt(1 + 4 * len(x)) - 1) // 2)
    mean = x[:d] / n
    return mean, x[d:].reshape(d, d) / n - np.outer(mean, mean)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of what the driver holds (centres, intervals), to be broadcast."""
    return spark.createDataFrame(rows, schema)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
