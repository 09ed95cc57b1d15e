"""The fvec format: each row is its dimension (int32) and as many float32; or, headerless, float32 alone.

``read_fvecs`` takes any path that Spark reads, a file to a task (2 GB at most). ``FvecDataSource`` reads byte
ranges of whole rows, so one large file is read by many tasks, and writes a part file for each task; it opens
files itself, so its paths must be on a disk that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range that one task reads.
RANGE = 64 * 1024 * 1024


def parse(data: bytes, dim: int | None = None) -> np.ndarray:
    """Rows of the bytes of a file; with ``dim`` there are no headers. A partial row or an odd header is an error."""
    if not data:
        return np.empty((0, dim or 0), np.float32)
    if dim is None:
        dim = int(np.frombuffer(data[:4], "<i4")[0])
        if dim <= 0 or len(data) % (4 * (dim + 1)):
            raise ValueError(f"not rows of {dim} components")
        rows = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
        if (rows[:, 0] != dim).any():
            raise ValueError("rows differ in dimension")
        return rows[:, 1:].view("<f4")
    if len(data) % (4 * dim):
        raise ValueError(f"not rows of {dim} components")
    return np.frombuffer(data, "<f4").reshape(-1, dim)


def to_bytes(x: np.ndarray, header: bool = True) -> bytes:
    x = np.ascontiguousarray(x, "<f4")
    if not header:
        return x.tobytes()
    return np.concatenate([np.full((len(x), 1), x.shape[1], "<i4"), x.view("<i4")], axis=1).tobytes()


def read_fvecs(spark: SparkSession, *paths: str, dim: int | None = None, sample: int | None = None) -> DataFrame:
    """(vec_id, embedding) of one or more files, ids running on from file to file in the order given."""
    out, first = None, 0
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select("path", "content")

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for content in b["content"]:
                    x = parse(content, dim)
                    for at in range(0, len(x), 8_192):
                        part = x[at : at + 8_192]
                        yield pd.DataFrame({"vec_id": np.arange(at, at + len(part)), "embedding": list(part)})

        one = files.mapInPandas(rows, "vec_id long, embedding array<float>")
        part = one.withColumn("vec_id", F.col("vec_id") + first)
        first += one.count() if len(paths) > 1 else 0
        out = part if out is None else out.unionByName(part)
    return out if sample is None else out.where(F.col("vec_id") < sample)


def write_fvecs(df: DataFrame, path: str) -> int:
    """Write vectors in the order of their ids, a part file a task; the bytes written."""
    df.sparkSession.dataSource.register(FvecDataSource)
    ordered = df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).orderBy("vec_id")
    ordered.write.format("fvec").mode("append").save(path)
    rows = ordered.agg(F.sum(4 * (F.size("embedding") + 1))).first()[0]
    return int(rows or 0)


class Span(InputPartition):
    def __init__(self, path: str, first: int, start: int, rows: int):
        self.path, self.first, self.start, self.rows = path, first, start, rows


class FvecDataSource(DataSource):
    """``spark.read.format("fvec").load(path)``; options: ``dim`` (headerless), ``range`` (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "fvec"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return FvecReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FvecWriter(self.options)


class FvecReader(DataSourceReader):
    """Ranges of rows of shared files, in the order of the files' names."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")
        self.dim = int(options["dim"]) if "dim" in options else None
        self.range = int(options.get("range", RANGE))

    def _files(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        return [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith(".fvec")]

    def partitions(self):
        spans, first = [], 0
        for f in self._files():
            size = os.path.getsize(f)
            if not size:
                continue
            with open(f, "rb") as file:
                dim = self.dim or int(np.frombuffer(file.read(4), "<i4")[0])
            width = 4 * (dim + (self.dim is None))
            if size % width:
                raise ValueError(f"{f}: not rows of {dim} components")
            n, step = size // width, max(1, self.range // width)
            spans += [Span(f, first + at, at * width, min(step, n - at)) for at in range(0, n, step)]
            first += n
        return spans or [Span("", 0, 0, 0)]

    def read(self, partition):
        if not partition.rows:
            return
        with open(partition.path, "rb") as file:
            dim = self.dim or int(np.frombuffer(file.read(4), "<i4")[0])
            file.seek(partition.start)
            x = parse(file.read(partition.rows * 4 * (dim + (self.dim is None))), self.dim)
        for i, row in enumerate(x):
            yield partition.first + i, row.tolist()


class Written(WriterCommitMessage):
    def __init__(self, part: str, size: int):
        self.part, self.size = part, size


class FvecWriter(DataSourceWriter):
    """A file for each task, named by partition; parts of tasks that fail are removed."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}.fvec")
        size, held = 0, []
        with open(part, "wb") as file:
            for r in rows:
                held.append(r["embedding"])
                if len(held) == 4_096:
                    size += file.write(to_bytes(np.array(held)))
                    held = []
            if held:
                size += file.write(to_bytes(np.array(held)))
        return Written(part, size)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.remove(m.part)
