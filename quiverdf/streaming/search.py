"""Nearest neighbours for a stream of queries.

Every micro-batch of queries is searched as a table would be, so a stream keeps no state of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiverdf.operators.knn import knn


def search_stream(queries: DataFrame, docs: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "dot", once: bool = False) -> StreamingQuery:
    """Search ``docs`` for each micro-batch of the streaming ``queries`` (qid, embedding).

    ``sink`` gets (qid, rank, vec_id, dist) and the batch's number; it must be idempotent by that number, as a
    batch may come again after a failure. With ``once`` the stream ends when it has caught up."""

    def batch(part: DataFrame, number: int) -> None:
        sink(knn(docs, part, k, metric), number)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
