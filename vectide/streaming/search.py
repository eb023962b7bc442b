"""Searches for a stream of queries against a static base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.knn import knn


def answer(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query that hands the neighbours of each micro-batch of queries(query_id, vector) to ``sink`` with the batch's number.

    A batch is searched like any table of queries, and its number lets the sink make repeats harmless.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(knn(base, batch, k, **options), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
