"""Streams of queries against a fitted index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.index import Model


def search_stream(queries: DataFrame, model: Model, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Answers each micro-batch of a stream (vec_id, embedding) and hands the answers to ``sink`` with the batch's number.

    An index's search has no state between queries, so a replayed batch gives the same answers.
    """
    writer = queries.writeStream.foreachBatch(lambda batch, number: sink(model.search(batch.dropDuplicates(["vec_id"]), k), number))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
