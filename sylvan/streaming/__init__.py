"""Patterns over streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sylvan.api import run
from sylvan.lang.analysis import Query


def run_stream(docs: DataFrame, trees: Callable[[DataFrame], DataFrame], query: Query | str, sink: Callable[[DataFrame, int], None], checkpoint: str, entry: str | None = None) -> StreamingQuery:
    """Runs a query over each micro-batch of a stream of documents and hands its results to ``sink`` with the batch's number.

    A document must be whole in one row, since trees do not span rows; so no state is kept between batches.
    """
    return docs.writeStream.foreachBatch(lambda batch, n: sink(run(trees(batch), query, entry), n)).option("checkpointLocation", checkpoint).start()
