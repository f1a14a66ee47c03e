"""Counters of a stream of tables: each micro-batch adds its counts, and the latest state answers queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewarden.operators.checks import missing_counts
from tablewarden.operators.profile import from_dataframe
from tablewarden.plans.pipeline import TableResult, score_table


def batch_counts(batch: DataFrame, key: str) -> DataFrame:
    """column_name, missing and total of one micro-batch."""
    table = from_dataframe(batch, "batch", key)
    names = F.array(*map(F.lit, table.names))
    return missing_counts(table).select(F.element_at(names, F.col("col") + 1).alias("column_name"), "missing", "total")


def completeness_stream(stream: DataFrame, key: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch's counts to ``on_batch`` with its number, for an idempotent sink keyed by it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: on_batch(batch_counts(df, key), i)).trigger(availableNow=True).start()


def scorecard_stream(stream: DataFrame, key: str, on_batch: Callable[[TableResult, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Score each micro-batch as a table of its own; one without rows is passed over."""

    def score(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                result = score_table(from_dataframe(batch, f"batch {number}", key), **options)
                on_batch(result, number)
                result.release()
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score).trigger(availableNow=True).start()
