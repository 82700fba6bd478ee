"""Mergeable states of span logs kept up to date from a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.llm.percentiles import merge_states, value_counts


def follow_durations(spans: DataFrame, states: str, checkpoint: str, bits: int = 8, once: bool = True) -> StreamingQuery:
    """Append each batch's duration states (``caller_id, value, n``) to the folder ``states``, under its batch number, so that a batch run twice counts once."""

    def add(batch: DataFrame, number: int) -> None:
        well = batch.filter("end_nanos > start_nanos")
        value_counts(well, ["caller_id"], F.col("end_nanos") - F.col("start_nanos"), bits).write.mode("overwrite").parquet(f"{states}/batch={number}")

    writer = spans.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def followed_states(spark: SparkSession, states: str) -> DataFrame:
    """All batches put together."""
    return merge_states(spark.read.parquet(states), ["caller_id"])
