"""Span logs followed as streams of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_SCHEMA = "span_id long, run_id long, thread_id int, caller_id string, start_nanos long, end_nanos long, logged_at timestamp_ntz"


def span_stream(spark: SparkSession, folder: str, schema: str = SPAN_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_totals(spans: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Spans and busy time by caller and window of arrival; rows later than ``late`` are dropped by the watermark."""
    timed = spans.withColumn("at", F.col("logged_at").cast("timestamp")).withWatermark("at", late).filter("end_nanos > start_nanos")
    return timed.groupBy(F.window("at", width), "caller_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_nanos") - F.col("start_nanos")).alias("busy_ns"))
