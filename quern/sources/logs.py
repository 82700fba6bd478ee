"""CSV sources of logs and results, with declared columns and checked headers, and the result sink."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions.labels import as_float

SPAN_COLUMNS = {"ThreadID": "thread_id", "CallerID": "caller_id", "StartNanos": "start_nanos", "EndNanos": "end_nanos"}
CACHE_COLUMNS = {"Timestamp": "timestamp_ns", "ScheduledEvictionSize": "scheduled_eviction_size", "CacheSize": "cache_size"}
CACHE_OPTIONAL = {"PinnedSize": "pinned_size", "ReadReservedSize": "read_reserved_size"}


class BadLog(ValueError):
    """A log is missing, empty, or lacks columns."""


def _csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """All columns as text (types are cast by name afterwards), or None if there is nothing to read."""
    try:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if not raw.columns:
        return None
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise BadLog(f"{path}: missing columns {', '.join(missing)}")
    return raw


def _or_nothing(df: DataFrame | None, spark: SparkSession, path: str, schema: str, allow_empty: bool) -> DataFrame:
    if df is None or df.isEmpty():
        if not allow_empty:
            raise BadLog(f"{path} has no rows")
        warnings.warn(f"{path} has no rows; skipped", stacklevel=3)
        return spark.createDataFrame([], schema)
    return df


def read_spans(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """A span log: ``thread_id, caller_id, start_nanos, end_nanos``. Columns that aren't known are ignored, an empty caller is an empty text; a number that can't be read is an error at run time."""
    raw = _csv(spark, path, list(SPAN_COLUMNS))
    df = None if raw is None else raw.select(F.col("ThreadID").cast("int").alias("thread_id"), F.coalesce("CallerID", F.lit("")).alias("caller_id"), F.col("StartNanos").cast("long").alias("start_nanos"), F.col("EndNanos").cast("long").alias("end_nanos"))
    return _or_nothing(df, spark, path, "thread_id int, caller_id string, start_nanos long, end_nanos long", allow_empty)


def read_cache_samples(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Cache samples; the last two columns may be missing or empty and are then 0."""
    raw = _csv(spark, path, list(CACHE_COLUMNS))
    df = None
    if raw is not None:
        optional = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(n) if c in raw.columns else F.lit(0).cast("long").alias(n) for c, n in CACHE_OPTIONAL.items()]
        df = raw.select(*(F.col(c).cast("long").alias(n) for c, n in CACHE_COLUMNS.items()), *optional)
    fields = ", ".join(f"{n} long" for n in [*CACHE_COLUMNS.values(), *CACHE_OPTIONAL.values()])
    return _or_nothing(df, spark, path, fields, allow_empty)


def read_limits(spark: SparkSession, path: str) -> tuple[int | None, int | None]:
    """The soft (eviction) and hard limit of the first row of a run's settings; (None, None) if they can't be read."""
    try:
        raw = _csv(spark, path, ["CacheHardLimit", "CacheEvictionLimit"])
        row = raw.select(F.col("CacheEvictionLimit").try_cast("long").alias("soft"), F.col("CacheHardLimit").try_cast("long").alias("hard")).first() if raw is not None else None
    except (BadLog, AnalysisException):
        return None, None
    return (row["soft"], row["hard"]) if row and row["soft"] is not None and row["hard"] is not None else (None, None)


def read_results(spark: SparkSession, path: str, reps: int = 3) -> DataFrame:
    """``mode, conf, rep1..``: empty, ``nan`` and missing repetitions are NaN; rows may be shorter than the header."""
    raw = _csv(spark, path, ["mode", "conf", "rep1"])
    if raw is None:
        raise BadLog(f"{path} has no rows")
    cells = [as_float(F.col(f"rep{i}")).alias(f"rep{i}") if f"rep{i}" in raw.columns else F.lit(float("nan")).alias(f"rep{i}") for i in range(1, reps + 1)]
    return raw.select("mode", "conf", *cells)


def read_scheduling(spark: SparkSession, path: str) -> DataFrame:
    """``setup, exec_mode, runtime_s``."""
    raw = _csv(spark, path, ["Setup", "ExecMode", "Runtime [s]"])
    df = None if raw is None else raw.select(F.col("Setup").alias("setup"), F.col("ExecMode").alias("exec_mode"), F.col("`Runtime [s]`").cast("double").alias("runtime_s"))
    return _or_nothing(df, spark, path, "setup string, exec_mode string, runtime_s double", False)


def append_results(df: DataFrame, path: str) -> None:
    """Add rows to a result folder, a header in each file; NaN is written as ``nan``."""
    df.write.mode("append").option("header", True).option("nanValue", "nan").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
