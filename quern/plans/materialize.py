"""Cutting a plan by a table in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def drop_later(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files, which outlive any executor. The files go when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_later(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Steps of a plan after which a task that is run again may meet its rows in another order.
MOVES = re.compile(r"(?m)^[\s:+-]*(Aggregate|Join|Repartition\w*|RebalancePartitions|Sort|Window|Distinct|Deduplicate|Except|Intersect|GlobalLimit|Sample)\b")


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if its rows come straight from files, so that their places are the same whenever a task is run; else written and read back."""
    return materialize(df, name) if MOVES.search(df._jdf.queryExecution().optimizedPlan().toString()) else df


def broadcast_if_small(df: DataFrame, max_rows: int):
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted, reading no more than needed), else as it is."""
    from pyspark.sql import functions as F

    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
