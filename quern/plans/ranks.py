"""Places in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import materialize


def ranked(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with ``_rank``, the 0-based place of each row; ``order`` must tell all rows apart.

    Rows are range-partitioned, and each partition's places start after the rows of the partitions before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))
    offset = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_local", local).join(F.broadcast(offset), "_part").withColumn("_rank", F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")
