"""Matrices in files: Parquet cells beside a small file with the shape, which cells alone cannot tell."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.operators.matrix import Matrix


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def matrix_exists(spark: SparkSession, path: str) -> bool:
    """Whether the matrix or its shape is there already."""
    return _exists(spark, path) or _exists(spark, f"{path}.mtd")


def write_matrix(m: Matrix, path: str, skip_existing: bool = False) -> bool:
    """Write cells and shape; with ``skip_existing`` a target that is there stays. Whether anything was written."""
    spark = m.df.sparkSession
    if skip_existing and matrix_exists(spark, path):
        return False
    m.df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(m.nrow, m.ncol, m.dense)], "nrow long, ncol long, dense boolean").coalesce(1).write.mode("overwrite").json(f"{path}.mtd")
    return True


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    shape = spark.read.schema("nrow long, ncol long, dense boolean").json(f"{path}.mtd").first()
    cells = spark.read.schema("i long, j long, v double").parquet(path)
    return Matrix(cells.select("i", "j", F.col("v")), shape["nrow"], shape["ncol"], shape["dense"])
