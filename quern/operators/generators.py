"""Generated matrices. Every cell depends on seed and coordinates alone, so a lost task makes the same cells again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.numeric import clamp, floor, hash_normal, hash_uniform, indicator
from quern.operators.matrix import Matrix, grid


def rand(spark: SparkSession, rows: int, cols: int, low: float = 0.0, high: float = 1.0, sparsity: float = 1.0, seed: int = 0, pdf: str = "uniform") -> Matrix:
    """A random matrix; cells are kept with probability ``sparsity``. ``pdf`` is ``uniform`` over [low, high) or ``normal`` (mean 0, deviation 1)."""
    if pdf not in ("uniform", "normal"):
        raise ValueError(f"unknown pdf {pdf}")
    cells = grid(spark, rows, cols)
    value: Column = hash_normal(seed, F.col("i"), F.col("j")) if pdf == "normal" else F.lit(low) + F.lit(high - low) * hash_uniform(seed, F.col("i"), F.col("j"))
    if sparsity < 1:
        cells = cells.filter(hash_uniform(seed + 7919, F.col("j"), F.col("i")) < sparsity)
    return Matrix(cells.select("i", "j", value.alias("v")), rows, cols, dense=sparsity >= 1)


#: Rows that are generated from one seed.
BAND = 1024


def rand_rows(spark: SparkSession, rows: int, cols: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A dense uniform matrix in row layout (``i`` from 1, ``v``), generated by bands of rows: a band's numbers depend on seed and place alone."""
    bands = -(-rows // BAND)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = min(BAND, rows - b * BAND)
                v = low + (high - low) * np.random.default_rng([seed, b]).random((n, cols))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * cols, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + b * BAND + 1), lists], names=["i", "v"])

    parts = min(max(bands // 4, 1), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, bands, 1, parts).mapInArrow(make, "i long, v array<double>")


def blobs(spark: SparkSession, rows: int, cols: int, k: int, sparsity: float, sd: float, seed: int) -> tuple[DataFrame, Matrix, DataFrame]:
    """Points around ``k`` centres: X in row layout (``i, v``), centres C, and labels Y (``i, y``, from 1).

    A label picks its centre by a join with the small table of centres, in place of a product with a one-hot matrix.
    """
    centres = rand(spark, k, cols, seed=seed)
    y = clamp(floor(F.lit(1.0) + F.lit(float(k)) * hash_uniform(seed + 1, F.col("i"))), F.lit(1.0), F.lit(float(k))).cast("int")
    labels = spark.range(1, rows + 1).select(F.col("id").alias("i")).withColumn("y", y)
    table = centres.rows().withColumnRenamed("i", "_k").withColumnRenamed("v", "_c")
    spots = labels.join(F.broadcast(table), F.col("y") == F.col("_k"))  # k rows

    def cell(x: Column, j: Column) -> Column:
        value = x + F.lit(sd) * hash_normal(seed + 2, F.col("i"), j)
        return value * indicator(hash_uniform(seed + 3, F.col("i"), j) <= sparsity) if sparsity < 1 else value

    points = spots.select("i", F.transform("_c", cell).alias("v"))
    return points, centres, labels


def blob_base(rows: int, cols: int, k: int, sparsity: float, sd: float, seed: int, base: str = "") -> str:
    return base or f"data/blobs_{rows}x{cols}k{k}s{sparsity}n{sd}_seed{seed}"
