"""Matrices as DataFrames: coordinate layout ``i, j, v`` (1-based) and row layout ``i, v`` (array), with their shape.

Cells that a sparse matrix doesn't list are zero, so aggregates over all cells count them in. Operators that are not zero-safe densify first. Cell-wise programs
should be built from aligned columns: ``aligned`` joins two sources once, and everything after is a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.slices import partitions_of

CHUNK = 65_536


def column_of(spark: SparkSession, first: int, last: int, by: int = 1) -> Matrix:
    """The column vector first, first + by, ... up to last."""
    n = max((last - first) // by + 1, 0)
    rows = spark.range(1, n + 1).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("j"), (F.lit(float(first)) + (F.col("id") - 1) * float(by)).alias("v"))
    return Matrix(rows, n, 1)


def grid(spark: SparkSession, nrow: int, ncol: int) -> DataFrame:
    """All ``i, j`` of a shape, generated in pieces that fit a task."""
    rows = spark.range(1, nrow + 1).withColumnRenamed("id", "i")
    pieces = rows.select("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(ncol).cast("long"), F.lit(CHUNK).cast("long"))).alias("_from"))
    return pieces.select("i", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK - 1, F.lit(ncol).cast("long")))).alias("j"))


@dataclass
class Matrix:
    """``df`` has ``i, j, v`` with unique 1-based coordinates; ``dense`` says that every cell is listed."""

    df: DataFrame
    nrow: int
    ncol: int
    dense: bool = True

    @staticmethod
    def from_arrays(df: DataFrame, row: str, values: str, nrow: int, ncol: int, base: int = 1) -> Matrix:
        """From one row and array of cells a record; ``base`` is the number of the first row in ``row``."""
        cells = df.select((F.col(row) - base + 1).cast("long").alias("i"), F.posexplode(values).alias("_p", "_v"))
        return Matrix(cells.select("i", (F.col("_p") + 1).cast("long").alias("j"), F.col("_v").cast("double").alias("v")), nrow, ncol)

    def _as(self, df: DataFrame, nrow: int | None = None, ncol: int | None = None, dense: bool | None = None) -> Matrix:
        return Matrix(df, nrow or self.nrow, ncol or self.ncol, self.dense if dense is None else dense)

    def densify(self) -> Matrix:
        """With every cell listed. The grid is generated, so this is for shapes that may be written out."""
        if self.dense:
            return self
        full = grid(self.df.sparkSession, self.nrow, self.ncol).join(self.df, ["i", "j"], "left")
        return self._as(full.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), dense=True)

    def map(self, f: Callable[[Column], Column], zero_safe: bool) -> Matrix:
        """``f`` of every cell; ``zero_safe`` says that f(0) is 0."""
        m = self if zero_safe else self.densify()
        return m._as(m.df.select("i", "j", f(F.col("v")).alias("v")))

    def t(self) -> Matrix:
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.ncol, self.nrow, self.dense)

    def aligned(self, other: Matrix, left: str = "x", right: str = "y") -> DataFrame:
        """``i, j`` and the cells of both, joined once; cells that only one of them lists are zero in the other."""
        if (self.nrow, self.ncol) != (other.nrow, other.ncol):
            raise ValueError(f"shapes differ: {self.nrow} x {self.ncol} and {other.nrow} x {other.ncol}")
        a, b = self.df.withColumnRenamed("v", left), other.df.withColumnRenamed("v", right)
        if self.dense and other.dense:
            return a.join(b, ["i", "j"])
        both = a.join(b, ["i", "j"], "full")
        return both.select("i", "j", F.coalesce(left, F.lit(0.0)).alias(left), F.coalesce(right, F.lit(0.0)).alias(right))

    def cellwise(self, other: Matrix, f: Callable[[Column, Column], Column], zero_safe: bool = True) -> Matrix:
        """``f`` of the cells of both; unless f(0, 0) is 0, sparse sides are written out first."""
        a, b = (self, other) if zero_safe else (self.densify(), other.densify())
        both = a.aligned(b)
        return a._as(both.select("i", "j", f(F.col("x"), F.col("y")).alias("v")), dense=a.dense and b.dense)

    def index(self, rows: tuple[int, int], cols: tuple[int, int]) -> Matrix:
        """Rows and columns from - to, both included and counted from 1, renumbered from 1."""
        (a, b), (c, d) = rows, cols
        if not (1 <= a <= b <= self.nrow and 1 <= c <= d <= self.ncol):
            raise ValueError("index out of range")
        cut = self.df.filter(F.col("i").between(a, b) & F.col("j").between(c, d))
        return self._as(cut.select((F.col("i") - (a - 1)).alias("i"), (F.col("j") - (c - 1)).alias("j"), "v"), b - a + 1, d - c + 1)

    def matmul(self, other: Matrix) -> Matrix:
        """The matrix product; listed cells meet by an equi-join, and products are summed on the map side first."""
        if self.ncol != other.nrow:
            raise ValueError("inner dimensions differ")
        a = self.df.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
        b = other.df.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
        return Matrix(a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")), self.nrow, other.ncol, self.dense and other.dense)

    def sum(self) -> Column:
        return F.coalesce(F.sum("v"), F.lit(0.0))

    def mean(self) -> Column:
        """Over all cells, listed or not."""
        return self.sum() / F.lit(float(self.nrow * self.ncol))

    def min(self) -> Column:
        """Over all cells; NaN cells are passed over, as Spark sorts NaN last."""
        return F.min("v") if self.dense else F.least(F.min("v"), F.when(F.count("*") < F.lit(self.nrow * self.ncol), F.lit(0.0)))

    def contains(self, pattern: float) -> Column:
        """Whether any cell equals the pattern, unlisted zeros included."""
        listed = F.coalesce(F.bool_or(F.col("v") == F.lit(pattern)), F.lit(False))
        return listed if self.dense or pattern != 0 else listed | (F.count("*") < F.lit(self.nrow * self.ncol))

    def has(self, pattern: float) -> bool:
        """As ``contains``, answered at the first cell found: an action, which reads no more than it needs."""
        if not self.df.filter(F.col("v") == F.lit(pattern)).limit(1).isEmpty():
            return True
        return not self.dense and pattern == 0 and self.df.count() < self.nrow * self.ncol

    def rows(self) -> DataFrame:
        """Row layout: ``i`` and the array of its ``ncol`` cells."""
        filled = self.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_m"))
        return filled.select("i", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(self.ncol).cast("long")), lambda j: F.coalesce(F.element_at("_m", j), F.lit(0.0))).alias("v"))


def as_matrix(spark: SparkSession, x: float) -> Matrix:
    return Matrix(spark.createDataFrame([(1, 1, float(x))], "i long, j long, v double"), 1, 1)


def as_scalar(m: Matrix) -> float:
    if (m.nrow, m.ncol) != (1, 1):
        raise ValueError("not a 1 x 1 matrix")
    row = m.df.first()
    return row["v"] if row else 0.0


def contingency(df: DataFrame, row: Column, column: Column, nrow: int, ncol: int, weight: Column | None = None) -> Matrix:
    """How often (or with which weight) each pair of 1-based row and column occurs; pairs out of range and nulls are left out."""
    cells = df.select(row.cast("long").alias("i"), column.cast("long").alias("j"), (weight if weight is not None else F.lit(1)).cast("double").alias("v"))
    cells = cells.filter(F.col("i").between(1, nrow) & F.col("j").between(1, ncol))
    return Matrix(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), nrow, ncol, dense=False)


def matvec(rows: DataFrame, vector: list[float]) -> DataFrame:
    """``i, v``: the product of each row's array with a short vector. A projection, no shuffle."""
    p = F.expr(f"array({', '.join(f'{x!r}D' for x in map(float, vector))})")
    return rows.select("i", F.aggregate(F.zip_with("v", p, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("v"))


def column_sums(rows: DataFrame, m: int) -> DataFrame:
    """``j, v`` of row layout, one sum a column."""
    return rows.select(F.posexplode("v").alias("_p", "x")).groupBy("_p").agg(F.sum("x").alias("v")).select((F.col("_p") + 1).cast("long").alias("j"), "v")


#: Numbers in a block of a summed vector.
SUM_BLOCK = 65_536


def summed(df: DataFrame, columns: list, partial: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``b``, ``s``: the sum of ``partial(batch)`` over all batches, as binary blocks ``b`` of doubles. All results of ``partial`` have one length.

    A task sums its batches before anything is shuffled; the tasks' blocks are added up in two steps, so that no group has more than about the root of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch)
                total = part if total is None else total + part
        if total is not None:
            total = np.ascontiguousarray(total, dtype=np.float64).ravel()
            cut = [total[i : i + SUM_BLOCK].tobytes() for i in range(0, len(total), SUM_BLOCK)]
            task = TaskContext.get().partitionId() % group
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["b", "t", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("s").to_pylist())
        return pa.table([pa.array([table.column("b")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["b", "t", "s"])

    group = max(int(partitions_of(df) ** 0.5), 1)
    schema = "b int, t int, s binary"
    parts = df.select(*columns).mapInArrow(run, schema)
    return parts.groupBy("b", "t").applyInArrow(add, schema).groupBy("b").applyInArrow(add, schema).select("b", "s")


def gathered(blocks: DataFrame) -> np.ndarray:
    """A summed vector on the driver; empty if there were no rows."""
    rows = sorted(blocks.collect(), key=lambda r: r["b"])
    return np.concatenate([np.frombuffer(r["s"]) for r in rows]) if rows else np.zeros(0)


def gram_sums(rows: DataFrame, y: str | None = None) -> DataFrame:
    """t(X) (y, X) for row layout, summed: m x (m + 1) numbers, y first (0 without it)."""
    columns = [F.col("v").cast("array<double>").alias("v"), (F.col(y).cast("double") if y else F.lit(0.0)).alias("y")]

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
        out = np.empty((x.shape[1], x.shape[1] + 1))
        out[:, 0] = x.T @ np.asarray(batch.column(1), dtype=np.float64)
        out[:, 1:] = x.T @ x
        return out

    return summed(rows, columns, part)


def gram_arrays(rows: DataFrame, m: int, y: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """t(X) X and t(X) y on the driver, m x m and m numbers."""
    both = gathered(gram_sums(rows, y)).reshape(m, m + 1)
    return both[:, 1:], both[:, 0]


def gram(rows: DataFrame, m: int, y: str | None = None) -> DataFrame:
    """``j, k, v`` of t(X) X for row layout of ``m`` columns; with ``y``, a numeric column, also t(X) y as column 0 (``k`` = 0)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(s)
                p = np.arange(b * SUM_BLOCK, b * SUM_BLOCK + len(v))
                yield pa.RecordBatch.from_arrays([pa.array(p // (m + 1) + 1), pa.array(p % (m + 1)), pa.array(v)], names=["j", "k", "v"])

    out = gram_sums(rows, y).mapInArrow(cells, "j long, k long, v double")
    return out if y else out.filter("k > 0")
