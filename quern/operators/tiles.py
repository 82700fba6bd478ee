"""Tile layout ``bi, bj, r, c, v`` (0-based block numbers, block shape, cells by row) for programs over large dense matrices: products, and cells that meet their mirror image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.matrix import Matrix
from quern.plans.slices import partitions_of

SCHEMA = "bi long, bj long, r int, c int, v array<double>"


def to_tiles(m: Matrix, block: int = 256) -> DataFrame:
    """Blocks of ``block`` x ``block`` cells, smaller at the edges; blocks without any listed cell don't come out."""
    at = m.df.select(F.floor((F.col("i") - 1) / block).alias("bi"), F.floor((F.col("j") - 1) / block).alias("bj"), ((F.col("i") - 1) % block).cast("int").alias("x"), ((F.col("j") - 1) % block).cast("int").alias("y"), "v")
    nrow, ncol = m.nrow, m.ncol

    def build(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r, c = min(block, nrow - key[0] * block), min(block, ncol - key[1] * block)
        tile = np.zeros((r, c))
        tile[cells.x.to_numpy(), cells.y.to_numpy()] = cells.v.to_numpy()
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "r": [r], "c": [c], "v": [tile.ravel()]})

    return at.groupBy("bi", "bj").applyInPandas(build, SCHEMA)


def from_tiles(tiles: DataFrame, nrow: int, ncol: int, block: int = 256) -> Matrix:
    cells = tiles.select("bi", "bj", "c", F.posexplode("v").alias("_p", "v"))
    cells = cells.select((F.col("bi") * block + F.floor(F.col("_p") / F.col("c")) + 1).alias("i"), (F.col("bj") * block + F.col("_p") % F.col("c") + 1).alias("j"), "v")
    return Matrix(cells, nrow, ncol, dense=False)


def row_tiles(rows: DataFrame, nrow: int, ncol: int, block: int = 256) -> DataFrame:
    """Tiles of row layout (``i`` from 1, ``v``): a band of ``block`` rows is cut in one task. Rows that aren't there are zero."""

    def cut(key: tuple, band: pa.Table) -> pa.Table:
        bi = key[0].as_py()
        whole = np.zeros((min(block, nrow - bi * block), ncol))
        v = band.column("v").combine_chunks()
        whole[np.asarray(band.column("i")) - 1 - bi * block] = np.asarray(v.flatten()).reshape(band.num_rows, ncol)
        return _table([(bi, j // block, np.ascontiguousarray(whole[:, j : j + block])) for j in range(0, ncol, block)])

    banded = rows.select(F.floor((F.col("i") - 1) / block).alias("bi"), F.col("i").cast("long").alias("i"), F.col("v").cast("array<double>").alias("v"))
    return banded.groupBy("bi").applyInArrow(cut, SCHEMA)


def _table(tiles: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    ends = np.cumsum([0, *(t.size for _, _, t in tiles)])
    v = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([t.ravel() for _, _, t in tiles]) if tiles else np.zeros(0)))
    columns = [pa.array([x[0] for x in tiles], pa.int64()), pa.array([x[1] for x in tiles], pa.int64()), pa.array([x[2].shape[0] for x in tiles], pa.int32()), pa.array([x[2].shape[1] for x in tiles], pa.int32()), v]
    return pa.table(columns, names=["bi", "bj", "r", "c", "v"])


def _batches(tiles: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    yield from _table(tiles).to_batches()


def _arrays(batch: pa.RecordBatch | pa.Table, name: str, shape: tuple[str, str]) -> Iterator[np.ndarray]:
    """The tiles of a list column; rows and columns stand in two others. Nothing is copied."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets, dtype=np.int64)
    for a, b, r, c in zip(ends - ends[0], ends[1:] - ends[0], batch.column(shape[0]).to_pylist(), batch.column(shape[1]).to_pylist()):
        yield flat[a:b].reshape(r, c)


def rand_tiles(spark: SparkSession, nrow: int, ncol: int, seed: int = 0, block: int = 512, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A dense uniform matrix, generated by tile: a tile's numbers depend on seed and place alone."""
    bands, across = -(-nrow // block), -(-ncol // block)
    at = spark.range(0, bands * across, 1, min(max(bands * across // 8, 1), 4 * partitions_of_session(spark))).select(F.col("id"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                bi, bj = divmod(n, across)
                shape = min(block, nrow - bi * block), min(block, ncol - bj * block)
                yield from _batches([(bi, bj, low + (high - low) * np.random.default_rng([seed, bi, bj]).random(shape))])

    return at.mapInArrow(make, SCHEMA)


def partitions_of_session(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tile_map(tiles: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of every tile; it keeps the shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches([(i, j, f(t)) for i, j, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch, "v", ("r", "c")))])

    return tiles.mapInArrow(run, SCHEMA)


def tile_crop(tiles: DataFrame, rows: tuple[int, int], cols: tuple[int, int], block: int = 512) -> DataFrame:
    """The cells of rows and columns from - to (from 1, both included): tiles outside aren't read, those at the edges are cut and keep their block numbers.

    What comes out can be mapped and summed; it is no tiling of the cut matrix by the same block.
    """
    (a, b), (c, d) = rows, cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = lambda i, j, t: t[max(a - 1 - i * block, 0) : b - i * block, max(c - 1 - j * block, 0) : d - j * block]
            yield from _batches([(i, j, cut(i, j, t)) for i, j, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch, "v", ("r", "c")))])

    inside = F.col("bi").between((a - 1) // block, (b - 1) // block) & F.col("bj").between((c - 1) // block, (d - 1) // block)
    return tiles.filter(inside).mapInArrow(run, SCHEMA)


def tile_transpose(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches([(j, i, np.ascontiguousarray(t.T)) for i, j, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch, "v", ("r", "c")))])

    return tiles.mapInArrow(run, SCHEMA)


def tile_with_transposed(tiles: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``f(M, t(M))`` cell by cell for a square matrix: tile (i, j) meets tile (j, i) in one task, which turns them where they lie. One shuffle of the tiles.

    Both tiles of a pair come out of one group, so each tile is moved once; groups have at most two tiles. A tile that isn't there is zero.
    """

    def pair(table: pa.Table) -> pa.Table:
        have = {(i, j): t for i, j, t in zip(table.column("bi").to_pylist(), table.column("bj").to_pylist(), _arrays(table, "v", ("r", "c")))}
        for (i, j), t in list(have.items()):
            have.setdefault((j, i), np.zeros(t.shape[::-1]))
        return _table([(i, j, f(t, have[j, i].T)) for (i, j), t in have.items()])

    return tiles.groupBy(F.least("bi", "bj"), F.greatest("bi", "bj")).applyInArrow(pair, SCHEMA)


def tile_zip(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of the tiles of two matrices of one shape and block, cell by cell; a tile that one lacks is zero."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        # an empty side has no columns
        x, y = (next(_arrays(t, v, shape), None) if v in t.column_names else None for t, v, shape in ((left, "v", ("r", "c")), (right, "_v", ("_r", "_c"))))
        x, y = (np.zeros_like(y) if x is None else x), (np.zeros_like(x) if y is None else y)
        bi, bj = (left.column("bi"), left.column("bj")) if "bi" in left.column_names else (right.column("_bi"), right.column("_bj"))
        return _table([(bi[0].as_py(), bj[0].as_py(), f(x, y))])

    # other names, as both may come from one table
    b = b.select(*(F.col(c).alias(f"_{c}") for c in ("bi", "bj", "r", "c", "v")))
    return a.groupBy("bi", "bj").cogroup(b.groupBy("_bi", "_bj")).applyInArrow(both, SCHEMA)


def tile_sum(tiles: DataFrame) -> DataFrame:
    """``total`` and ``n_cells`` of the listed tiles; a task hands on one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            v = np.asarray(batch.column(0).flatten())
            total, n = total + float(v.sum()), n + v.size
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["total", "n_cells"])

    return tiles.select("v").mapInArrow(run, "total double, n_cells long").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells"))


#: Sums of target tiles that a task holds before it hands them on, and tiles up to which a side is broadcast (both 512 KB at a block of 256).
HELD_TILES, BROADCAST_TILES = 256, 64


def tile_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two tiled matrices: one dense product for each pair of tiles that meet, summed by target block in the task before anything is shuffled.

    A right side of few tiles (counted) is broadcast. Else tiles meet by their inner block; if there are fewer of these than tasks, the left tiles of an inner
    block are dealt to several tasks by their row and the right ones copied to these.
    """
    left = a.select(F.col("bi"), F.col("bj").alias("bk"), F.col("r"), F.col("c").alias("k"), F.col("v").alias("av"))
    right = b.select(F.col("bi").alias("bk"), F.col("bj"), F.col("c"), F.col("v").alias("bv"))
    if b.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES:
        pairs = left.join(F.broadcast(right), "bk")
    else:
        inner = (a.agg(F.max("bj")).first()[0] or 0) + 1
        deal = max(1, -(-2 * partitions_of(a) // inner))
        left = left.withColumn("_deal", F.pmod(F.col("bi"), F.lit(deal)))
        right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
        pairs = left.join(right, ["bk", "_deal"])
    pairs = pairs.select("bi", "bj", "r", "k", "c", "av", "bv")
    group = max(int(partitions_of(a) ** 0.5), 1)
    schema = f"{SCHEMA}, t int"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        task = TaskContext.get().partitionId() % group

        def told() -> Iterator[pa.RecordBatch]:
            table = _table([(i, j, t) for (i, j), t in held.items()])
            held.clear()
            yield from table.append_column("t", pa.array([task] * table.num_rows, pa.int32())).to_batches()

        for batch in batches:
            at = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for place, x, y in zip(at, _arrays(batch, "av", ("r", "k")), _arrays(batch, "bv", ("k", "c"))):
                held[place] = held[place] + x @ y if place in held else x @ y
                if len(held) >= HELD_TILES:
                    yield from told()
        if held:
            yield from told()

    def add(table: pa.Table) -> pa.Table:
        total = sum(_arrays(table, "v", ("r", "c")))
        out = _table([(table.column("bi")[0].as_py(), table.column("bj")[0].as_py(), total)])
        return out.append_column("t", pa.array([0], pa.int32()))

    sums = pairs.mapInArrow(multiply, schema).groupBy("bi", "bj", "t").applyInArrow(add, schema)
    return sums.groupBy("bi", "bj").applyInArrow(add, schema).drop("t")
