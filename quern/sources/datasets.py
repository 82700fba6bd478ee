"""The data that benchmark programs read, built once: dense matrices as tiles, tall ones as rows, clustered points with centres and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.generators import blobs, rand_rows
from quern.operators.tiles import rand_tiles
from quern.sources.matrices import matrix_exists


@dataclass(frozen=True)
class Dataset:
    name: str
    nrow: int
    ncol: int
    #: clusters of a set of points; 0 for a uniform matrix
    clusters: int = 0
    #: numbers of the copies, each with a seed of its own
    copies: int = 1


#: Shapes of the published programs.
DATASETS = [Dataset("mat_10000x10000", 10_000, 10_000, copies=3), Dataset("mat_1000000x1000", 1_000_000, 1_000, copies=2), Dataset("mat_1000000x1", 1_000_000, 1, copies=2), Dataset("blobs_4000000x256", 4_000_000, 256, clusters=32)]
BLOB_SD, BLOB_SEED = 0.1, 7


def _write(df: DataFrame, path: str, nrow: int, ncol: int, skip: bool) -> bool:
    """Cells and shape; whether anything was written. An existing target, or one whose shape is there, stays."""
    spark = df.sparkSession
    if skip and matrix_exists(spark, path):
        return False
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(nrow, ncol, True)], "nrow long, ncol long, dense boolean").coalesce(1).write.mode("overwrite").json(f"{path}.mtd")
    return True


def build_datasets(spark: SparkSession, root: str, scale: float = 1.0, datasets: list[Dataset] = DATASETS, skip_existing: bool = True) -> list[dict]:
    """Build all sets below ``root``: a row for each part with its path, shape and whether it was written. ``scale`` shrinks rows (and columns of square matrices).

    A set that is there already is skipped, part by part, so a broken run is taken up where it ended.
    """
    out = []
    for d in datasets:
        nrow = max(int(d.nrow * scale), 1)
        ncol = max(int(d.ncol * scale), 1) if d.ncol == d.nrow else d.ncol
        for copy in range(1, d.copies + 1):
            base = f"{root}/{d.name}_{copy}"
            if d.clusters:
                x, c, y = blobs(spark, nrow, ncol, d.clusters, 1.0, BLOB_SD, BLOB_SEED)
                parts = [("_X", x, nrow, ncol), ("_C", c.df, d.clusters, ncol), ("_Y", y.select("i", F.lit(1).cast("long").alias("j"), F.col("y").cast("double").alias("v")), nrow, 1)]
            else:
                made = rand_tiles if d.ncol == d.nrow else rand_rows
                parts = [("", made(spark, nrow, ncol, seed=copy), nrow, ncol)]
            for suffix, df, r, c in parts:
                out.append({"name": f"{d.name}_{copy}{suffix}", "path": base + suffix, "nrow": r, "ncol": c, "written": _write(df, base + suffix, r, c, skip_existing)})
    return out
