"""Cutting hot groups into ordered slices, so that a window never holds more than a task's share of all rows.

A group is hot if it has more than a ``split * partitions``-th of all rows; so there are fewer than ``split * partitions`` hot groups, and at most twice as many slices,
whatever the number of rows. What comes to the driver and what is broadcast is a row for each of them. What a slice must know of the slices before
it (a running sum, a running maximum) is one row for each slice, see ``carry``. The slice of a row depends on its columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hot groups hold more than a ``SPLIT``-th of a partition's share of the rows, and more than ``MIN_ROWS`` rows.
SPLIT, MIN_ROWS = 4, 100_000
#: Columns added to rows; names that no table is likely to have.
SLICE, CUT = "__quern_slice", "__quern_cut"


class Sliced:
    """``df`` with the column its slice; ``hot`` says whether any group was cut."""

    def __init__(self, df: DataFrame, keys: list[str], hot: bool):
        self.df, self.keys, self.hot = df, keys, hot

    def _own(self, aggregates: list[Column]) -> DataFrame:
        return self.df.filter(F.col(CUT)).groupBy(*self.keys, SLICE).agg(*aggregates)

    def carry(self, rows: DataFrame | None = None, **aggregates: tuple[Column, str]) -> DataFrame:
        """``rows`` (or ``df``) with, for each name, the ``sum`` or ``max`` of a column of ``df`` over all earlier slices of the group (null in the first slice)."""
        rows = self.df if rows is None else rows
        if not self.hot:
            return rows.withColumns({n: F.lit(None).cast(self.df.select(c).schema[0].dataType) for n, (c, _) in aggregates.items()})
        kinds = {"sum": F.sum, "max": F.max}
        own = self._own([kinds[k](c).alias(n) for n, (c, k) in aggregates.items()])
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        own = own.select(*self.keys, SLICE, *(kinds[k](n).over(before).alias(n) for n, (_, k) in aggregates.items()))
        return null_safe_join(rows, F.broadcast(own), [*self.keys, SLICE])  # a row a slice

    def carry_after(self, rows: DataFrame | None = None, **aggregates: tuple[Column, str]) -> DataFrame:
        """As ``carry``, with the ``min`` over all later slices of the group (null in the last)."""
        rows = self.df if rows is None else rows
        if not self.hot:
            return rows.withColumns({n: F.lit(None).cast(self.df.select(c).schema[0].dataType) for n, (c, _) in aggregates.items()})
        own = self._own([F.min(c).alias(n) for n, (c, _) in aggregates.items()])
        after = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
        own = own.select(*self.keys, SLICE, *(F.min(n).over(after).alias(n) for n in aggregates))
        return null_safe_join(rows, F.broadcast(own), [*self.keys, SLICE])  # a row a slice


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join on columns of equal names in which null meets null; the columns come once."""
    right = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    joined = left.join(right, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in on], how)
    return joined.drop(*(f"_r_{c}" for c in on))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slice_hot_groups(df: DataFrame, keys: list[str], order: str, min_rows: int = MIN_ROWS, split: int = SPLIT) -> Sliced:
    """Give each row a slice number that rises with ``order`` within its group; 0 everywhere in groups that are not hot.

    ``order`` must be of a numeric type. Rows with a null ``order`` stay in slice 0. Rows of equal ``order`` share a slice: callers reduce them (on the map side) where
    copies of a row may be very many.
    """
    most = split * partitions_of(df)
    seen = Observation()
    top = df.groupBy(*keys).count().observe(seen, F.sum("count").alias("total")).orderBy(F.desc("count")).limit(most).collect()
    total = seen.get["total"] or 0
    limit = max(min_rows, -(-total // most))
    hot = [r for r in top if r["count"] > limit]
    if not hot:
        return Sliced(df.withColumns({SLICE: F.lit(0), CUT: F.lit(False)}), keys, False)
    spark = df.sparkSession
    types = [df.schema[k] for k in keys]
    need = {tuple(r[k] for k in keys): -(-r["count"] // limit) for r in hot}
    named = spark.createDataFrame(list(need), T.StructType(types))
    fine = min(10_000, 8 * max(need.values()))
    within = null_safe_join(df.select(*keys, order), F.broadcast(named), keys, "inner")
    found = within.groupBy(*keys).agg(F.percentile_approx(order, [i / fine for i in range(1, fine)], 10_000).alias("_fine")).collect()
    cuts = []
    for r in found:
        key = tuple(r[k] for k in keys)
        if r["_fine"]:  # all of a group's order may be null
            parts = need[key]
            cuts.append((*key, sorted({r["_fine"][min(max(i * fine // parts, 1), fine - 1) - 1] for i in range(1, parts)})))
    bounds = spark.createDataFrame(cuts, T.StructType([*types, T.StructField("__quern_bounds", T.ArrayType(df.schema[order].dataType))]))
    df = null_safe_join(df, F.broadcast(bounds), keys)
    number = F.when(F.col("__quern_bounds").isNull() | F.col(order).isNull(), 0).otherwise(F.size(F.filter("__quern_bounds", lambda b: b < F.col(order)))).cast("int")
    return Sliced(df.withColumns({SLICE: number, CUT: F.col("__quern_bounds").isNotNull()}).drop("__quern_bounds"), keys, True)
