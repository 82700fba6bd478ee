"""Analytics over benchmark results: order of labels and memory settings, grids of mode by conf, chart axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.labels import conf_bytes, finite_max
from quern.plans.ranks import ranked


def ordered_unique(df: DataFrame, value: str, position: str) -> DataFrame:
    """``value``, ``first_position`` and ``place`` (from 0): distinct values by first appearance. Nulls are no value."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("first_position"))
    return ranked(first, ["first_position", value]).withColumnRenamed("_rank", "place")


def conf_order(df: DataFrame, conf: str, position: str) -> DataFrame:
    """``conf``, ``bytes``, ``place``: distinct settings by size, those that can't be read last, ties and these in order of first appearance."""
    first = df.filter(F.col(conf).isNotNull()).groupBy(conf).agg(F.min(position).alias("first_position")).withColumn("bytes", conf_bytes(F.col(conf)))
    order = [F.col("bytes").isNull(), F.col("bytes"), F.col("first_position"), F.col(conf)]
    return ranked(first, order).select(conf, "bytes", F.col("_rank").alias("place"))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each group in the given order. A maximum of structs, so it combines on the map side."""
    last = F.max(F.struct(*order, *(F.col(c).alias(f"_c_{c}") for c in columns))).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last._c_{c}").alias(c) for c in columns))


class DuplicateResult(ValueError):
    """A result stands twice where one is expected."""


class MissingResult(ValueError):
    """A result is missing where every one is expected."""


def result_grid(df: DataFrame, series: str, axis: str, value: Column, groups: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Every pair of ``series`` and ``axis`` label (of a group) with its ``value``, NaN where there is none or it is null.

    A pair that stands twice is an error, and with ``strict`` so is a missing one. Rows with a null label are left out.
    """
    groups = groups or []
    rows = df.filter(F.col(series).isNotNull() & F.col(axis).isNotNull()).select(*groups, series, axis, value.cast("double").alias("value"))
    twice = rows.groupBy(*groups, series, axis).count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicateResult(f"more than one result for {twice[0].asDict()}")
    # the labels of a group meet by its key: the grid is the result, so this join makes no more rows than that
    keyed = rows.withColumn("_one", F.lit(1))
    grid = keyed.select("_one", *groups, series).distinct().join(keyed.select("_one", *groups, axis).distinct(), ["_one", *groups]).drop("_one")
    full = grid.join(rows.withColumn("_here", F.lit(1)), [*groups, series, axis], "left")
    if strict and (gone := full.filter("_here is null").limit(1).collect()):
        raise MissingResult(f"no result for {gone[0].asDict()}")
    return full.select(*groups, series, axis, F.coalesce("value", F.lit(float("nan"))).alias("value"))


def pivoted(grid: DataFrame, groups: list[str], axis: str, labels: list[str]) -> DataFrame:
    """A grid with a column for each of the given axis labels."""
    return grid.groupBy(*groups).pivot(axis, labels).agg(F.first("value"))


def result_rows(df: DataFrame, mode: str, conf: str, position: str, value: Column, groups: list[str], missing: str = "nan", digits: int = 3) -> DataFrame:
    """The table of a group's results as it is drawn: groups, ``mode``, and in order of the settings' sizes their names (``confs``) and values (``cells``), as arrays of text.

    A pair of mode and setting that stands twice is an error; ``missing`` stands for those that are null, NaN or not there. Settings that can't be read come last.
    A row holds a group's settings, so its length is the result's own.
    """
    grid = result_grid(df, mode, conf, value, groups)
    first = df.filter(F.col(conf).isNotNull() & F.col(mode).isNotNull()).groupBy(*groups, conf).agg(F.min(position).alias("_first"))
    size = conf_bytes(F.col(conf))
    text = F.when(F.isnan("value"), missing).otherwise(F.round("value", digits).cast(f"decimal(20,{digits})").cast("string"))
    place = F.struct(size.isNull().alias("n"), size.alias("b"), F.col("_first").alias("f"), F.col(conf).alias("c"), text.alias("t"))
    rows = grid.join(first, [*groups, conf]).groupBy(*groups, mode).agg(F.array_sort(F.collect_list(place)).alias("_p"))
    return rows.select(*groups, mode, F.transform("_p", lambda p: p["c"]).alias("confs"), F.transform("_p", lambda p: p["t"]).alias("cells"))


def axis_limit(df: DataFrame, value: Column, groups: list[str], headroom: float = 1.18, finite: bool = True) -> DataFrame:
    """Groups, ``top`` and ``axis_top`` with headroom. ``top`` is the greatest finite value, 1.0 if none; without ``finite`` the plain maximum (null if there is none, NaN above all)."""
    return df.groupBy(*groups).agg((finite_max(value) if finite else F.max(value)).alias("top")).withColumn("axis_top", F.col("top") * headroom)
