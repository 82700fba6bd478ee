"""Overlapping, nested, touching and gapped intervals of entities: continuous periods and the gaps between them.

Sort by start within the entity, compare each start with the running maximum of the ends before it, number the islands by a running count, and aggregate.
Entities that hold more than a task's share of the rows are cut into time slices (``plans.slices``); a slice gets the maximum end of all slices before it as one
carried value, and all rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.slices import CUT, MIN_ROWS, SLICE, null_safe_join, slice_hot_groups


def usable_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows with all keys, start and end, and end > start; only these columns."""
    ok = F.col(end) > F.col(start)
    for k in keys:
        ok &= F.col(k).isNotNull()
    return df.filter(ok).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"))


def _reach(df: DataFrame, keys: list[str], min_rows: int) -> tuple[DataFrame, bool]:
    """Spans with ``_n`` and ``_reach``, the latest end of all spans that come before in order of start (null for an entity's first), and whether any entity was cut.

    The spans of one start in a hot entity are one row with their latest end and number ``_n``, made before they are shuffled: so neither copies of a span nor spans that
    begin together pile up.
    """
    sliced = slice_hot_groups(df, keys, "_start", min_rows)
    rows = sliced.df.withColumn("_n", F.lit(1).cast("long"))
    if sliced.hot:
        reduced = rows.filter(CUT).groupBy(*keys, SLICE, "_start").agg(F.max("_end").alias("_end"), F.sum("_n").alias("_n"))
        rows = rows.filter(~F.col(CUT)).unionByName(reduced.withColumn(CUT, F.lit(True)))
    rows = sliced.carry(rows, _carried=(F.col("_end"), "max"))
    before = Window.partitionBy(*keys, SLICE).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.greatest(F.max("_end").over(before), "_carried")), sliced.hot


def interval_gaps(df: DataFrame, keys: list[str], start: str = "start_nanos", end: str = "end_nanos", min_rows: int = MIN_ROWS) -> DataFrame:
    """The stretches between an entity's first start and last end in which none of its intervals is open: keys, ``gap_start``, ``gap_end``.

    Rows with a null key or bound, or an end not after the start, are left out. Touching intervals leave no gap; repeated rows change nothing; an empty
    table gives no rows; other columns of ``df`` are ignored, whatever their names.
    """
    rows, _ = _reach(usable_spans(df, keys, start, end), keys, min_rows)
    return rows.filter(F.col("_start") > F.col("_reach")).select(*keys, F.col("_reach").alias("gap_start"), F.col("_start").alias("gap_end"))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start_nanos", end: str = "end_nanos", min_rows: int = MIN_ROWS) -> DataFrame:
    """The continuous periods of each entity: keys, ``period_start``, ``period_end``, ``n_spans``. Touching intervals belong together.

    Null keys or bounds, malformed rows, empty tables and clashing names as in ``interval_gaps``; repeated rows count in ``n_spans``.
    """
    rows, hot = _reach(usable_spans(df, keys, start, end), keys, min_rows)
    opens = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach")), 1).otherwise(0)
    upto = Window.partitionBy(*keys, SLICE).orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        rows.withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(upto))
        .groupBy(*keys, SLICE, "_island")
        .agg(F.min("_start").alias("period_start"), F.max("_end").alias("period_end"), F.sum("_n").alias("n_spans"), F.first(CUT).alias(CUT))
    )
    if not hot:
        return pieces.select(*keys, "period_start", "period_end", "n_spans")
    # the first piece of a slice may continue the last period of a slice before it
    last = pieces.filter(F.col(CUT)).groupBy(*keys, SLICE).agg(F.max(F.when(F.col("_island") > 0, F.col("period_start"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, SLICE, F.max("_last").over(before).alias("_begun"))
    whole = null_safe_join(pieces, F.broadcast(last), [*keys, SLICE])  # a row a slice
    begin = F.when(F.col("_island") == 0, F.col("_begun")).otherwise(F.col("period_start"))
    return (
        whole.withColumn("period_start", begin)
        .groupBy(*keys, "period_start")
        .agg(F.max("period_end").alias("period_end"), F.sum("n_spans").alias("n_spans"))
        .select(*keys, "period_start", "period_end", "n_spans")
    )
