"""Percentiles of very large numeric columns by cumulative frequencies.

A group's values are reduced to (value, count) pairs, a state that adds up over files and days. Percentiles come from the pairs of all groups in one range sort by group and
value: each partition's window sums run up from what the partitions before it hold of the same group, and the first value whose cumulative count reaches the target rank is
picked. So neither a group nor a value of any weight is gathered anywhere, and what comes to the driver is a row for each partition.

With ``bits`` set, values are first reduced to buckets of relative width 2**-bits, so a group has at most ``2 * 64 * 2**bits`` pairs of integers (of floating-point
numbers ``2 * 2048 * 2**bits``) whatever its size, and a percentile is off by at most a 2**-(bits+1) part of itself (integers below 2**bits are exact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.materialize import materialize
from quern.plans.slices import null_safe_join, partitions_of

PART = "__quern_part"
#: Floating-point values nearer to zero than this are taken as zero by buckets.
TINY = 1e-290


def value_bucket(value: Column, bits: int) -> Column:
    """The middle of the bucket of an integral ``value``: its leading ``bits + 1`` binary digits are kept, sign apart. Null stays null."""
    size = F.abs(F.greatest(value.cast("long"), F.lit(1 - 2**63)))
    right = lambda bits_off: F.call_function("shiftright", size, bits_off)
    # the length of the binary notation is exact, and names ``size`` once: nested conditions on a logarithm multiply the code
    drop = F.greatest(F.length(F.bin(size)) - (1 + bits), F.lit(0))
    low = F.call_function("shiftleft", right(drop), drop)
    middle = low + F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), drop), F.lit(1))
    return F.when(value < 0, -middle).when(value.isNotNull(), middle)


def fraction_bucket(value: Column, bits: int) -> Column:
    """As ``value_bucket``, of a floating-point or decimal ``value``. Infinite values stay, null and NaN become null."""
    size = F.abs(value.cast("double"))
    scale = F.pow(F.lit(2.0), bits - F.floor(F.log2(size)))
    middle = (F.floor(size * scale) + 0.5) / scale
    whole = F.when(size < TINY, F.lit(0.0)).when(size == float("inf"), size).otherwise(middle)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.when(value < 0, -whole).otherwise(whole))


def value_counts(df: DataFrame, groups: list[str], value: Column, bits: int | None = None) -> DataFrame:
    """The mergeable state: groups, ``value``, ``n``. Null and NaN values are left out; a null group is a group. ``value`` is of any numeric type.

    Every row counts as it stands, so the states of files or days, each made of its own rows only, add up to that of the whole (``merge_states``).
    """
    kind = df.select(value.alias("v")).schema["v"].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"percentiles need a numeric column, not {kind.simpleString()}")
    if bits is not None:
        value = value_bucket(value, bits) if isinstance(kind, T.IntegralType) else fraction_bucket(value, bits)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    rows = df.select(*groups, value.alias("value")).filter(F.col("value").isNotNull())
    return rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))


def merge_states(states: DataFrame, groups: list[str]) -> DataFrame:
    """Put states of files or days together, possibly dropping a grouping column: counts add up."""
    return states.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _spanning(cut: DataFrame, groups: list[str]) -> DataFrame:
    """For groups that lie in several partitions, a row for each of these: what the partitions before hold of the group, and the group's total.

    Only the first and last group of a partition can be such, so this gathers a row a partition.
    """
    sums = cut.groupBy(PART, *groups).agg(F.sum("n").alias("n"))
    place = F.struct(*groups, "n")
    ends = sums.groupBy(PART).agg(F.min(place).alias("a"), F.max(place).alias("b")).orderBy(PART).collect()
    pieces: dict[tuple, list[tuple[int, int]]] = {}
    for r in ends:
        for end in [r["a"]] if r["a"][:-1] == r["b"][:-1] else [r["a"], r["b"]]:
            pieces.setdefault(tuple(end[:-1]), []).append((r[PART], end["n"]))
    rows = []
    for group, parts in pieces.items():
        before, total = 0, sum(n for _, n in parts)
        for part, n in parts if len(parts) > 1 else ():
            rows.append((part, *group, before, total))
            before += n
    schema = [T.StructField(PART, T.IntegerType()), *(cut.schema[g] for g in groups), T.StructField("_before", T.LongType()), T.StructField("_total", T.LongType())]
    return cut.sparkSession.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def percentiles_of_states(states: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """Groups, ``n`` (values counted) and ``p<percent>`` for each percent: the first value whose cumulative count is at least ``ceil(n * percent / 100)``.

    ``states`` has one row for each group and value. Percent 0 gives the smallest value. Groups without values don't come out.
    """
    parts = partitions_of(states)
    # written once: the places of the cuts are drawn from a sample, and all that follows must see the same
    cut = materialize(states.repartitionByRange(parts, *groups, "value").withColumn(PART, F.spark_partition_id()), "range-sorted")
    rows = null_safe_join(cut, F.broadcast(_spanning(cut, groups)), [PART, *groups])  # at most two rows a partition
    rows = rows.repartitionById(parts, F.col(PART))
    whole = Window.partitionBy(PART, *groups)
    upto = F.sum("n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    rows = rows.select(*groups, "value", upto.alias("_upto"), F.coalesce("_total", F.sum("n").over(whole)).alias("_total"))
    picks = []
    for p in percents:
        rank = F.greatest(F.ceil(F.col("_total") * p / 100), F.lit(1))
        picks.append(F.min(F.when(F.col("_upto") >= rank, F.col("value"))).alias(f"p{p}"))
    return rows.groupBy(*groups).agg(F.first("_total").alias("n"), *picks)


def percentiles(df: DataFrame, groups: list[str], value: Column, percents: list[int], bits: int | None = 8) -> DataFrame:
    """Percentiles per group of ``df``, exact if ``bits`` is None, else with the bounded error of the module's states.

    Nulls and NaN in ``value`` are not counted, a null group is a group of its own, repeated rows count as often as they stand, an empty table gives no rows, and
    other columns are ignored. Integers give integers, other numbers doubles (exact percentiles the type of the column).
    """
    return percentiles_of_states(value_counts(df, groups, value, bits), groups, percents)
