"""Irregular readings onto a regular grid.

Readings are aggregated to one value for each (source, series, slot), the grid is generated as chunks of slots and expanded where it is needed, and the
last value is carried forward inside a chunk and over one chunk border, which suffices as a value is carried over at most one chunk's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import materialize

CHUNK_SLOTS = 4096


def slot_readings(df: DataFrame, source: str, time: str, series: list[str], step: int, latest: list[str], usable: Column | None = None) -> DataFrame:
    """One row for each source, series and slot that has a usable reading: source, ``metric``, ``slot_ns``, ``value``, ``n_readings``.

    A usable reading has source, time and a value that is not null (and fulfils ``usable``, an expression over ``value``). The slot's value is that of the
    last reading in order of time, then ``latest``, then value.
    """
    long = df.select(
        F.col(source).alias("_source"),
        F.col(time).alias("_time"),
        *(F.col(c).alias(f"_latest{i}") for i, c in enumerate(latest)),
        F.explode(F.array(*(F.struct(F.lit(s).alias("metric"), F.col(s).alias("value")) for s in series))).alias("_reading"),
    ).select("*", "_reading.metric", "_reading.value")
    ok = F.col("_source").isNotNull() & F.col("_time").isNotNull() & F.col("value").isNotNull()
    long = long.filter(ok if usable is None else ok & usable)
    slot = F.col("_time") - F.pmod(F.col("_time"), F.lit(step))
    order = F.struct("_time", *(f"_latest{i}" for i in range(len(latest))), "value")
    return long.groupBy("_source", "metric", slot.alias("slot_ns")).agg(F.max(order).alias("_last"), F.count("*").alias("n_readings")).select(F.col("_source").alias(source), "metric", "slot_ns", F.col("_last.value").alias("value"), "n_readings")


def regular_grid(
    df: DataFrame,
    source: str,
    time: str,
    series: list[str],
    step: int,
    latest: list[str],
    usable: Column | None = None,
    max_gap_slots: int = 20,
    chunk_slots: int = CHUNK_SLOTS,
) -> DataFrame:
    """A row for every slot from the first to the last usable reading of each source and series.

    Columns: source, ``metric``, ``slot_ns``, ``value``, ``status`` (``read``, ``carried`` or ``missing``), ``n_readings``. A slot without a reading takes the
    last value if that is at most ``max_gap_slots`` slots old, else value is null and status ``missing``. Slots begin at multiples of ``step``, also for
    negative times. Rows without source, time or value are not used; readings delivered twice count in ``n_readings`` but change no value; of two values at
    one instant the one that comes last by ``latest``, then the greater one, holds. An empty table gives no rows. A series column full of nulls gives none.
    """
    if max_gap_slots > chunk_slots:
        raise ValueError("a value is carried over one chunk border at most; raise chunk_slots")
    slots = slot_readings(df, source, time, series, step, latest, usable)
    width = step * chunk_slots
    chunk = (F.col("slot_ns") - F.pmod(F.col("slot_ns"), F.lit(width))).alias("_chunk")
    key = [source, "metric"]
    slots = materialize(slots.select("*", chunk), "grid-slots")  # read three times below
    ends = slots.groupBy(*key).agg(F.min("slot_ns").alias("_first"), F.max("slot_ns").alias("_last"))
    first_chunk = F.col("_first") - F.pmod(F.col("_first"), F.lit(width))
    grid = (
        ends.select(*key, "_first", "_last", F.explode(F.sequence(first_chunk, F.col("_last"), F.lit(width))).alias("_chunk"))
        .repartition(*key, "_chunk")
        .select(*key, "_chunk", F.explode(F.sequence(F.greatest("_first", "_chunk"), F.least("_last", F.col("_chunk") + F.lit(width - step)), F.lit(step))).alias("slot_ns"))
    )
    # the last reading of a chunk, told to the chunk after it
    handed = slots.groupBy(*key, "_chunk").agg(F.max(F.struct("slot_ns", "value")).alias("_handed")).select(*key, (F.col("_chunk") + F.lit(width)).alias("_chunk"), "_handed")
    read = slots.select(*key, "_chunk", "slot_ns", "value", "n_readings")
    full = grid.join(read, [*key, "_chunk", "slot_ns"], "left").join(handed, [*key, "_chunk"], "left")
    upto = Window.partitionBy(*key, "_chunk").orderBy("slot_ns").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("n_readings").isNotNull(), F.struct("slot_ns", "value")), ignorenulls=True).over(upto)
    full = full.withColumn("_seen", F.coalesce(seen, "_handed"))
    near = F.col("slot_ns") - F.col("_seen.slot_ns") <= F.lit(step * max_gap_slots)
    status = F.when(F.col("n_readings").isNotNull(), "read").when(near, "carried").otherwise("missing")
    return full.select(
        *key,
        "slot_ns",
        F.when(status != "missing", F.col("_seen.value")).alias("value"),
        status.alias("status"),
        F.coalesce("n_readings", F.lit(0)).alias("n_readings"),
    )
