"""Execution-trace analytics over span logs: bounds, idle gaps, merged segments, totals by caller, relative times.

A span log has ``run_id`` (where many runs lie in one table), ``thread_id``, ``caller_id``, ``start_nanos``, ``end_nanos``. Threads that hold more than a task's share of the
rows are cut into slices (``plans.slices``) of rising start, so no window holds an unbounded thread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.materialize import broadcast_if_small, materialize
from quern.plans.ranks import ranked
from quern.plans.slices import CUT, MIN_ROWS, SLICE, null_safe_join, slice_hot_groups

THREAD = ["run_id", "thread_id"]
IDLE = "__idle__"
#: Rows of a table by run up to which it is broadcast.
MAX_RUNS = 200_000
#: Nanoseconds of a unit of time.
TIME_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def bounds(spans: list[DataFrame], cache: DataFrame | None = None, groups: list[str] | None = None) -> DataFrame:
    """The earliest and latest time over all logs (and cache samples): groups, ``min_ns``, ``max_ns``. Empty logs and nulls are passed over; malformed spans count."""
    groups = groups or []
    parts = [df.groupBy(*groups).agg(F.min("start_nanos").alias("a"), F.max("end_nanos").alias("b")) for df in spans]
    if cache is not None:
        parts.append(cache.groupBy(*groups).agg(F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b")))
    return reduce(DataFrame.unionByName, parts).groupBy(*groups).agg(F.min("a").alias("min_ns"), F.max("b").alias("max_ns"))


def idle_gaps(spans: DataFrame, keys: list[str] = THREAD, ties: list[str] = (), min_rows: int = MIN_ROWS) -> DataFrame:
    """Keys, ``start_ns``, ``duration_ns``: from the end of a well-formed span to the start of the next span of its thread, if that is later.

    The next span may be malformed itself; nothing is idle before the first or after the last span. Spans without key or start have no place in the order;
    those of equal start are ordered by ``ties``, end and caller. Only the last of them can have a gap behind it, so in hot threads they are reduced to it
    before they are shuffled.
    """
    known = spans.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)) & F.col("start_nanos").isNotNull())
    names = [f"_tie{i}" for i in range(len(ties))]
    rows = known.select(*keys, "start_nanos", F.struct(*(F.col(t).alias(n) for t, n in zip(ties, names)), "end_nanos", "caller_id").alias("_place"))
    sliced = slice_hot_groups(rows, keys, "start_nanos", min_rows)
    rows = sliced.df
    if sliced.hot:
        reduced = rows.filter(CUT).groupBy(*keys, SLICE, "start_nanos").agg(F.max("_place").alias("_place")).withColumn(CUT, F.lit(True))
        rows = rows.filter(~F.col(CUT)).unionByName(reduced)
    rows = sliced.carry_after(rows, _later=(F.col("start_nanos"), "min"))
    window = Window.partitionBy(*keys, SLICE).orderBy("start_nanos", "_place")
    rows = rows.withColumn("_next", F.coalesce(F.lead("start_nanos").over(window), F.col("_later"))).withColumn("_end", F.col("_place.end_nanos"))
    rows = rows.filter((F.col("_end") > F.col("start_nanos")) & (F.col("_next") > F.col("_end")))
    return rows.select(*keys, F.col("_end").alias("start_ns"), (F.col("_next") - F.col("_end")).alias("duration_ns"))


def segments(spans: DataFrame, keys: list[str] = THREAD, include_idle: bool = True, ties: list[str] = (), min_rows: int = MIN_ROWS) -> DataFrame:
    """Well-formed spans as keys, ``start_ns``, ``duration_ns``, ``label``, with idle gaps as segments of their own."""
    ok = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)) & (F.col("end_nanos") > F.col("start_nanos"))
    busy = spans.filter(ok).select(*keys, F.col("start_nanos").alias("start_ns"), (F.col("end_nanos") - F.col("start_nanos")).alias("duration_ns"), F.col("caller_id").alias("label"))
    return busy.unionByName(idle_gaps(spans, keys, ties, min_rows).withColumn("label", F.lit(IDLE))) if include_idle else busy


def merge_segments(parts: DataFrame, keys: list[str] = THREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """Back-to-back segments of one label as one: keys, ``label``, ``start_ns``, ``duration_ns``, ``n_segments``. Overlapping ones stay apart; null labels are a label.

    Segments of equal start are ordered by duration and label, and a segment continues one of an earlier start only: of those of one start the first may continue
    the segment before it and the last may be continued; all others stand for themselves and take no part in the windows of hot threads.
    """
    segment = ["start_ns", "duration_ns", "label"]
    sliced = slice_hot_groups(parts.select(*keys, *segment), keys, "start_ns", min_rows)
    rows, alone = sliced.df, None
    if sliced.hot:
        hot = rows.filter(CUT)
        place = F.struct("duration_ns", "label")
        ends = hot.groupBy(*keys, SLICE, "start_ns").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n"))
        edges = ends.select(*keys, SLICE, "start_ns", F.explode(F.when(F.col("_n") > 1, F.array("_first", "_last")).otherwise(F.array("_first"))).alias("_e"))
        edges = edges.select(*keys, *segment[:1], "_e.duration_ns", "_e.label", SLICE)
        # rows less those edges, copies counted: summed by all columns, so neither copies nor ties pile up
        alone = hot.select(*keys, *segment, SLICE).exceptAll(edges).select(*keys, "label", "start_ns", "duration_ns", F.lit(1).cast("long").alias("n_segments"))
        rows = rows.filter(~F.col(CUT)).unionByName(edges.withColumn(CUT, F.lit(True)))
    last = F.struct(*segment)
    rows = sliced.carry(rows, _last=(last, "max"))
    window = Window.partitionBy(*keys, SLICE).orderBy(*segment)
    rows = rows.withColumn("_prev", F.coalesce(F.lag(last).over(window), F.col("_last")))
    follows = (F.col("_prev.start_ns") < F.col("start_ns")) & (F.col("_prev.start_ns") + F.col("_prev.duration_ns") == F.col("start_ns")) & F.col("_prev.label").eqNullSafe(F.col("label"))
    rows = rows.withColumn("_opens", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_island", F.sum("_opens").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, SLICE, "_island").agg(F.min("start_ns").alias("start_ns"), F.sum("duration_ns").alias("duration_ns"), F.first("label").alias("label"), F.count("*").alias("n_segments"), F.first(CUT).alias(CUT))
    columns = [*keys, "label", "start_ns", "duration_ns", "n_segments"]
    if alone is None:
        return pieces.select(*columns)
    # the first piece of a slice may continue the last island of a slice before it
    tails = pieces.filter(F.col(CUT)).groupBy(*keys, SLICE).agg(F.max(F.when(F.col("_island") > 0, F.struct(F.col(SLICE).alias("s"), F.col("_island").alias("n")))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, SLICE, F.last("_end", ignorenulls=True).over(before).alias("_begun"))
    whole = null_safe_join(pieces, F.broadcast(tails), [*keys, SLICE])  # a row a slice
    home = F.when((F.col("_island") == 0) & F.col("_begun").isNotNull(), F.col("_begun")).otherwise(F.struct(F.col(SLICE).alias("s"), F.col("_island").alias("n")))
    merged = whole.groupBy(*keys, home.alias("_home")).agg(F.min("start_ns").alias("start_ns"), F.sum("duration_ns").alias("duration_ns"), F.first("label").alias("label"), F.sum("n_segments").alias("n_segments"))
    return merged.select(*columns).unionByName(alone.select(*columns))


def caller_totals(spans: DataFrame, least_ns: int = 20_000_000) -> DataFrame:
    """``caller_id``, ``total_ns`` of the well-formed spans, of callers with at least ``least_ns``."""
    well = spans.filter(F.col("end_nanos") > F.col("start_nanos"))
    return well.groupBy("caller_id").agg(F.sum(F.col("end_nanos") - F.col("start_nanos")).alias("total_ns")).filter(F.col("total_ns") >= least_ns)


def thread_counts(spans: DataFrame, groups: list[str]) -> DataFrame:
    return spans.groupBy(*groups).agg(F.count_distinct("thread_id").alias("n_threads"))


def relative_times(spans: DataFrame, span_bounds: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Well-formed spans with ``start_rel`` and ``duration_rel`` in ``unit`` since their run's first time. ``span_bounds``: keys, ``min_ns``.

    A run may hold a tenth of all spans: up to ``MAX_RUNS`` bounds are broadcast, so no span moves; beyond that a sort-merge join, whose large partitions AQE splits.
    """
    if unit not in TIME_UNITS:
        raise ValueError(f"unknown unit {unit}")
    first = broadcast_if_small(materialize(span_bounds.select(*keys, "min_ns"), "run-bounds"), MAX_RUNS)
    joined = spans.filter(F.col("end_nanos") > F.col("start_nanos")).join(first, keys)
    scale = F.lit(float(TIME_UNITS[unit]))
    return joined.withColumns({"start_rel": (F.col("start_nanos") - F.col("min_ns")) / scale, "duration_rel": (F.col("end_nanos") - F.col("start_nanos")) / scale})


def caller_index(spans: DataFrame, colours: int = 20) -> DataFrame:
    """``caller_id``, ``idx`` (0-based rank by name) and ``colour`` (idx mod ``colours``). Null callers have no colour.

    Ranks come from a range sort: callers are range-partitioned by name, and each partition's ranks start after the callers before it.
    """
    names = spans.select("caller_id").filter("caller_id is not null").distinct()
    return ranked(names, ["caller_id"]).select("caller_id", F.col("_rank").alias("idx"), (F.col("_rank") % colours).alias("colour"))


def cache_series(samples: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Cache samples as they are drawn: nulls of optional sizes are 0, times are seconds since the run's first sample, and with ``settings`` the run's limits come along."""
    first = broadcast_if_small(materialize(samples.groupBy("run_id").agg(F.min("timestamp_ns").alias("_first")), "run-starts"), MAX_RUNS)
    rows = samples.filter("run_id is not null and timestamp_ns is not null").join(first, "run_id")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("scheduled_eviction_size", "cache_size", "pinned_size", "read_reserved_size")]
    rows = rows.select("run_id", "reading_id", "timestamp_ns", ((F.col("timestamp_ns") - F.col("_first")) / 1e9).alias("seconds"), *zero)
    if settings is None:
        return rows
    limits = settings.select("run_id", F.col("cache_eviction_limit").alias("soft_limit"), F.col("cache_hard_limit").alias("hard_limit"))
    return rows.join(broadcast_if_small(limits, MAX_RUNS), "run_id", "left")
