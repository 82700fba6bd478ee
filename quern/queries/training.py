"""Queries of the core's training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import interval_gaps, merge_intervals
from quern.operators.regular_grid import regular_grid
from quern.operators.skew import fragment_replicate_join, keyed_totals, large_keys
from quern.operators.units import SECONDS, recorded_units
from quern.sources.tables import table

STEP_NS = 100_000_000
MAX_GAP_SLOTS = 20
THREAD = ["run_id", "thread_id"]


LOGS = ["compute_event_log", "disk_read_event_log"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    each = [large_keys(table(spark, folder, log).select("caller_id"), ["caller_id"], 0.05).select(F.lit(log).alias("log_name"), "caller_id") for log in LOGS]
    return each[0].unionByName(each[1])


def _busy() -> Column:
    return F.when(F.col("end_nanos") > F.col("start_nanos"), F.col("end_nanos") - F.col("start_nanos"))


def p2_caller_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and busy time of every caller of both logs, null callers too."""
    each = [keyed_totals(table(spark, folder, log), ["caller_id"], {"busy_ns": _busy()}).select(F.lit(log).alias("log_name"), "caller_id", "n_rows", "busy_ns") for log in LOGS]
    return each[0].unionByName(each[1])


def _durations_by_caller(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "compute_event_log").filter("end_nanos > start_nanos").select("caller_id", (F.col("end_nanos") - F.col("start_nanos")).alias("duration"))


def slow_spans_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Each well-formed span with its caller's mean duration."""
    log = _durations_by_caller(spark, folder)
    profile = keyed_totals(log, ["caller_id"], {"busy": F.col("duration")}).select("caller_id", F.floor(F.col("busy") / F.col("n_rows")).alias("mean_ns"))
    return fragment_replicate_join(log, profile, ["caller_id"], how="inner")


def p2_slow_spans(spark: SparkSession, folder: str) -> DataFrame:
    """By caller, the spans that took more than twice the caller's mean: every row meets its caller's profile in a fragment-replicate join."""
    slow = F.col("duration") > 2 * F.col("mean_ns")
    return slow_spans_joined(spark, folder).groupBy("caller_id").agg(F.first("mean_ns").alias("mean_ns"), F.count("*").alias("n_spans"), F.sum(slow.cast("long")).alias("n_slow"))


def p2_spans_with_reads(spark: SparkSession, folder: str) -> DataFrame:
    """By caller, the spans that are shorter than the caller's mean disk read, and callers that read nothing: the matching side has a row for each caller of the other log, however many these are."""
    reads = keyed_totals(table(spark, folder, "disk_read_event_log"), ["caller_id"], {"read_ns": _busy(), "read_bytes": F.col("num_bytes")})
    reads = reads.select("caller_id", F.col("n_rows").alias("n_reads"), "read_ns", "read_bytes")
    joined = fragment_replicate_join(_durations_by_caller(spark, folder), reads, ["caller_id"])
    short = F.coalesce(F.col("duration") * F.col("n_reads") < F.col("read_ns"), F.lit(False))
    return joined.groupBy("caller_id").agg(
        F.coalesce(F.first("n_reads"), F.lit(0)).alias("n_reads"), F.coalesce(F.first("read_bytes"), F.lit(0)).alias("read_bytes"), F.count("*").alias("n_spans"), F.sum(short.cast("long")).alias("n_short")
    )


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return recorded_units(spark, *(table(spark, folder, t) for t in ("results", "scheduling_results", "results_blen_primitive_chain", "result_sources")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).filter("unit != heading").select("tbl", "record_id", "unit")


def p3_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Every recorded time in seconds, with the unit it was recorded in."""
    return _units(spark, folder).select("tbl", "record_id", "unit", "seconds")


def p3_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every number of results and of the block length runs comes out once, and seconds are its value in the unit said."""
    rows = _units(spark, folder).filter("tbl != 'scheduling_results'")
    factor = F.create_map(*(F.lit(x) for pair in SECONDS.items() for x in pair))
    right = F.abs(F.col("seconds") - F.col("value") * F.element_at(factor, F.col("unit"))) <= 1e-12 * F.abs("seconds")
    return rows.groupBy("tbl").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_records"), F.round(F.sum("value"), 3).alias("sum_written"), (F.sum((~right).cast("int")) == 0).alias("converted"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return interval_gaps(table(spark, folder, "compute_event_log"), THREAD)


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    return merge_intervals(table(spark, folder, "compute_event_log"), THREAD)


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "cache_size_event_log")
    return regular_grid(log, "run_id", "timestamp_ns", ["cache_size", "pinned_size"], STEP_NS, ["logged_at", "reading_id"], F.col("value") >= 0, MAX_GAP_SLOTS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).filter("status != 'read'").select("run_id", "metric", "slot_ns")


def p5_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)


QUERIES = [p2_found, p2_caller_totals, p2_slow_spans, p2_spans_with_reads, p3_found, p3_seconds, p3_complete, p4_found, p4_periods, p5_found, p5_grid]


_ROWS = "select caller_id, end_nanos - start_nanos as d from compute_event_log where end_nanos > start_nanos"
_GRID = """readings as (
            select run_id, 'cache_size' as metric, timestamp_ns as t, cache_size as value, logged_at, reading_id from cache_size_event_log
            union all select run_id, 'pinned_size', timestamp_ns, pinned_size, logged_at, reading_id from cache_size_event_log),
        usable as (select *, t - t % 100000000 as slot_ns from readings where run_id is not null and t is not null and value >= 0),
        slots as (select run_id, metric, slot_ns, count(*) as n_readings,
                         arg_max(value, row(t, logged_at, reading_id, value)) as value from usable group by all),
        ends as (select run_id, metric, min(slot_ns) as a, max(slot_ns) as b from slots group by all),
        grid as (select run_id, metric, unnest(generate_series(a, b, 100000000)) as slot_ns from ends),
        filled as (select g.run_id, g.metric, g.slot_ns, s.n_readings, last_value(s.value ignore nulls) over w as seen,
                          last_value(s.slot_ns ignore nulls) over w as seen_at
                   from grid g left join slots s using (run_id, metric, slot_ns)
                   window w as (partition by g.run_id, g.metric order by g.slot_ns rows between unbounded preceding and current row))"""

ORACLE = {
    "p2_found": " union all ".join(f"select '{log}' as log_name, caller_id from {log} where caller_id is not null group by caller_id having count(*) >= 0.05 * (select count(*) from {log})" for log in LOGS),
    "p2_caller_totals": " union all ".join(
        f"select '{log}' as log_name, caller_id, count(*) as n_rows, coalesce(sum(end_nanos - start_nanos) filter (where end_nanos > start_nanos), 0)::bigint as busy_ns from {log} group by caller_id" for log in LOGS
    ),
    "p2_slow_spans": f"""with spans as ({_ROWS}), means as (select *, floor(avg(d) over (partition by caller_id))::bigint as mean_ns from spans)
        select caller_id, mean_ns, count(*) as n_spans, count(*) filter (where d > 2 * mean_ns) as n_slow from means group by caller_id, mean_ns""",
    "p2_spans_with_reads": f"""with spans as ({_ROWS}), reads as (select caller_id, count(*) as n_reads, coalesce(sum(num_bytes), 0)::bigint as read_bytes,
            coalesce(sum(end_nanos - start_nanos) filter (where end_nanos > start_nanos), 0) as read_ns from disk_read_event_log group by caller_id)
        select s.caller_id, coalesce(max(n_reads), 0) as n_reads, coalesce(max(read_bytes), 0) as read_bytes, count(*) as n_spans,
            count(*) filter (where d * n_reads < read_ns) as n_short from spans s left join reads r on s.caller_id is not distinct from r.caller_id group by s.caller_id""",
    "p3_complete": """with r as (select 'results' as tbl, record_id, rep1 as v from results where rep1 is not null and not isnan(rep1)
            union all select 'results_blen_primitive_chain', record_id, time_ms::double from results_blen_primitive_chain where time_ms is not null)
        select tbl, count(*) as n, count(distinct record_id) as n_records, round(sum(v), 3) as sum_written, true as converted from r group by tbl""",
    "p4_found": """with spans as (select run_id, thread_id, start_nanos as s, end_nanos as e from compute_event_log
                                  where run_id is not null and thread_id is not null and end_nanos > start_nanos),
        reached as (select *, max(e) over (partition by run_id, thread_id order by s rows between unbounded preceding and 1 preceding) as r from spans)
        select run_id, thread_id, r as gap_start, s as gap_end from reached where s > r""",
    "p4_periods": """with spans as (select run_id, thread_id, start_nanos as s, end_nanos as e from compute_event_log
                                    where run_id is not null and thread_id is not null and end_nanos > start_nanos),
        reached as (select *, max(e) over (partition by run_id, thread_id order by s rows between unbounded preceding and 1 preceding) as r from spans),
        numbered as (select *, sum((r is null or s > r)::int) over (partition by run_id, thread_id order by s rows unbounded preceding) as island from reached)
        select run_id, thread_id, min(s) as period_start, max(e) as period_end, count(*) as n_spans from numbered group by run_id, thread_id, island""",
    "p5_found": f"with {_GRID} select run_id, metric, slot_ns from filled where n_readings is null",
    "p5_grid": f"""with {_GRID} select run_id, metric, slot_ns, case when slot_ns - seen_at <= {MAX_GAP_SLOTS} * 100000000 then seen end as value,
        case when n_readings is not null then 'read' when slot_ns - seen_at <= {MAX_GAP_SLOTS} * 100000000 then 'carried' else 'missing' end as status,
        coalesce(n_readings, 0) as n_readings from filled""",
}
