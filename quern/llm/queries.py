"""The queries of this package, each over its whole tables. Where plain SQL can't say the same, tests/llm holds them against brute force."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.encodings import find_garbled, restore_documents
from quern.llm.mixing import mix_sources, source_name
from quern.llm.percentiles import merge_states, percentiles, percentiles_of_states, value_counts
from quern.llm.tokens import Merges, count_tokens, encode_corpus


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PERCENTS = [1, 10, 25, 50, 75, 90, 99]
BITS = 8


def _durations(spark: SparkSession, folder: str) -> DataFrame:
    """Durations of the well-formed spans by arrival day; rows count as they stand."""
    log = _table(spark, folder, "compute_event_log").filter("end_nanos > start_nanos")
    return log.select("caller_id", F.to_date("logged_at").alias("day"), (F.col("end_nanos") - F.col("start_nanos")).alias("duration"))


def _day_states(spark: SparkSession, folder: str) -> DataFrame:
    return value_counts(_durations(spark, folder), ["day", "caller_id"], F.col("duration"), BITS)


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of span durations by caller, put together from the states of the arrival days."""
    return percentiles_of_states(merge_states(_day_states(spark, folder), ["caller_id"]), ["caller_id"], PERCENTS)


def p1_day_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles_of_states(_day_states(spark, folder), ["day", "caller_id"], [50, 90])


def p1_exact_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles(_durations(spark, folder), ["caller_id"], F.col("duration"), PERCENTS, bits=None)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_table(spark, folder, "documents"))


def p6_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes that each document's ids stand for, which are those of its text."""
    merges = spark.sparkContext.broadcast(Merges.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = merges.value.sizes()
        for batch in batches:
            ids, ends = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(1).offsets, dtype=np.int64)
            upto = np.concatenate([[0], np.cumsum(size[ids])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]])], names=["doc_id", "n_bytes"])

    return encode_corpus(_table(spark, folder, "documents")).mapInArrow(run, "doc_id long, n_bytes long")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each source whether the mix keeps the cap on its repeats, and meets the target (among the sources that have tokens) by the tokens of one document."""
    chosen, report = mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))
    most = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"))
    sums = report.agg(F.sum("tokens_chosen").alias("all_tokens"), F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).alias("all_shares"))  # one row
    rows = report.join(most, "source", "left").crossJoin(F.broadcast(sums))
    goal = F.when(F.col("n_tokens") > 0, F.col("target_share") / F.col("all_shares") * F.col("all_tokens")).otherwise(0.0)
    cap_kept = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    return rows.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", "n_docs", cap_kept.alias("cap_kept"), (F.abs(F.col("tokens_chosen") - goal) <= F.coalesce("longest", F.lit(0))).alias("target_met"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = find_garbled(_table(spark, folder, "documents"), source=source_name(F.col("source")))
    return found.select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    source = source_name(F.col("source"))
    _, model = find_garbled(documents, source=source)
    return restore_documents(documents, "doc_id", "text", source, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_percentiles, p1_day_percentiles, p1_exact_percentiles, p6_ids, p6_token_counts, p6_bytes, p7_mix, p7_shares, p7_kept, p8_found, p8_restored)}


def _picked(states: str, keys: str, percents: list[int]) -> str:
    picks = ", ".join(f"min(value) filter (where upto >= greatest(ceil(total * {p} / 100), 1)) as p{p}" for p in percents)
    return f"""
        runs as (select {keys}, value, n, sum(n) over (partition by {keys} order by value) as upto, sum(n) over (partition by {keys}) as total from {states})
        select {keys}, max(total)::bigint as n, {picks} from runs group by {keys}"""


_SPANS = "select caller_id, logged_at, end_nanos - start_nanos as d from compute_event_log where end_nanos > start_nanos"
_BUCKETS = f"""cut as (select *, greatest(length(bin(d)) - 1 - {BITS}, 0) as k from ({_SPANS})),
        mids as (select *, ((d >> k) << k) + ((1::bigint << k) >> 1) as value from cut)"""


_NAMED = "lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p6_bytes": "select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes from documents",
        "p7_kept": f"""with docs as (select {_NAMED} as source, count(*) as n_docs from documents group by all),
            goals as (select {_NAMED} as source, sum(target_share) as target_share, min(max_repeats)::bigint as max_repeats from mix_targets group by all)
            select source, round(coalesce(target_share, 0), 9) as target_share, max_repeats, coalesce(n_docs, 0) as n_docs, true as cap_kept, true as target_met from docs full join goals using (source)""",
        "p1_percentiles": f"with {_BUCKETS}, states as (select caller_id, value, count(*) as n from mids group by all), {_picked('states', 'caller_id', PERCENTS)}",
        "p1_day_percentiles": f"with {_BUCKETS}, states as (select logged_at::date as day, caller_id, value, count(*) as n from mids group by all), {_picked('states', 'day, caller_id', [50, 90])}",
        "p1_exact_percentiles": f"with states as (select caller_id, d as value, count(*) as n from ({_SPANS}) group by all), {_picked('states', 'caller_id', PERCENTS)}",
    }
