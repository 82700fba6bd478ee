import datetime as dt

from pyspark.sql import functions as F

from quern.llm.followed import follow_durations, followed_states
from quern.llm.percentiles import value_counts
from quern.streaming.spans import SPAN_SCHEMA, span_stream


def test_states_followed_from_files_equal_those_of_the_whole(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    at = dt.datetime(2025, 1, 1)
    rows = [(i, 1, 1, f"c{i % 3}", i, i + i * 7 % 50, at + dt.timedelta(minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, SPAN_SCHEMA)
    for part in (0, 1):
        df.filter(F.col("span_id") % 2 == part).write.mode("append").parquet(source)
        follow_durations(span_stream(spark, source), f"file://{tmp_path}/states", f"file://{tmp_path}/check").awaitTermination()
    got = followed_states(spark, f"file://{tmp_path}/states").select("caller_id", "value", "n")
    want = value_counts(df.filter("end_nanos > start_nanos"), ["caller_id"], F.col("end_nanos") - F.col("start_nanos"), 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
