import datetime as dt

from quern.streaming.spans import SPAN_SCHEMA, span_stream, windowed_totals


def test_windowed_totals_of_a_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    at = dt.datetime(2025, 1, 1)
    rows = [(i, 1, 1, f"c{i % 3}", i, i + i * 7 % 50, at + dt.timedelta(minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, SPAN_SCHEMA)
    df.write.parquet(source)
    query = windowed_totals(span_stream(spark, source)).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n_spans) from totals").first()[0] == df.filter("end_nanos > start_nanos").count()
