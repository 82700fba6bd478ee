import math
import random

import pytest
from pyspark.sql import functions as F

from quern.llm.percentiles import fraction_bucket, merge_states, percentiles, percentiles_of_states, value_bucket, value_counts

PERCENTS = [0, 1, 50, 90, 100]


def exact(values):
    values = sorted(values)
    return tuple(values[max(math.ceil(len(values) * p / 100), 1) - 1] for p in PERCENTS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 7, 7, r.randrange(10**10), -r.randrange(10**6)]), r.randrange(3), "clash") for _ in range(3000)]
    return out + [("c", None, 0, ""), ("d", 5, 1, "")]


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,3)"])
def test_exact_percentiles_also_of_groups_over_several_partitions(spark, rows, kind):
    df = spark.createDataFrame(rows, "g string, v long, day int, n string").withColumn("v", F.col("v").cast(kind) / (1 if kind == "bigint" else 8)).withColumn("v", F.col("v").cast(kind))
    got = {r["g"]: (r["n"], tuple(r[f"p{p}"] for p in PERCENTS)) for r in percentiles(df, ["g"], F.col("v"), PERCENTS, None).collect()}
    by = {}
    for r in df.collect():
        if r["v"] is not None:
            by.setdefault(r["g"], []).append(r["v"])
    assert got == {g: (len(v), exact(v)) for g, v in by.items()}


def test_days_read_apart_add_up_within_the_error(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "g string, v long, day int, n string")
    df.write.partitionBy("day").parquet(f"file://{tmp_path}/log")
    whole = percentiles(df, ["g"], F.col("v"), PERCENTS, 6).orderBy("g").collect()
    days = [value_counts(spark.read.parquet(f"file://{tmp_path}/log/day={d}"), ["g"], F.col("v"), 6) for d in range(3)]
    put = merge_states(days[2].unionByName(days[0]).unionByName(days[1]), ["g"])
    assert percentiles_of_states(put, ["g"], PERCENTS).orderBy("g").collect() == whole
    truth = {r["g"]: r for r in percentiles(df, ["g"], F.col("v"), PERCENTS, None).collect()}
    for r in whole:
        assert r["n"] == truth[r["g"]]["n"]
        for p in PERCENTS:
            t = truth[r["g"]][f"p{p}"]
            assert abs(r[f"p{p}"] - t) <= abs(t) / 2**7


def test_fractions_keep_the_error(spark):
    r = random.Random(2)
    values = [r.choice([-1, 1]) * r.random() * 10.0 ** r.randrange(-250, 250) for _ in range(400)] + [0.25, 0.5, 1.0, 2.0, -4.0, 1 / 3]
    odd = [0.0, -0.0, float("inf"), -float("inf"), 1e-300, float("nan"), None]
    got = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values + odd)], "i int, v double").orderBy("i").select(fraction_bucket(F.col("v"), 8)).collect()]
    assert all(abs(b - v) <= abs(v) / 2**9 * 1.0001 for v, b in zip(values, got))
    assert got[len(values) :] == [0.0, 0.0, float("inf"), -float("inf"), 0.0, None, None]
    hundredths = spark.range(1, 100).select(F.lit("a").alias("g"), (F.col("id") / 100).alias("v"))
    p = percentiles(hundredths, ["g"], F.col("v"), [1, 50, 99]).first()
    assert p["n"] == 99 and abs(p["p1"] - 0.01) < 1e-4 and abs(p["p50"] - 0.5) < 2e-3 and abs(p["p99"] - 0.99) < 4e-3
    with pytest.raises(TypeError):
        percentiles(spark.createDataFrame([("a", "b")], "g string, v string"), ["g"], F.col("v"), [50])


def test_a_group_of_copies_and_one_over_all_partitions(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "copies").when(F.col("id") % 3 == 1, "wide").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    got = {r["g"]: r for r in percentiles(df, ["g"], F.col("v"), [50], None).collect()}
    assert got["copies"]["p50"] == 7 and got["copies"]["n"] == 3000 and got["wide"]["n"] == 3000 and got["wide"]["p50"] == 4498 and len(got) == 102


def test_buckets_at_powers_of_two_and_signs(spark):
    values = [0, 1, -1, 255, 256, 2**40 - 1, 2**40, 2**40 + 1, 2**53 - 1, 2**62, -(2**62), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(value_bucket(F.col("v"), 8)).collect()]
    for v, b in zip(values, got):
        if v is None:
            assert b is None
            continue
        drop = max(abs(v).bit_length() - 1 - 8, 0)
        size = (abs(v) >> drop << drop) + ((1 << drop) >> 1)
        assert b == (size if v >= 0 else -size)


def test_empty_table(spark):
    for bits in (None, 8):
        assert percentiles(spark.createDataFrame([], "g string, v long"), ["g"], F.col("v"), [50], bits).count() == 0
