import random

import pytest
from pyspark.sql import functions as F

from quern.operators.intervals import interval_gaps
from quern.plans.materialize import broadcast_if_small, materialize
from quern.plans.ranks import ranked
from quern.plans.slices import CUT, SLICE, null_safe_join, slice_hot_groups


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(r.choice(["hot"] * 3 + [None, "cold"]), r.choice([None, r.randrange(40), 7])) for _ in range(2000)]


def test_slices_rise_with_the_order_and_are_bounded(spark, rows):
    df = spark.createDataFrame(rows, "k string, t long").repartition(3)
    got = slice_hot_groups(df, ["k"], "t", 300)
    parts = got.df.groupBy("k", SLICE).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("k", SLICE).collect()
    assert got.hot and sum(r["n"] for r in parts) == len(rows)
    for x, y in zip(parts, parts[1:]):
        if x["k"] == y["k"]:
            assert x["b"] < y["a"]
    again = slice_hot_groups(df.repartition(7), ["k"], "t", 300)
    counted = lambda s: sorted(map(str, s.df.groupBy("k", "t", SLICE).count().collect()))
    assert counted(got) == counted(again)


def test_carried_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, t long").repartition(3)
    got = slice_hot_groups(df, ["k"], "t", 300)
    before = got.carry(s=(F.lit(1), "sum"), m=(F.col("t"), "max")).groupBy("k", SLICE).agg(F.first("s").alias("s"), F.first("m").alias("m")).collect()
    sizes = {(r["k"], r[SLICE]): (r["n"], r["m"]) for r in got.df.groupBy("k", SLICE).agg(F.count("*").alias("n"), F.max("t").alias("m")).collect()}
    for r in before:
        earlier = [v for (k, i), v in sizes.items() if k == r["k"] and i < r[SLICE]]
        assert r["s"] == (sum(n for n, _ in earlier) if earlier else None)
        assert r["m"] == (max(m for _, m in earlier) if earlier else None)
    cold = slice_hot_groups(df, ["k"], "t", 10**6)
    assert not cold.hot and cold.df.filter(f"{SLICE} != 0").count() == 0


@pytest.mark.parametrize("kind", ["double", "int", "decimal(12,2)"])
def test_orders_of_other_types(spark, kind):
    df = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") / 4).cast(kind).alias("t"))
    got = slice_hot_groups(df, ["k"], "t", 10)
    assert got.hot and got.df.groupBy(SLICE).count().agg(F.max("count")).first()[0] <= 2 * 1000 / 16


def test_slices_are_bounded_by_partitions_whatever_the_rows_and_groups(spark):
    # one group holds a third of all rows, 20,000 hold the rest; and a third of the hot one are copies
    n = 600_000
    df = spark.range(n, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000 + 1).alias("k"), F.when(F.col("id") % 9 == 0, 77).otherwise(F.col("id") * 10).alias("a"),
    ).withColumn("b", F.col("a") + 3)
    got = slice_hot_groups(df, ["k"], "a", 100)
    slices = got.df.filter(CUT).groupBy("k", SLICE).agg(F.count_distinct("a").alias("n"))
    assert got.hot and slices.count() <= 2 * 4 * 4 and slices.agg(F.max("n")).first()[0] <= n / 16 * 1.3
    gaps = interval_gaps(df, ["k"], "a", "b", min_rows=100)
    starts = df.groupBy("k").agg(F.count_distinct("a").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    assert gaps.count() == starts and gaps.filter("gap_end - gap_start <= 0").count() == 0


def test_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "k long, w long")
    assert sorted((r["v"], r["w"]) for r in null_safe_join(a, b, ["k"]).collect()) == [("x", 10), ("y", 20)]
    assert materialize(a.limit(0), "empty").count() == 0
    assert broadcast_if_small(a, 5).count() == broadcast_if_small(a, 1).count() == 2
    got = ranked(spark.range(100, 0, -1, 7), ["id"]).orderBy("_rank").collect()
    assert [r["id"] for r in got] == list(range(1, 101)) and [r["_rank"] for r in got] == list(range(100))
