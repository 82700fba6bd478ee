import math

import pytest
from pyspark.sql import functions as F

from quern.functions import numeric

NAN, INF = float("nan"), float("inf")


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


def test_division_is_ieee(spark):
    pairs = [(a, b) for a in (0.0, 1.0, -1.0, NAN, INF, None) for b in (0.0, 2.0, 3.0, NAN, INF, None)]
    df = spark.createDataFrame(pairs, "a double, b double")
    for a, b, q in df.select("a", "b", numeric.ieee_div(F.col("a"), F.col("b"))).collect():
        if a is None or b is None:
            want = None
        elif math.isnan(a) or math.isnan(b):
            want = NAN
        elif b == 0:
            want = NAN if a == 0 else math.copysign(INF, a)
        else:
            want = NAN if math.isinf(a) and math.isinf(b) else a / b
        assert same(q, want), (a, b, q)


def test_ceil_and_floor_keep_large_values_and_nan(spark):
    values = [1.2, -1.2, 0.0, 1e300, -1e300, 2.0**53, NAN, INF, -INF, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, up, down in df.select("v", numeric.ceil(F.col("v")), numeric.floor(F.col("v"))).collect():
        whole = v is not None and abs(v) < 1e6
        assert same(up, float(math.ceil(v)) if whole else v) and same(down, float(math.floor(v)) if whole else v)


def test_comparisons_and_clamp(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (NAN, NAN), (1.0, NAN), (None, 1.0)], "a double, b double")
    got = df.select(numeric.less(F.col("a"), F.col("b")), numeric.less_equal(F.col("a"), F.col("b")), numeric.clamp(F.col("a"), F.lit(1.5), F.lit(1.8))).collect()
    assert [r[0] for r in got] == [1, 0, 0, 0, 0] and [r[1] for r in got] == [1, 1, 0, 0, 0]
    assert got[0][2] == 1.5 and got[1][2] == 1.8 and math.isnan(got[2][2]) and got[4][2] is None


def test_loops_are_one_expression(spark):
    df = spark.createDataFrame([(16.0,), (-16.0,)], "v double")
    assert [r[0] for r in df.select(numeric.repeated_abs(F.col("v"), 300)).collect()] == [16.0, 16.0]
    assert df.select(numeric.repeated_sqrt(F.col("v"), 2)).first()[0] == 2.0
    assert df.select(numeric.repeated(F.col("v"), 0, F.sqrt)).first()[0] == 16.0
    assert df.select(numeric.repeated_sqrt(F.col("v"), 1000)).first()[0] == pytest.approx(1.0)


def test_hash_random_ignores_partitions(spark):
    one = spark.range(0, 5000, 1, 1).select("id", numeric.hash_uniform(7, F.col("id")).alias("u"), numeric.hash_normal(7, F.col("id")).alias("z"))
    many = spark.range(0, 5000, 1, 9).select("id", numeric.hash_uniform(7, F.col("id")).alias("u"), numeric.hash_normal(7, F.col("id")).alias("z"))
    assert one.orderBy("id").collect() == many.orderBy("id").collect()
    m = one.agg(F.avg("u"), F.stddev("u"), F.avg("z"), F.stddev("z")).first()
    assert m[0] == pytest.approx(0.5, abs=0.02) and m[1] == pytest.approx(12**-0.5, abs=0.01) and m[2] == pytest.approx(0, abs=0.05) and m[3] == pytest.approx(1, abs=0.05)
