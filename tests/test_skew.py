import random
from collections import Counter

from pyspark.sql import functions as F

from quern.operators import skew
from quern.operators.skew import TASK, fragment, fragment_replicate_join, keyed_totals, large_keys, plan_loads

from quern.queries.training import slow_spans_joined

FOLDER = "/root/testdata/sf0.01"


def data(spark, seed=1, n=4000):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 5 + [None] + [f"k{r.randrange(200)}"] * 4), r.choice([None, r.randrange(100)]), "x") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v long, _load string").repartition(5)


def test_totals_are_complete(spark):
    rows, df = data(spark)
    got = {r["k"]: (r["n_rows"], r["s"]) for r in keyed_totals(df, ["k"], {"s": F.col("v")}, tasks=8).collect()}
    n, s = Counter(), Counter()
    for k, v, _ in rows:
        n[k] += 1
        s[k] += v or 0
    assert got == {k: (n[k], s[k]) for k in n}


def test_no_task_gets_much_more_than_its_share(spark):
    rows, df = data(spark, 2)
    plan = plan_loads(df, ["k"], 8)
    assert sum(plan.loads) >= 0.98 * len(rows) and max(plan.loads) <= 1.2 * len(rows) / 8
    moved = fragment(df, plan)
    sizes = moved.groupBy(F.spark_partition_id().alias("p"), TASK).count().collect()
    assert all(r["p"] == r[TASK] for r in sizes) and sum(r["count"] for r in sizes) == len(rows)
    assert max(r["count"] for r in sizes) <= 1.2 * len(rows) / 8


def test_rows_of_the_registered_query_are_joined_where_the_plan_puts_them(spark):
    joined = slow_spans_joined(spark, FOLDER)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 2 and "SortMergeJoin" in plan and "hashpartitioning(coalesce" not in plan
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.2 * sum(sizes) / 4


def test_loads_estimated_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(skew, "SAMPLE_ROWS", 3000)
    monkeypatch.setattr(skew, "SAMPLE_PER_SHARE", 1)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "copies").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    plan = plan_loads(df, ["k"], 8)
    assert plan.total == 60_000 and plan.n_hot == 1
    sizes = [r["count"] for r in fragment(df, plan).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 1.2 * 60_000 / 8
    assert {r["k"]: r["n_rows"] for r in keyed_totals(df, ["k"], {}, plan=plan).collect()}["copies"] == 40_000


def test_join_loses_and_doubles_nothing(spark):
    rows, df = data(spark, 3)
    keys = sorted({k for k, *_ in rows if k is not None})[::2] + ["hot", None]
    right = [(k, i) for i, k in enumerate(dict.fromkeys(keys))] + [("hot", 999)]
    b = spark.createDataFrame(right, "k string, w long")
    for how in ("left", "inner"):
        got = Counter((r["k"], r["v"], r["w"]) for r in fragment_replicate_join(df, b, ["k"], tasks=8, how=how).collect())
        want = Counter()
        for k, v, _ in rows:
            hits = [w for q, w in right if q == k]
            for w in hits or ([None] if how == "left" else []):
                want[k, v, w] += 1
        assert got == want


def test_large_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "k string")
    assert [r["k"] for r in large_keys(df, ["k"], 0.05).collect()] == ["a"]
    empty = spark.createDataFrame([], "k string, v long")
    assert large_keys(empty, ["k"], 0.05).count() == 0
    assert keyed_totals(empty, ["k"], {"s": F.col("v")}).count() == 0
    other = spark.createDataFrame([("a", 1)], "k string, w long")
    assert fragment_replicate_join(empty, other, ["k"]).count() == 0
    assert fragment_replicate_join(other, spark.createDataFrame([], "k string, z long"), ["k"]).collect()[0]["z"] is None


def test_clashing_columns_are_renamed(spark):
    a = spark.createDataFrame([("x", 1, 7)], "k string, v long, _task int")
    b = spark.createDataFrame([("x", 2, 8)], "k string, v long, _task int")
    got = fragment_replicate_join(a, b, ["k"]).collect()[0].asDict()
    assert got == {"k": "x", "v": 1, "_task": 7, "v_right": 2, "_task_right": 8}
