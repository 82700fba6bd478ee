import math

import pytest
from pyspark.sql import functions as F

from quern.functions import labels
from quern.operators import results


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_memory_texts(spark):
    assert one(spark, labels.conf_bytes, "8 gib heap", "x|16 MB", "1.5.2", "run -Xmx 2g of 64g", "-xmx", "heap of 3 kilos") == [8 * 2**30, 16 * 2**20, None, 2 * 2**30, None, 3]
    confs = ["java -Xmx4g -jar", "-xmx512MiB", "2g", "1.5t", "100 k", "64", "cfg12", "auto", "", None, "a 3g b 4g"]
    assert one(spark, labels.conf_bytes, *confs) == [4 * 2**30, 512 * 2**20, 2 * 2**30, 1.5 * 2**40, 100 * 1024, 64, None, None, None, None, 3 * 2**30]
    assert one(spark, labels.heap_megabytes, "java -Xmx4g -jar", "-Xmx512m", "-Xmx2048k", "none", None) == [4096, 512, 2, 1024, 1024]
    assert one(spark, labels.value_megabytes, "4g", "512", "512m", "2048k", "x", None) == [4096, 512, 512, 2, None, None]


def test_names(spark):
    assert one(spark, labels.experiment_title, "kmeans_warm", "pca", "right__index", "_", None) == ["K-MEANS Warm", "PCA", "RIGHT INDEX", "_", None]
    assert one(spark, labels.setup_label, "abs_100x_[100M_x_1]", "sqrt", "_") == ["ABS\n100 x [100M x 1]", "SQRT", "_"]
    n = [1_000_000, 1000, 1500, 2_000_000_000, 999, 0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(labels.dimension(F.col("n"))).collect()] == ["1M", "1k", "1500", "2B", "999", "0"]
    assert one(spark, labels.script_dimensions, "run_args=( 10000 1000000 1.0 )", "x") == ["10k x 1M", None]
    assert labels.setup_dimensions('read("../../data/blobs/8gb_X")', 'blob_base="data/blobs/8gb"\nrun -args 4000000 256 32 1.0 0.1 7 "$blob_base"') == "4M x 256"
    assert labels.setup_dimensions("", "") is None and labels.setup_dimensions('read("../../data/blobs/8gb_X")', 'b="data/blobs/8gb" -args 12') is None
    assert one(spark, labels.script_dimensions, "run_args=(10000)", "run_args=()", "run_args=( 1500 3 )", None) == [None, None, "1500 x 3", None]


def test_metrics(spark):
    text = "took 1.5 then\ntook\t-2.5e-3 s"
    assert one(spark, lambda c: labels.last_metric(c, "took"), text, "took x", "", None) == [-2.5e-3, None, None, None]
    assert one(spark, lambda c: labels.run_status(c, "Error|Failed"), "an Error", "fine", "", None) == ["failed", "ok", "ok", "failed"]
    got = one(spark, labels.as_float, "1.5", "NaN", "", " nan ", "x", None)
    assert got[0] == 1.5 and all(math.isnan(v) for v in got[1:])


def test_orders(spark):
    df = spark.createDataFrame([(5, "10g"), (1, "auto"), (2, "512m"), (3, "10240m"), (4, "what"), (6, "512m"), (7, None)], "pos int, conf string")
    assert [r["conf"] for r in results.conf_order(df, "conf", "pos").orderBy("place").collect()] == ["512m", "10240m", "10g", "auto", "what"]
    assert [r["conf"] for r in results.ordered_unique(df, "conf", "pos").orderBy("place").collect()] == ["auto", "512m", "10240m", "what", "10g"]


def test_grids(spark):
    df = spark.createDataFrame([("cp", "1g", 1.0), ("cp", "2g", None), ("ooc", "1g", 3.0), (None, "1g", 9.0)], "mode string, conf string, rep1 double")
    got = {(r["mode"], r["conf"]): r["value"] for r in results.result_grid(df, "mode", "conf", F.col("rep1")).collect()}
    assert got["cp", "1g"] == 1 and got["ooc", "1g"] == 3 and math.isnan(got["cp", "2g"]) and math.isnan(got["ooc", "2g"]) and len(got) == 4
    with pytest.raises(results.DuplicateResult):
        results.result_grid(df.union(df), "mode", "conf", F.col("rep1"))
    with pytest.raises(results.MissingResult):
        results.result_grid(df, "mode", "conf", F.col("rep1"), strict=True)
    wide = results.pivoted(results.result_grid(df, "mode", "conf", F.col("rep1")), ["mode"], "conf", ["1g", "2g"]).orderBy("mode").collect()
    assert [r["1g"] for r in wide] == [1.0, 3.0]
    newest = results.latest(spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 2.0)], "k string, at int, v double"), ["k"], ["at"], ["v"])
    assert {r["k"]: r["v"] for r in newest.collect()} == {"a": None, "b": 2.0}


def test_rows_of_results_in_order_of_size(spark):
    df = spark.createDataFrame([("a", "cp", "10g", 1, 1.5), ("a", "cp", "512m", 2, float("nan")), ("a", "ooc", "auto", 3, 2.0), ("b", "cp", "1g", 4, None), ("b", None, "1g", 5, 1.0)], "e string, m string, c string, pos int, v double")
    got = {(r["e"], r["m"]): (r["confs"], r["cells"]) for r in results.result_rows(df, "m", "c", "pos", F.col("v"), ["e"]).collect()}
    assert got == {("a", "cp"): (["512m", "10g", "auto"], ["nan", "1.500", "nan"]), ("a", "ooc"): (["512m", "10g", "auto"], ["nan", "nan", "2.000"]), ("b", "cp"): (["1g"], ["nan"])}
    assert results.axis_limit(df, F.col("v"), ["e"], finite=False).filter("e = 'b'").first()["top"] == 1.0


def test_axis(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", float("nan")), ("a", float("inf")), ("b", float("nan")), ("c", None)], "g string, v double")
    assert {r["g"]: r["top"] for r in results.axis_limit(df, F.col("v"), ["g"]).collect()} == {"a": 2.0, "b": 1.0, "c": 1.0}
