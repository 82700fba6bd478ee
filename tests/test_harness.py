import math
import time

from quern.plans import harness


def test_memory_arithmetic():
    assert [harness.memory_split(g * 1024) for g in (100, 10, 2, 1)] == [(45511, 45511, 11377), (4551, 4551, 1137), (960, 960, 128), (448, 448, 128)]
    assert harness.memory_split(300) == (256, 256, 128)
    assert harness.simple_split(1000) == (850, 850) and harness.simple_split(100) == (256, 256)
    assert [harness.fraction(x) for x in (0, 0.5, 2)] == ["0.0100", "0.5000", "0.9900"]
    assert [harness.megabytes(x) for x in ("2g", "7", "3M", "2048k", "x", "")] == [2048, 7, 3, 2, None, None]


def test_statuses(spark):
    assert harness.timed(spark, lambda: harness.run_noop(spark.range(10))).status == harness.OK

    def fail():
        raise RuntimeError("no")

    got = harness.timed(spark, fail)
    assert got.status == harness.FAILED and math.isnan(got.seconds) and "no" in got.error
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(30) or df for df in it), "id long")
    began = time.time()
    assert harness.timed(spark, lambda: harness.run_noop(slow), limit_s=2).status == harness.TIMEOUT
    assert time.time() - began < 20


def test_sweep_and_run_all(spark):
    calls = []

    def bad(conf):
        raise RuntimeError(conf)

    rows = harness.sweep(spark, {"good": calls.append, "bad": bad, "not": calls.append}, ["1g", "2g"], lambda conf: None, reps=2, warm=1, skip=lambda mode, conf: mode == "not")
    assert [(r["mode"], r["conf"], r["status"]) for r in rows] == [(m, c, s) for c in ("1g", "2g") for m, s in (("good", "ok"), ("bad", "failed"), ("not", "skipped"))]
    assert calls == ["1g"] * 3 + ["2g"] * 3 and rows[0]["rep2"] >= 0 and math.isnan(rows[1]["rep1"])
    assert harness.run_all({"a": lambda: None, "b": lambda: 1 / 0}) == ({"a": "ok", "b": "failed"}, 1)


def test_profiles_and_plans(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with harness.profile(spark, "out_of_core"):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "33554432"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == was
    assert "Range" in harness.explained(spark.range(3))
