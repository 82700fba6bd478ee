import math

import pytest

from quern.sources import logs


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_span_logs(spark, tmp_path):
    path = put(tmp_path, "c.csv", "ThreadID,CallerID,StartNanos,EndNanos,NumBytes\n1,a,5,9,77\n")
    assert [tuple(r) for r in logs.read_spans(spark, path).collect()] == [(1, "a", 5, 9)]
    with pytest.raises(logs.BadLog, match="CallerID"):
        logs.read_spans(spark, put(tmp_path, "d.csv", "ThreadID,callerid,StartNanos,EndNanos\n1,a,5,9\n"))
    header = put(tmp_path, "e.csv", "ThreadID,CallerID,StartNanos,EndNanos\n")
    for missing in (header, f"file://{tmp_path}/none.csv"):
        with pytest.raises(logs.BadLog):
            logs.read_spans(spark, missing)
        with pytest.warns(UserWarning):
            assert logs.read_spans(spark, missing, allow_empty=True).count() == 0


def test_cache_samples_and_limits(spark, tmp_path):
    path = put(tmp_path, "c.csv", "Timestamp,ScheduledEvictionSize,CacheSize,PinnedSize\n1,2,3,\n4,5,6,7\n")
    assert [tuple(r) for r in logs.read_cache_samples(spark, path).collect()] == [(1, 2, 3, 0, 0), (4, 5, 6, 7, 0)]
    assert logs.read_limits(spark, put(tmp_path, "r.csv", "CacheHardLimit,CacheEvictionLimit\n30,20\n3,2\n")) == (20, 30)
    for text in ("CacheHardLimit\n30\n", "CacheHardLimit,CacheEvictionLimit\nx,20\n", ""):
        assert logs.read_limits(spark, put(tmp_path, "bad.csv", text)) == (None, None)
    assert logs.read_limits(spark, f"file://{tmp_path}/none.csv") == (None, None)


def test_results_round_trip(spark, tmp_path):
    path = put(tmp_path, "r.csv", "mode,conf,rep1,rep2,rep3\ncp,1g,1.5\nooc,2g,nan,2.5,NaN\n")
    got = {r["mode"]: r for r in logs.read_results(spark, path).collect()}
    assert got["cp"]["rep1"] == 1.5 and math.isnan(got["cp"]["rep2"]) and math.isnan(got["ooc"]["rep1"]) and got["ooc"]["rep2"] == 2.5
    out = f"file://{tmp_path}/out"
    logs.append_results(logs.read_results(spark, path), out)
    logs.append_results(logs.read_results(spark, path), out)
    assert logs.read_results(spark, out).count() == 4
    sched = put(tmp_path, "s.csv", "Setup,ExecMode,Runtime [s]\nabs_1x,Tiles,1.5\n")
    assert [tuple(r) for r in logs.read_scheduling(spark, sched).collect()] == [("abs_1x", "Tiles", 1.5)]
