import random

import pytest

from quern.operators import timeline

SCHEMA = "run_id long, thread_id int, caller_id string, start_nanos long, end_nanos long, span_id long, label string"


def make(seed):
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(200):
        t += r.choice([0, 0, 1, 3])
        rows.append((1, r.choice([1, 1, 2, None]), r.choice(["a", "a", "b", None]), t, t + r.choice([-1, 0, 1, 1, 3, 5]), i, "clash"))
    return rows + [(None, 1, "a", 1, 2, 900, ""), (1, 1, "a", None, 2, 901, ""), (1, 1, "a", 2, None, 902, "")]


def low(*values):
    return tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in values)


def brute(rows):
    by = {}
    for row in rows:
        if None not in (row[0], row[1], row[3]):
            by.setdefault(row[:2], []).append(row)
    gaps, merged = [], []
    for key, spans in by.items():
        spans.sort(key=lambda s: (s[3], s[5]))
        for s, n in zip(spans, spans[1:]):
            if s[4] is not None and s[4] > s[3] and n[3] > s[4]:
                gaps.append((*key, s[4], n[3] - s[4]))
        well = sorted(((s[3], s[4] - s[3], s[2]) for s in spans if s[4] is not None and s[4] > s[3]), key=lambda s: (s[0], s[1], s[2] is not None, s[2] or ""))
        out = []
        for i, (a, d, c) in enumerate(well):
            if out and well[i - 1][2] == c and well[i - 1][0] + well[i - 1][1] == a:
                out[-1] = (out[-1][0], out[-1][1] + d, c, out[-1][3] + 1)
            else:
                out.append((a, d, c, 1))
        merged += [(*key, c, a, d, n) for a, d, c, n in out]
    return sorted(gaps), sorted(merged, key=str)


@pytest.mark.parametrize("min_rows", [10**6, 9, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_merged_segments(spark, seed, min_rows):
    rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    gaps, merged = brute(rows)
    assert sorted(map(tuple, timeline.idle_gaps(df, ties=["span_id"], min_rows=min_rows).collect())) == gaps
    got = timeline.merge_segments(timeline.segments(df, include_idle=False), min_rows=min_rows)
    assert sorted(map(tuple, got.collect()), key=str) == merged
    whole = timeline.segments(df, ties=["span_id"], min_rows=min_rows)
    assert whole.filter(whole.label == timeline.IDLE).count() == len(gaps)


def test_bounds_totals_and_units(spark):
    rows = [(1, 1, "a", 10, 30_000_010, 1, ""), (1, 2, "a", 5, 4, 2, ""), (1, 3, "b", 0, 1_000, 3, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    cache = spark.createDataFrame([(1, 2), (1, 40_000_000)], "run_id long, timestamp_ns long")
    assert [tuple(r) for r in timeline.bounds([df, df.limit(0)], cache).collect()] == [(0, 40_000_000)]
    assert [tuple(r) for r in timeline.caller_totals(df).collect()] == [("a", 30_000_000)]
    assert timeline.thread_counts(df, ["run_id"]).first()["n_threads"] == 3
    rel = timeline.relative_times(df, timeline.bounds([df], groups=["run_id"]), "ms", ["run_id"]).orderBy("span_id").collect()
    assert [(r["span_id"], r["start_rel"], r["duration_rel"]) for r in rel] == [(1, 10 / 1e6, 30.0), (3, 0.0, 0.001)]
    with pytest.raises(ValueError):
        timeline.relative_times(df, df, "weeks", ["run_id"])


def test_caller_ranks_and_empty_logs(spark):
    df = spark.createDataFrame([(None, None, f"c{i:03}", 0, 1, i, "") for i in list(range(50)) * 2] + [(1, 1, None, 0, 1, 0, "")], SCHEMA).repartition(5)
    got = timeline.caller_index(df).orderBy("idx").collect()
    assert [r["caller_id"] for r in got] == [f"c{i:03}" for i in range(50)] and [r["colour"] for r in got][19:22] == [19, 0, 1]
    empty = df.limit(0)
    assert timeline.caller_index(empty).count() == timeline.idle_gaps(empty).count() == timeline.merge_segments(timeline.segments(empty)).count() == 0


def test_hot_threads_of_ties_and_copies(spark):
    r = random.Random(9)
    rows = [(1, 1, r.choice("ab"), 50, 50 + r.choice([1, 2, 3]), i, "") for i in range(150)] + [(1, 1, "a", 53, 60, 7, "")] * 60
    rows += [(1, 1, "a", t, t + 2, t, "") for t in range(0, 120, 2)] + [(1, 2, "b", 1, 2, 1, "")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    gaps, merged = brute(rows)
    assert sorted(map(tuple, timeline.idle_gaps(df, ties=["span_id"], min_rows=1).collect())) == gaps
    assert sorted(map(tuple, timeline.merge_segments(timeline.segments(df, include_idle=False), min_rows=1).collect()), key=str) == merged
