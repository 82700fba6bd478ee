import random

import pytest

from quern.operators.intervals import interval_gaps, merge_intervals

SCHEMA = "run_id long, thread_id int, start_nanos long, end_nanos long, note string, _start string"
KEYS = ["run_id", "thread_id"]


def brute(rows):
    by = {}
    for run, thread, a, b, *_ in rows:
        if None not in (run, thread, a, b) and b > a:
            by.setdefault((run, thread), []).append((a, b))
    gaps, periods = [], []
    for key, spans in by.items():
        spans.sort()
        start, end, n = *spans[0], 0
        for a, b in spans:
            if a > end:
                periods.append((*key, start, end, n))
                gaps.append((*key, end, a))
                start, end, n = a, b, 0
            end, n = max(end, b), n + 1
        periods.append((*key, start, end, n))
    return sorted(gaps), sorted(periods)


def rows_of(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randrange(0, 400)
        row = (r.choice([1, 1, 1, 2, None]), r.choice([1, 1, 2, None]), a, a + r.randrange(-2, 6), "x", "clash")
        out += [row] * r.choice([1, 1, 1, 3])
    out += [(1, 1, None, 5, "", ""), (1, 1, 5, None, "", "")] + [(2, 2, 50, 60, "", "")] * 40
    return out


@pytest.mark.parametrize("min_rows", [1_000_000, 7, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_periods_match_brute_force(spark, seed, min_rows):
    rows = rows_of(seed, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    gaps, periods = brute(rows)
    assert sorted(map(tuple, interval_gaps(df, KEYS, min_rows=min_rows).collect())) == gaps
    assert sorted(map(tuple, merge_intervals(df, KEYS, min_rows=min_rows).collect())) == periods


def test_touching_spans_leave_no_gap_and_empty_tables_none(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, "", ""), (1, 1, 5, 9, "", "")], SCHEMA)
    assert interval_gaps(df, KEYS).count() == 0
    assert [tuple(r) for r in merge_intervals(df, KEYS).collect()] == [(1, 1, 0, 9, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert interval_gaps(empty, KEYS).count() == 0 and merge_intervals(empty, KEYS).count() == 0
