import random

import pytest
from pyspark.sql import functions as F

from quern.operators.regular_grid import regular_grid

SCHEMA = "reading_id long, run_id long, timestamp_ns long, cache_size long, pinned_size long, logged_at long, metric string, value string"


def brute(rows, step, gap):
    out = []
    for k, metric in ((3, "cache_size"), (4, "pinned_size")):
        by = {}
        for r in rows:
            if r[1] is not None and r[2] is not None and r[k] is not None and r[k] >= 0:
                by.setdefault(r[1], {}).setdefault(r[2] // step * step, []).append((r[2], r[5], r[0], r[k]))
        for run, slots in by.items():
            seen = None
            for s in range(min(slots), max(slots) + 1, step):
                if s in slots:
                    seen = (s, max(slots[s])[3])
                    out.append((run, metric, s, seen[1], "read", len(slots[s])))
                elif s - seen[0] <= gap * step:
                    out.append((run, metric, s, seen[1], "carried", 0))
                else:
                    out.append((run, metric, s, None, "missing", 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [4, 64])
def test_grid_matches_brute_force(spark, chunk):
    r = random.Random(chunk)
    rows = []
    for i in range(300):
        t = r.choice([None, r.randrange(-300, 3000), r.randrange(-300, 300)])
        row = (i, r.choice([1, 1, 2, None]), t, r.choice([None, -1, r.randrange(9)]), None if r.random() < 0.4 else r.randrange(9), r.randrange(3), "clash", "clash")
        rows += [row] * r.choice([1, 1, 2])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = regular_grid(df, "run_id", "timestamp_ns", ["cache_size", "pinned_size"], 10, ["logged_at", "reading_id"], F.col("value") >= 0, max_gap_slots=3, chunk_slots=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10, 3)


def test_empty_table_and_wide_gap(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert regular_grid(empty, "run_id", "timestamp_ns", ["cache_size"], 10, ["reading_id"]).count() == 0
    with pytest.raises(ValueError):
        regular_grid(empty, "run_id", "timestamp_ns", ["cache_size"], 10, ["reading_id"], max_gap_slots=9, chunk_slots=8)
