"""A benchmark harness: sweeps with repetitions, warm-up, time limits and statuses, and memory budgets."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

OK, FAILED, TIMEOUT, SKIPPED = "ok", "failed", "timeout", "skipped"
NAN = float("nan")


@dataclass
class Outcome:
    seconds: float
    status: str
    error: str = ""


#: Settings of the execution modes: all in memory, adaptive with small partitions that spill rather than fail, and the session's own.
PROFILES: dict[str, dict[str, str]] = {
    "memory": {"spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "268435456"},
    "out_of_core": {"spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "33554432", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16777216", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    "default": {},
}


@contextmanager
def profile(spark: SparkSession, name: str) -> Iterator[None]:
    """Run under the settings of an execution mode; the session's own come back afterwards."""
    was = {k: spark.conf.get(k, None) for k in PROFILES[name]}
    try:
        for k, v in PROFILES[name].items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: ``simple``, ``extended``, ``codegen``, ``cost`` or ``formatted``."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def run_noop(df: DataFrame) -> None:
    """Force every row without keeping any."""
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, program: Callable[[], object], limit_s: float = 200.0) -> Outcome:
    """Run ``program`` with its Spark jobs under a tag, which is interrupted at the limit. Seconds are NaN unless it ends well in time."""
    sc, tag = spark.sparkContext, f"quern-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(limit_s, stop)
    sc.setInterruptOnCancel(True)  # else tasks run on after their job is cancelled
    sc.addJobTag(tag)
    timer.start()
    began = time.perf_counter_ns()
    try:
        program()
        took = (time.perf_counter_ns() - began) / 1e9
        return Outcome(NAN, TIMEOUT) if late.is_set() else Outcome(took, OK)
    except Exception as e:  # noqa: BLE001 - any failure of a program is a result of the sweep
        return Outcome(NAN, TIMEOUT if late.is_set() else FAILED, str(e)[:500])
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def sweep(spark: SparkSession, programs: dict[str, Callable[[str], object]], confs: Iterable[str], apply_conf: Callable[[str], None], reps: int = 3, warm: int = 0, limit_s: float = 200.0, skip: Callable[[str, str], bool] = lambda *_: False) -> list[dict]:
    """A row for each conf and program: ``mode, conf, status, rep1..``. After a failure, or a run past the limit, the pair's other repetitions are not tried."""
    rows = []
    for conf in confs:
        apply_conf(conf)
        for mode, program in programs.items():
            row: dict = {"mode": mode, "conf": conf, "status": SKIPPED} | {f"rep{i + 1}": NAN for i in range(reps)}
            if not skip(mode, conf):
                for i in range(-warm, reps):
                    got = timed(spark, lambda p=program, c=conf: p(c), limit_s)
                    row["status"] = got.status
                    if got.status != OK:
                        break
                    if i >= 0:
                        row[f"rep{i + 1}"] = got.seconds
            rows.append(row)
    return rows


def run_all(experiments: dict[str, Callable[[], object]]) -> tuple[dict[str, str], int]:
    """Run every experiment whatever happens to others: the status of each, and 1 if any failed, else 0."""
    done = {}
    for name, run in experiments.items():
        try:
            run()
            done[name] = OK
        except Exception:  # noqa: BLE001
            done[name] = FAILED
    return done, int(FAILED in done.values())


#: Shares of the heap, the least megabytes of each part, and the least that may be left of it.
SHARES = {"executor": 0.80, "driver": 0.80, "local": 0.20}
FLOORS = {"executor": 1024, "driver": 1024, "local": 256}
HARD_FLOORS = {"executor": 256, "driver": 256, "local": 128}


def _lower_pair(a: int, b: int, floor: int, excess: int) -> tuple[int, int, int]:
    """Take ``excess`` from two parts, the greater first, then in turns, neither below ``floor``; what could not be taken comes third."""
    take = min(excess, max(a - floor, 0) + max(b - floor, 0))
    left = excess - take
    gap = min(abs(a - b), take)
    if a >= b:
        a -= gap
    else:
        b -= gap
    take -= gap
    return a - (take + 1) // 2, b - take // 2, left


def memory_split(heap_mb: int, local_mb: int | None = None, shares: dict[str, float] = SHARES) -> tuple[int, int, int]:
    """Megabytes of executor, driver and local buffers within a heap.

    Each part gets its share, at least its floor; if that is more than the heap, all are scaled down alike, then the excess is taken from the local part and from the greater of
    the other two, first down to the floors, then to the hard floors, which hold even if the heap is too small for them.
    """
    local = max(int(heap_mb * shares["local"]), FLOORS["local"]) if local_mb is None else local_mb
    parts = {"executor": int(heap_mb * shares["executor"]), "driver": int(heap_mb * shares["driver"]), "local": int(local)}
    parts = {k: max(v, FLOORS[k]) for k, v in parts.items()}
    whole = sum(parts.values())
    if whole > heap_mb:
        parts = {k: max(int(v * (heap_mb / whole)), FLOORS[k]) for k, v in parts.items()}
    e, d, rest = parts["executor"], parts["driver"], parts["local"]
    excess = max(e + d + rest - heap_mb, 0)
    for floors in (FLOORS, HARD_FLOORS):
        cut = min(excess, max(rest - floors["local"], 0))
        rest, excess = rest - cut, excess - cut
        e, d, excess = _lower_pair(e, d, floors["executor"], excess)
    return e, d, rest


def simple_split(heap_mb: int, share: float = 0.85, floor: int = 256) -> tuple[int, int]:
    """Executor and driver megabytes, each a share of the heap, at least the floor."""
    return max(int(heap_mb * share), floor), max(int(heap_mb * share), floor)


def fraction(x: float) -> str:
    """A share within [0.01, 0.99], with four decimals."""
    return f"{min(max(x, 0.01), 0.99):.4f}"


def megabytes(value: str) -> int | None:
    """``<n>``, ``<n>g``, ``<n>m``, ``<n>k`` in megabytes (a bare number is megabytes); None for anything else."""
    m = re.fullmatch(r"(\d+)([gmk]?)", value, re.IGNORECASE)
    if not m:
        return None
    n = int(m[1])
    return {"g": n * 1024, "k": n // 1024}.get(m[2].lower(), n)
