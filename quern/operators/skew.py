"""A few keys holding most records: fragment-replicate by estimated load.

``plan_loads`` estimates the rows of each key from a sample, gives keys above a task's share as many shards as they need, puts all other keys into hash bins, and packs
shards and bins onto tasks by decreasing load. ``fragment`` brings each row to its task's partition, ``replicate`` copies the matching rows of another table to just the
tasks that hold shards of their key, and the two meet there without a further shuffle. The plan is small whatever the data: fewer than ``tasks * split`` hot
keys can be above a share, and the bins are a fixed number. Results never depend on the estimate, only the balance does.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.materialize import materialize, steady
from quern.plans.slices import null_safe_join, partitions_of

#: Columns added to rows; names that no table is likely to have.
TASK, SHARD, TASKS = "__quern_task", "__quern_shard", "__quern_tasks"
BINS = 4096
#: Rows of the sample that loads are estimated from: at least so many, and so many for each share of a task (an error of about a twentieth of a share).
SAMPLE_ROWS, SAMPLE_PER_SHARE = 1_000_000, 400


@dataclass
class LoadPlan:
    keys: list[str]
    tasks: int
    #: keys and the list of tasks (the task of each shard, by its number) of the keys that are split
    hot: DataFrame
    n_hot: int
    #: the task of each bin of the other keys
    bins: list[int]
    #: the rows planned for each task, by the estimate
    loads: list[float]
    #: all rows, counted
    total: int

    def bin_task(self) -> Column:
        return F.element_at(F.expr(f"array({', '.join(map(str, self.bins))})"), _bin(self.keys) + 1)


def _bin(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BINS)).cast("int")


def plan_loads(df: DataFrame, keys: list[str], tasks: int, split: int = 4) -> LoadPlan:
    """Plan ``tasks`` tasks from the estimated rows of each key. A key is split if it holds more than a ``tasks * split``-th of all rows."""
    total = df.count()  # of a table in files this reads their footers only
    part = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_SHARE * tasks * split) / max(total, 1))
    seen = df.select(*keys) if part == 1.0 else df.select(*keys).sample(part, seed=1)
    loads = materialize(seen.groupBy(*keys).agg(F.count("*").alias("_seen")).withColumn("_bin", _bin(keys)), "key-loads")  # no more rows than the sample has
    share = max(1.0, total * part / (tasks * split))
    hot = loads.filter(F.col("_seen") > share).collect()  # fewer than tasks * split
    light = {r["_bin"]: r["_sum"] for r in loads.filter(F.col("_seen") <= share).groupBy("_bin").agg(F.sum("_seen").alias("_sum")).collect()}  # at most BINS
    pieces = [(float(n), ("bin", b)) for b, n in light.items()]
    for i, r in enumerate(hot):
        shards = math.ceil(r["_seen"] / share)
        pieces += [(r["_seen"] / shards, ("hot", i))] * shards
    heap = [(0.0, t) for t in range(tasks)]
    bins, shards_of = [b % tasks for b in range(BINS)], [[] for _ in hot]
    for n, (kind, i) in sorted(pieces, key=lambda x: (-x[0], x[1])):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        if kind == "bin":
            bins[i] = t
        else:
            shards_of[i].append(t)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(TASKS, T.ArrayType(T.IntegerType()))])
    table = df.sparkSession.createDataFrame([(*(r[k] for k in keys), ts) for r, ts in zip(hot, shards_of)], schema)
    return LoadPlan(keys, tasks, table, len(hot), bins, [n / part for n, _ in sorted(heap, key=lambda x: x[1])], total)


def _dealt(df: DataFrame, plan: LoadPlan, deal: Column) -> DataFrame:
    rows = null_safe_join(df, F.broadcast(plan.hot), plan.keys)  # fewer than tasks * split rows
    rows = rows.withColumn(SHARD, F.when(F.col(TASKS).isNull(), 0).otherwise(F.pmod(deal, F.size(TASKS)).cast("int")))
    return rows.withColumn(TASK, F.when(F.col(TASKS).isNull(), plan.bin_task()).otherwise(F.element_at(TASKS, F.col(SHARD) + 1))).drop(TASKS)


def fragment(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df`` with its task and shard, each row in its task's partition.

    Rows of a split key are dealt to its shards in turn, by their place in the file they come from: so even copies of one row are spread, and a task that is
    run again deals as before. Rows that don't come straight from files are written first.
    """
    return _dealt(steady(df, "fragments"), plan, F.monotonically_increasing_id()).repartitionById(plan.tasks, F.col(TASK))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: a row of a split key is copied to each task that holds shards of the key, any other row goes to its bin's task."""
    rows = null_safe_join(df, F.broadcast(plan.hot), plan.keys)
    where = F.coalesce(F.array_distinct(TASKS), F.array(plan.bin_task()))
    return rows.withColumn(TASK, F.explode(where)).drop(TASKS).repartitionById(plan.tasks, F.col(TASK))


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], tasks: int | None = None, how: str = "left", split: int = 4, plan: LoadPlan | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` (null meets null), complete, with the rows of hot keys of ``left`` spread over tasks.

    ``how`` is ``left`` or ``inner``. A column of ``right`` that ``left`` has too comes out as ``<name>_right``. Rows keep their number: a left row comes out once for each
    match (once at all in a left join without match). Empty tables on either side are no special case. Nothing of either table is broadcast.
    """
    if how not in ("left", "inner"):
        raise ValueError("rows of the replicated side that match nothing would come out once for each copy")
    for c in [c for c in right.columns if c not in keys and c in left.columns]:
        free = f"{c}_right"
        while free in left.columns or free in right.columns:
            free += "_"
        right = right.withColumnRenamed(c, free)
    left = steady(left, "fragments")
    plan = plan or plan_loads(left, keys, tasks or partitions_of(left), split)
    a, b = fragment(left, plan).drop(SHARD), replicate(right, plan)
    b = b.select(*(F.col(c).alias(f"_r_{c}" if c in [*keys, TASK] else c) for c in b.columns))
    # plain equality of tasks, which are never null, lets both sides stay where they are; the hint keeps the join there, however small the matching side turns out
    on = [a[TASK] == b[f"_r_{TASK}"], *(a[k].eqNullSafe(b[f"_r_{k}"]) for k in keys)]
    return a.join(b.hint("merge"), on, how).drop(TASK, f"_r_{TASK}", *(f"_r_{k}" for k in keys))


def keyed_totals(df: DataFrame, keys: list[str], sums: dict[str, Column], tasks: int | None = None, split: int = 4, plan: LoadPlan | None = None) -> DataFrame:
    """Keys, ``n_rows``, the sums (over non-null values, 0 if none), ``n_shards`` and ``n_tasks`` per key, complete for each key, null keys too.

    Sums can be reduced where the rows lie, so what is placed by the plan is not the rows but their totals by key and shard, one a task that read such rows; the few
    totals of a key are added up last. Repeated rows count as they stand, keys are compared as they stand (empty is not null), an empty table gives no rows, and other
    columns are ignored. Where a sum could leave 64 bits, pass a decimal column.
    """
    plan = plan or plan_loads(df, keys, tasks or partitions_of(df), split)
    rows = _dealt(df.select(*keys, *(c.alias(n) for n, c in sums.items())), plan, F.spark_partition_id())
    shards = rows.groupBy(*keys, TASK, SHARD).agg(F.count("*").alias("n_rows"), *(F.sum(n).alias(n) for n in sums))
    return shards.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums), F.count("*").alias("n_shards"), F.count_distinct(TASK).alias("n_tasks")
    )


def large_keys(df: DataFrame, keys: list[str], share: float, tasks: int | None = None) -> DataFrame:
    """The non-null keys that hold at least ``share`` of all rows of ``df``, null keys counted among all: keys, ``n_rows``, ``n_all``.

    Counts by shard of the load plan are added up for each key, and the exact counts decide, not the estimate.
    """
    plan = plan_loads(df, keys, tasks or partitions_of(df))
    found = keyed_totals(df, keys, {}, plan=plan).select(*keys, "n_rows", F.lit(plan.total).cast("long").alias("n_all"))
    for k in keys:
        found = found.filter(F.col(k).isNotNull())
    # a product such as 0.05 * n may be a hair above the whole number it stands for
    return found.filter(F.col("n_rows") >= F.lit(math.ceil(plan.total * share - 1e-6)))
