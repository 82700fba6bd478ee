"""Learning routines over row layout (``i``, ``v``): conjugate gradient regression, k-means, principal components.

Data stays distributed; what comes to the driver is m x m or k x m for m columns and k clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.numeric import hash_uniform
from quern.operators.matrix import gathered, gram_arrays, summed

#: Columns up to which t(X) X is gathered; above, each step of the solver passes over the data.
GRAM_COLUMNS = 4000


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _sum_pass(rows: DataFrame, columns: list, partial) -> np.ndarray:
    """The sum of ``partial(batch)`` over all batches: a vector whose length doesn't depend on the data."""
    return gathered(summed(rows, columns, partial))


def lm_cg(rows: DataFrame, y: str, reg: float = 1e-12, tol: float = 1e-7, max_iter: int | None = None) -> np.ndarray:
    """Weights of the least squares fit of ``y`` by the columns of ``v`` (no intercept): conjugate gradient on (t(X) X + reg I) b = t(X) y.

    Stops when the residual's norm is ``tol`` of the first, or after as many steps as columns. Rows with a null y or null cells aren't allowed; an empty table gives no weights.
    """
    first = rows.select(F.size("v").alias("m")).first()
    if first is None:
        return np.zeros(0)
    m = first["m"]
    data = rows.select("v", F.col(y).cast("double").alias("y"))
    if m <= GRAM_COLUMNS:
        g, xty = gram_arrays(data, m, "y")
        times = lambda p: g @ p
    else:
        both = [F.col("v"), F.col("y")]
        xty = _sum_pass(data, both, lambda b: _stack(b.column(0)).T @ np.asarray(b.column(1), dtype=np.float64))

        def times(p: np.ndarray) -> np.ndarray:
            def part(b: pa.RecordBatch) -> np.ndarray:
                x = _stack(b.column(0))
                return x.T @ (x @ p)

            return _sum_pass(data, both, part)

    beta, r = np.zeros(m), -xty
    p, rr = -r, float(r @ r)
    goal = rr * tol * tol
    for _ in range(max_iter or m):
        if rr <= goal or rr == 0.0:
            break
        q = times(p) + reg * p
        step = rr / float(p @ q)
        beta, r = beta + step * p, r + step * q
        rr, old = float(r @ r), rr
        p = -r + (rr / old) * p
    return beta


def assign(rows: DataFrame, centres: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (``i``), ``y`` the 1-based nearest centre (the lowest of equals) and ``d``, the squared distance to it."""
    keep = ["i"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_stack(b.column(len(keep))), centres)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))), pa.array((best + 1).astype(np.int32)), pa.array(d[np.arange(len(best)), best])], names=[*keep, "y", "d"])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, "v").mapInArrow(run, f"{fields}y int, d double")


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # sums of squared differences rather than the expanded form, whose cancellation may swap near ties
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def lloyd_step(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """New centres (an empty cluster keeps its own) and the cost under the old ones. One pass, one k x m sum a task."""
    k, m = centres.shape

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = _stack(b.column(0))
        d = _distances(x, centres)
        best = d.argmin(axis=1)
        hot = np.eye(k)[best]
        return np.concatenate([(hot.T @ x).ravel(), hot.sum(axis=0), [d[np.arange(len(best)), best].sum()]])

    s = _sum_pass(rows, ["v"], part)
    if not len(s):
        return centres, 0.0
    sums, counts = s[: k * m].reshape(k, m), s[k * m : k * m + k]
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres), float(s[-1])


#: Rounds of the seeding, and points drawn in each for every centre wanted.
SEED_ROUNDS, OVERSAMPLING = 4, 2


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means|| seeding with hashed draws: a few rounds, each of which draws points with odds by their squared distance to the nearest one so far; the points drawn
    (some ``SEED_ROUNDS * OVERSAMPLING * k``, whatever the number of rows) are then weighted by the rows nearest to them, and k of them are drawn by k-means++ on the driver.
    """
    key = F.xxhash64(F.lit(seed).cast("long"), F.col("i"))
    start = rows.orderBy(key, "i").select("v").first()
    if start is None:
        raise ValueError("no rows to cluster")
    points = np.array([start["v"]], dtype=float)
    for turn in range(1, SEED_ROUNDS + 1):
        near = assign(rows, points, ["i", "v"])
        cost = near.agg(F.sum("d")).first()[0]
        if not cost:
            break
        u = hash_uniform(seed + turn, F.col("i"))
        drawn = near.filter(u * F.lit(float(cost)) < F.col("d") * F.lit(float(OVERSAMPLING * k))).orderBy("i").select("v").collect()
        if drawn:
            points = np.concatenate([points, np.array([r["v"] for r in drawn], dtype=float)])
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    weights = np.zeros(len(points))
    for r in assign(rows, points).groupBy("y").count().collect():  # a row a point
        weights[r["y"] - 1] = r["count"]
    draw = np.random.default_rng(seed)
    chosen = [int(draw.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        odds = weights * _distances(points, points[chosen]).min(axis=1)
        if not odds.sum():
            break
        chosen.append(int(draw.choice(len(points), p=odds / odds.sum())))
    return points[chosen]


def kmeans(rows: DataFrame, k: int, runs: int = 1, max_iter: int = 30, eps: float = 1e-4, seed: int = 7, centres: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame, float]:
    """Centres, the assignment (``i``, ``y`` from 1, ``d``) and its cost. Lloyd's iterations until the cost falls by less than ``eps`` of itself; the best of ``runs`` seeds."""
    best: tuple[np.ndarray, float] | None = None
    for run in range(1 if centres is not None else runs):
        now = np.array(centres, dtype=float) if centres is not None else first_centres(rows, k, seed + run)
        cost = float("inf")
        for _ in range(max_iter):
            new, was = lloyd_step(rows, now)
            done = cost - was < eps * was
            now, cost = new, was
            if done:
                break
        cost = float(assign(rows, now).agg(F.sum("d")).first()[0] or 0.0)  # of these centres, not of those before the last step
        if best is None or cost < best[1]:
            best = (now, cost)
    return best[0], assign(rows, best[0]), best[1]


def pca(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Projected rows (``i``, ``v`` of k cells), loadings (m x k) and variances. Columns are centred, not scaled; a loading's largest component is positive."""
    first = rows.select(F.size("v").alias("m")).first()
    if first is None:
        raise ValueError("no rows")
    m = first["m"]
    one = rows.select("v", F.lit(1.0).alias("one"))
    g, sums = gram_arrays(one, m, "one")
    n = rows.count()
    mean = sums / n
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = (_stack(b.column(1)) - mean) @ loadings
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))], names=["i", "v"])

    return rows.select("i", "v").mapInArrow(project, "i long, v array<double>"), loadings, values[order]
