import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import generators, tiles
from quern.operators.matrix import Matrix, as_matrix, as_scalar, column_of, contingency, gram, matvec
from quern.operators.tiles import from_tiles, tile_matmul, to_tiles
from quern.sources.matrices import matrix_exists, read_matrix, write_matrix


def matrix(spark, a, sparse=False):
    cells = [(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(a) if v != 0 or not sparse]
    return Matrix(spark.createDataFrame(cells, "i long, j long, v double"), *a.shape, dense=not sparse)


def array(m):
    out = np.zeros((m.nrow, m.ncol))
    for r in m.df.collect():
        out[r["i"] - 1, r["j"] - 1] = r["v"]
    return out


A = np.array([[1.0, -2.5, 0.0], [0.0, 0.0, 3.25], [4.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
B = np.arange(12.0).reshape(4, 3) - 5


@pytest.mark.parametrize("sparse", [False, True])
def test_cellwise_and_reorganisation(spark, sparse):
    a, b = matrix(spark, A, sparse), matrix(spark, B, sparse)
    assert (array(a.cellwise(b, lambda x, y: x * y)) == A * B).all()
    assert (array(a.cellwise(b, lambda x, y: x - y)) == A - B).all()
    assert (array(a.t()) == A.T).all() and (array(a.t().t()) == A).all()
    assert (array(a.map(numeric.ceil, True)) == np.ceil(A)).all()
    assert (array(a.map(lambda v: v + 1, False)) == A + 1).all()
    assert (array(a.index((2, 3), (1, 3))) == A[1:3, 0:3]).all()
    assert np.allclose(array(a.matmul(b.t())), A @ B.T)
    with np.errstate(all="ignore"):
        want = A / B
    got = array(a.cellwise(b, numeric.ieee_div, zero_safe=False))
    assert np.array_equal(got, want, equal_nan=True)


@pytest.mark.parametrize("sparse", [False, True])
def test_aggregates_see_unlisted_zeros(spark, sparse):
    a = matrix(spark, np.abs(A) + np.array([[0.0], [0.0], [0.0], [0.0]]), sparse)
    r = a.df.agg(a.sum().alias("s"), a.mean().alias("m"), a.min().alias("l"), a.contains(0).alias("z"), a.contains(4).alias("f"), a.contains(9).alias("n")).first()
    assert r["s"] == np.abs(A).sum() and r["m"] == pytest.approx(np.abs(A).mean()) and r["l"] == 0 and r["z"] and r["f"] and not r["n"]
    assert a.has(0) and a.has(4) and not a.has(9) and not matrix(spark, B + 100, sparse).has(0)


def test_shapes_are_checked(spark):
    a = matrix(spark, A)
    with pytest.raises(ValueError):
        a.cellwise(a.t(), lambda x, y: x + y)
    with pytest.raises(ValueError):
        a.matmul(a)
    with pytest.raises(ValueError):
        a.index((0, 1), (1, 1))


def test_vectors_scalars_tables(spark):
    assert array(column_of(spark, 1, 10, 4)).ravel().tolist() == [1, 5, 9]
    assert as_scalar(as_matrix(spark, 2.5)) == 2.5
    df = spark.createDataFrame([(1, 2), (2, 2), (2, 2), (3, 9), (None, 1)], "i long, y long")
    assert (array(contingency(df, F.col("i"), F.col("y"), 3, 2)) == np.array([[0, 1], [0, 2], [0, 0]])).all()


def test_row_layout_and_tiles(spark):
    rows = spark.createDataFrame([(i + 1, B[i].tolist(), float(i)) for i in range(4)], "i long, v array<double>, y double").repartition(3)
    got = np.zeros((3, 4))
    for r in gram(rows, 3, "y").collect():
        got[r["j"] - 1, r["k"]] = r["v"]
    assert np.allclose(got[:, 1:], B.T @ B) and np.allclose(got[:, 0], B.T @ np.arange(4.0))
    assert [r["v"] for r in matvec(rows, [1, 2, 3]).orderBy("i").collect()] == (B @ [1, 2, 3]).tolist()
    m = matrix(spark, B, True)
    assert (array(from_tiles(to_tiles(m, 2), 4, 3, 2)) == B).all()
    assert np.allclose(array(from_tiles(tile_matmul(to_tiles(m, 2), to_tiles(m.t(), 2)), 4, 4, 2)), B @ B.T)
    assert gram(rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("few", [64, 0])
def test_tile_programs(spark, few, monkeypatch):
    monkeypatch.setattr(tiles, "BROADCAST_TILES", few)
    r = np.random.default_rng(5)
    a, b = r.normal(size=(7, 5)), r.normal(size=(5, 9))
    rows = lambda x: spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    ta, tb = tiles.row_tiles(rows(a), 7, 5, 2), tiles.row_tiles(rows(b), 5, 9, 2)
    back = lambda t, n, m: array(from_tiles(t, n, m, 2))
    assert np.allclose(back(tile_matmul(ta, tb), 7, 9), a @ b)
    assert np.allclose(back(tile_matmul(tiles.tile_transpose(ta), ta), 5, 5), a.T @ a)
    s = r.normal(size=(7, 7))
    ts = tiles.row_tiles(rows(s), 7, 7, 3)
    assert np.allclose(array(from_tiles(tiles.tile_with_transposed(ts, lambda x, y: x - 2 * y), 7, 7, 3)), s - 2 * s.T)
    assert np.allclose(array(from_tiles(tiles.tile_with_transposed(ts.filter("bi <= bj"), lambda x, y: x + y), 7, 7, 3))[0:3, 6:7], s[0:3, 6:7])
    assert np.allclose(array(from_tiles(tiles.tile_zip(ts, ts.filter("bi = 0"), lambda x, y: x + y), 7, 7, 3))[:3], 2 * s[:3])
    for rc in (((2, 5), (3, 7)), ((4, 4), (1, 7)), ((1, 7), (1, 7))):
        (x, y), (z, w) = rc
        cut = tiles.tile_sum(tiles.tile_crop(ts, *rc, block=3)).first()
        assert np.isclose(cut["total"], s[x - 1 : y, z - 1 : w].sum()) and cut["n_cells"] == (y - x + 1) * (w - z + 1)
    total = tiles.tile_sum(tiles.tile_map(ts, np.ceil)).first()
    assert total["total"] == np.ceil(s).sum() and total["n_cells"] == 49
    assert tiles.tile_sum(ts.limit(0)).first()["n_cells"] == 0 and tile_matmul(ta.limit(0), tb).count() == 0
    made = tiles.rand_tiles(spark, 70, 30, seed=2, block=16)
    got = array(from_tiles(made, 70, 30, 16))
    assert (got == array(from_tiles(tiles.rand_tiles(spark, 70, 30, seed=2, block=16), 70, 30, 16))).all() and 0 <= got.min() and 0.45 < got.mean() < 0.55 and (got > 0).all()


def test_files_keep_the_shape(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert not matrix_exists(spark, path)
    assert write_matrix(matrix(spark, A, True), path) and not write_matrix(matrix(spark, B), path, skip_existing=True)
    back = read_matrix(spark, path)
    assert (back.nrow, back.ncol, back.dense) == (4, 3, False) and (array(back) == A).all()


def test_generators(spark):
    m = generators.rand(spark, 300, 50, low=-1, high=1, sparsity=0.4, seed=3)
    n = m.df.count()
    assert 0.35 < n / 15000 < 0.45 and m.df.filter("v < -1 or v >= 1").count() == 0
    x, c, y = generators.blobs(spark, 500, 4, 3, 1.0, 0.01, 7)
    centres, labels = array(c), {r["i"]: r["y"] for r in y.collect()}
    assert set(labels.values()) <= {1, 2, 3}
    for r in x.collect():
        assert np.abs(np.array(r["v"]) - centres[labels[r["i"]] - 1]).max() < 0.08
    masked = generators.blobs(spark, 200, 4, 3, 0.5, 0.01, 7)[0].collect()
    assert 0.4 < np.mean([v == 0 for r in masked for v in r["v"]]) < 0.6
    made = sorted(generators.rand_rows(spark, 2500, 3, seed=4).collect())
    assert [r["i"] for r in made] == list(range(1, 2501)) and made == sorted(generators.rand_rows(spark, 2500, 3, seed=4).repartition(3).collect()) and 0 <= min(map(min, (r["v"] for r in made)))
    assert generators.blob_base(2, 3, 4, 1.0, 0.1, 7) == "data/blobs_2x3k4s1.0n0.1_seed7"
