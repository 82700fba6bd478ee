import numpy as np
import pytest

from quern.operators import learn

R = np.random.default_rng(1)
X = R.normal(size=(300, 5)) + np.array([3, 0, 0, 1, 0])
Y = X @ np.array([1.0, -2, 0.5, 0, 3]) + R.normal(size=300) * 0.1


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, X[i].tolist(), float(Y[i])) for i in range(300)], "i long, v array<double>, y double").repartition(4)


@pytest.mark.parametrize("limit", [4000, 1])
def test_regression_by_gram_and_by_passes(rows, limit, monkeypatch):
    monkeypatch.setattr(learn, "GRAM_COLUMNS", limit)
    want = np.linalg.lstsq(X, Y, rcond=None)[0]
    assert np.allclose(learn.lm_cg(rows, "y"), want, atol=1e-5)
    assert learn.lm_cg(rows.limit(0), "y").size == 0


def test_kmeans_finds_blobs_and_keeps_empty_clusters(spark):
    centres = np.array([[0.0, 0], [10, 0], [0, 10]])
    points = np.concatenate([c + R.normal(size=(50, 2)) for c in centres])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i long, v array<double>").repartition(3)
    got, assigned, cost = learn.kmeans(rows, 3, runs=3, seed=7)
    assert sorted(np.round(np.linalg.norm(got[:, None] - centres[None], axis=2).min(axis=1)).tolist()) == [0, 0, 0]
    labels = [r["y"] for r in assigned.orderBy("i").collect()]
    assert all(len(set(labels[a : a + 50])) == 1 for a in (0, 50, 100)) and cost > 0
    far = np.array([[0.0, 0], [1e6, 1e6]])
    assert (learn.lloyd_step(rows, far)[0][1] == far[1]).all()


def test_pca_matches_an_eigendecomposition(rows):
    projected, loadings, variances = learn.pca(rows, 2)
    values, vectors = np.linalg.eigh(np.cov(X.T))
    assert np.allclose(variances, values[::-1][:2])
    assert np.allclose(np.abs(loadings.T @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)
    assert all(loadings[np.abs(loadings[:, k]).argmax(), k] > 0 for k in range(2))
    got = np.array([r["v"] for r in projected.orderBy("i").collect()])
    assert np.allclose(got, (X - X.mean(axis=0)) @ loadings)


def test_cost_is_that_of_the_centres_returned(rows):
    got, assigned, cost = learn.kmeans(rows, 4, runs=2, max_iter=2, seed=3)
    d = ((X[:, None] - got[None]) ** 2).sum(axis=2).min(axis=1)
    assert cost == pytest.approx(d.sum()) and len(learn.first_centres(rows, 4, 3)) == 4
    assert len(learn.first_centres(rows.filter("i = 0"), 4, 3)) == 1
