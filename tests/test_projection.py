import math

import numpy as np
import pytest

from loomgraph.operators import projection
from loomgraph.plans import catalogue


def _brute(x, k=2):
    x = np.asarray(x) - np.mean(x, axis=0)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    vectors = vectors.T[::-1][:k]
    lead = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return x @ (vectors * np.sign(lead)[:, None]).T, values[::-1][:k] / values.sum()


def _table(spark, rows, extra="", more=()):
    return spark.createDataFrame([(k, v, *more) for k, v in rows], f"id long, v array<double>{extra}")


def test_projection_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 1e4  # far from the origin: the sums must be about the mean
    t = _table(spark, enumerate(x.tolist())).repartition(7)
    want, shares = _brute(x)
    got = {r.id: (r.x, r.y) for r in projection.project(t, "v").collect()}
    assert len(got) == 400 and np.allclose([got[k] for k in range(400)], want, atol=1e-6)
    mean = projection.means(t, "v")
    cov = projection.covariance(t, "v", mean)
    assert cov.count() == 21 and np.allclose(projection.axes(cov, 6, 2)[1], shares)
    full = np.cov(x.T, bias=True)
    assert all(math.isclose(r["cov"], full[r["i"], r["j"]], rel_tol=1e-6, abs_tol=1e-6) for r in cov.collect())


def test_projection_of_odd_rows(spark):
    good = [(0, [1.0, 2.0, 0.0]), (1, [2.0, 4.5, 0.0]), (1, [2.0, 4.5, 0.0]), (None, [5.0, 1.0, 1.0])]
    bad = [(2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0])]
    t = _table(spark, good + bad, ", x string, `a.b` int", ("old", 7))
    got = projection.project(t, "v").collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in got) == [(False, 0), (False, 1), (False, 1), (True, 0)]
    assert all(isinstance(r["x"], float) and r["a.b"] == 7 for r in got)
    want = _brute([v for _, v in good])[0]
    assert np.allclose(sorted((r["x"], r["y"]) for r in got), sorted(map(tuple, want.tolist())))
    assert projection.project(t.limit(0), "v").count() == 0 and projection.project(t.where("id > 2 AND id < 7"), "v").count() == 0
    same = projection.project(_table(spark, [(0, [3.0, 3.0]), (1, [3.0, 3.0])]), "v").collect()
    assert [(r["x"], r["y"]) for r in same] == [(0.0, 0.0)] * 2
    line = projection.project(_table(spark, [(0, [1.0]), (1, [3.0])]), "v").orderBy("id").collect()
    assert [(r["x"], r["y"]) for r in line] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_vector_layout(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = catalogue.vector_layout(spark, sf).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [r.vec_id for r in rows]
    assert np.allclose([(r.x, r.y) for r in got], _brute([r.embedding for r in rows])[0], atol=1e-6)
