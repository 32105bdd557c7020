"""The qd solver against LAPACK's eigenvectors, and whitening against a plain computation."""

import math

import numpy as np
import pytest

from docstrata.llm import whitening
from docstrata.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
R = np.random.default_rng(0)
Q = np.linalg.qr(R.standard_normal((40, 40)))[0]
MATRICES = {
    "random": R.standard_normal((300, 40)),
    "few rows": R.standard_normal((5, 40)),
    "one row": R.standard_normal((1, 3)),
    "one column": R.standard_normal((9, 1)),
    "diagonal": np.diag([3.0, 3.0, 1.0, 0.0]),
    "equal values": (Q * np.r_[np.ones(12), np.full(28, 1.5)]) @ Q.T,
    "close values": (Q * np.r_[1 + 1e-9 * np.arange(12), np.full(28, 0.5)]) @ Q.T,
    "graded": (Q * 10.0 ** -np.arange(40)) @ Q.T,
    "equal columns": np.repeat(R.standard_normal((30, 3)), 2, axis=1),
    "zero": np.zeros((4, 4)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_directions(name):
    a = MATRICES[name]
    sizes, axes, total = whitening.directions(np.linalg.qr(a, mode="r"), 8)
    k = min(8, a.shape[1])
    want = np.r_[np.linalg.svd(a, compute_uv=False), np.zeros(k)][:k]
    top = max(want[0], 1e-300)
    assert np.abs(sizes - want).max() <= 1e-13 * top
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-11
    assert np.abs(a.T @ (a @ axes) - axes * sizes**2).max() <= 1e-10 * top**2
    assert total == pytest.approx((a * a).sum())


def test_small_singular_values_keep_their_own_digits():
    d = 10.0 ** -np.arange(0, 12.0)
    e = d[:-1] / 2
    inverse = np.linalg.inv(np.diag(d) + np.diag(e, 1))  # its largest value is the reciprocal of the smallest
    assert math.sqrt(whitening.dqds(d, e)[-1]) == pytest.approx(1 / np.linalg.norm(inverse, 2), rel=1e-13)


def plain(vectors, keep=8):
    """vec_id -> (deviation, whitened up to sign), explained."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return [int(((n * r - s) ** 2).sum()) for r in x], y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()]
    deviation, white, explained = plain(rows)
    out = QUERIES["op11_whitening"](spark, DATA).orderBy("vec_id", "component").collect()
    assert len(out) == 8 * len(rows) and {r["n"] for r in out} == {len(rows)}
    assert [r["deviation"] for r in out[::8]] == deviation
    got = np.array([r["whitened"] for r in out]).reshape(-1, 8)
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9
    assert np.abs(np.sign(got * white).sum(axis=0)).min() == len(rows)  # one sign for all rows of a component
    assert [r["explained"] for r in out[:8]] == pytest.approx(list(explained), rel=1e-9)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_many_tasks_fold_in_rounds(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).standard_normal(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    deviation, white, _ = plain(rows)
    got = {(r["id"], r["component"]): r for r in whitening.whitened(df).collect()}
    assert [int(got[i, 1]["deviation"]) for i in range(200)] == deviation
    assert max(abs(abs(got[i, c + 1]["whitened"]) - abs(white[i][c])) for i in range(200) for c in range(3)) < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<double>, label int, x int, dim int, w string, component int, n int"
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [2.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [5.0]), (9, [1e200, 0.0]), (10, [1.0, 1.0, 1.0]), (11, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 1, 1, "w", 1, 1) for r in rows], schema)
    out = whitening.whitened(df).collect()
    assert sorted((r["id"] or 0, r["component"], r["n"]) for r in out) == sorted([(i, c, 4) for i in (1, 2, 2, 0) for c in (1, 2)] + [(8, 1, 1)] + [(i, c, 2) for i in (10, 11) for c in (1, 2, 3)])
    assert all((r["whitened"] is None) == (r["id"] in (8, 10, 11)) for r in out)
    assert all(r["identity_error"] is None if r["id"] in (8, 10, 11) else r["identity_error"] < 1e-9 for r in out)
    assert whitening.whitened(df.where("vec_id = 3")).count() == 0 and whitening.whitened(df.where("vec_id < 0")).count() == 0
    huge = spark.createDataFrame([(1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    assert [abs(r["whitened"]) for r in whitening.whitened(huge).collect()] == pytest.approx([1.0, 1.0])
    assert {int(r["deviation"]) for r in whitening.whitened(huge).collect()} == {(2 * 1024 * 10**15) ** 2}
