"""Hard negatives against brute force: labels of one row, hot labels, ties, vectors of several lengths, values beyond a double's whole numbers."""

import numpy as np
import pytest

from docstrata.llm import negatives

SCHEMA = "id long, label int, z array<double>"


def plain(rows, anchor, k=5, m=10):
    one = {}
    for i, label, z in rows:
        one[i] = min(one.get(i, (label, z)), (label, z))
    out = []
    for a, (la, za) in one.items():
        if anchor(a):
            others = sorted((-max(1 - 2**63, min(2**63 - 1, sum(int(u) * int(v) for u, v in zip(za, z, strict=True)))), i, lab) for i, (lab, z) in one.items() if i != a and len(z) == len(za))
            for s, p, _ in [o for o in others if o[2] == la][:k]:
                hard = [(n, t) for t, n, lab in others if lab != la and -30 * s <= -100 * t <= -90 * s][:m]
                out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(hard)]
    return sorted(out)


def table(seed, n, dim, spread, labels):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim))
    z = np.floor(256 * (centres[r.integers(0, 5, n)] + spread * r.standard_normal((n, dim))) / dim**0.5)
    return [(int(i), int(lab), [float(c) for c in v]) for i, lab, v in zip(r.permutation(n) * 3, r.choice(labels, n), z, strict=True)]


@pytest.mark.parametrize(("seed", "dim", "spread", "labels"), [(1, 8, 0.3, [0, 0, 0, 1]), (2, 3, 0.05, list(range(40))), (3, 16, 2.0, [0, 1, 2]), (4, 1, 1.0, [0, 1])])
def test_mined(spark, monkeypatch, seed, dim, spread, labels):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * dim * 50)  # many blocks
    rows = table(seed, 400, dim, spread, labels)
    got = negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(4), negatives.F.col("id") % 7 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 7 == 0)


def test_bounds_hold():
    r = np.random.default_rng(5)
    for spread in (0.01, 0.5, 5):
        u = r.standard_normal(12) + spread * r.standard_normal((20, 12))
        x = r.standard_normal((300, 12)) * r.random((300, 1))
        assert (u @ x.T <= negatives.lengths(u)[:, None] * negatives.bounds(u, x)[None] + 1e-12).all()


def test_walk_stops_early():
    r = np.random.default_rng(6)
    u = np.floor(256 * (np.eye(1, 32)[0] + 0.01 * r.standard_normal((8, 32))))
    x = np.floor(256 * r.standard_normal((4000, 32)))
    x[:200, 0] += 5000
    seen = []
    product = negatives.product
    try:
        negatives.product = lambda a, b: seen.append(a.shape[0] * b.shape[0]) or product(a, b)
        q, _, at, s = negatives.walk(u, x, np.ones((8, 4000), bool), np.full((8, 1), negatives.LEAST), np.full((8, 1), negatives.MOST), 5, np.arange(4000))
    finally:
        negatives.product = product
    assert sum(seen) < 8 * 1000
    for i in range(8):
        assert sorted(s[q == i]) == sorted(np.sort(u[i] @ x.T)[-5:].astype(int))


def test_edges(spark):
    rows = [(0, 1, [1e200, 0.0]), (1, 1, [5.0, 0.0]), (2, 1, [5.0, 0.0]), (2, 1, [5.0, 0.0]), (2, 3, [9.0, 9.0]), (3, 2, [3.0, 0.0]), (4, 2, [3.0, 1.0]), (5, 2, [0.0, 0.0]), (7, 1, [-1.0, 0.0]), (10, 1, [4.0, 4.0]), (20, 5, [1.0]), (30, 2, [2.0]), (31, 2, [3.0]), (32, 4, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1, "s", 2) for r in rows], SCHEMA + ", query string, band int, salt string, k0 int")
    got = negatives.mined(df, negatives.F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 10 == 0)
    assert negatives.mined(df.where("id < 0"), negatives.F.col("id") % 10 == 0).count() == 0
    assert negatives.mined(df, negatives.F.col("id") < 0).count() == 0
