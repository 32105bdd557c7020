"""Interval joins against nested loops, and their plans."""

import random

import pytest

from docstrata.operators import intervals
from docstrata.operators.intervals import overlapping
from docstrata.plans import spans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("axes", [1, 2])
def test_pairs(spark, seed, axes):
    r = random.Random(seed)

    def side(n):
        out = []
        for i in range(n):
            row = [i, r.randrange(2)]
            for _ in range(axes):
                lo = r.randrange(-300, 300)
                row += [lo, lo + r.choice([0, 0, 1, 3, 4, 15, 16, 17, 200, 5000]) - (r.random() < 0.05)]
            out.append(tuple(row))
        return [*out, (n, 0, *[None] * (2 * axes)), (n + 1, 0, *[-(2**40), 2**40] * axes)]

    names = lambda s: f"{s} long, k int, " + ", ".join(f"{s}{x}{a} long" for a in range(axes) for x in "lh")
    left, right = side(60), side(40)
    got = overlapping(spark.createDataFrame(left, names("a")), spark.createDataFrame(right, names("b")), [(f"al{i}", f"ah{i}", f"bl{i}", f"bh{i}") for i in range(axes)], ["k"])
    meet = lambda x, y: all(x[i] is not None and y[i] is not None and x[i] <= x[i + 1] and y[i] <= y[i + 1] and x[i] <= y[i + 1] and y[i] <= x[i + 1] for i in range(2, 2 + 2 * axes, 2))
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and meet(x, y))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["page_chunks", "region_chunks", "rectangle_rows", "users_by_day"])
def test_no_nested_loops(spark, name):
    plan = getattr(spans, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_rows_of_many_keys(spark, monkeypatch):
    """Keys with many rows go by grids and those with few do not, and no pair is lost or doubled between them."""
    r = random.Random(9)
    side = lambda n: [(i, r.choice([0, 0, 0, 1, 2, 3]), lo := r.randrange(-50, 50), lo + r.choice([0, 0, 2, 30]), c := r.randrange(9), c + r.choice([0, 3])) for i in range(n)]
    names = lambda s: f"{s} long, k int, {s}l0 long, {s}h0 long, {s}l1 long, {s}h1 long"
    left, right = side(120), side(90)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and all(x[i] <= y[i + 1] and y[i] <= x[i + 1] for i in (2, 4)))
    axes = [(f"al{i}", f"ah{i}", f"bl{i}", f"bh{i}") for i in range(2)]
    for few in (0, 25, 1000):
        monkeypatch.setattr(intervals, "FEW", few)
        got = overlapping(spark.createDataFrame(left, names("a")), spark.createDataFrame(right, names("b")), axes, ["k"])
        assert sorted((x["a"], x["b"]) for x in got.collect()) == want


def test_rows_are_not_spread(spark):
    """Sheets with few rows go without grids, so neither side's rows are multiplied before they meet."""
    plan = spans.rectangle_rows(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan
