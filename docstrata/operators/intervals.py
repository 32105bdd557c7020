"""Joins of overlapping intervals and rectangles, as equality joins on grid cells.

An interval of whole numbers, ends included, has a level: the smallest grid
whose cells are as wide as the interval, so that it lies in one cell of that
grid or in two. Grids grow by ``STEP`` from level to level. Two intervals meet
in the grid of the wider one: the wider side stands in its own cells, the
narrower in those of each grid that the other side uses, two at most of each.
So no interval is spread over many cells however wide it is, and narrow
intervals never meet in cells of wide ones. A pair that meets in two cells
counts in the later of the two first cells only.

Rectangles have a level on each axis, and either side may be the wider one on
either axis: one equality join for each of these cases, none of which gives a
pair of another.

Grids pay where a key has many rows. Keys with ``FEW`` rows a side at most meet
without them: points of the first axis by their place, and intervals with all
rows of their key, so that a row stands once or twice and not in every grid.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4  # cells of level k are STEP ** k wide; level_of counts on it
FEW = 4096  # rows of a key on either side that may meet without grids


def width(level: Column) -> Column:
    return F.pow(F.lit(float(STEP)), level).cast("long")


def level_of(lo: Column, hi: Column) -> Column:
    """The first level whose cells are at least as wide as the interval: half the binary digits of its size less one, so that no rounding decides."""
    return F.when(hi <= lo, 0).otherwise(F.floor((F.length(F.bin(hi - lo)) + 1) / 2).cast("int"))


def placed(df: DataFrame, side: str, axis: int, lo: str, hi: str, others: list[int] | None, strictly: bool) -> DataFrame:
    """A row for each cell of an axis: in the interval's own grid (``others`` None), or in those of ``others`` that are no finer, or coarser if ``strictly``."""
    level, cell, first = f"_level{axis}", f"_cell{axis}", f"_{side}first{axis}"
    own = level_of(F.col(lo), F.col(hi))
    if others is None:
        df = df.withColumn(level, own)
    else:
        grids = F.array(*map(F.lit, others)) if others else F.array().cast("array<int>")
        wide = F.filter(grids, (lambda k: k > own) if strictly else (lambda k: k >= own))
        df = df.withColumn(level, F.explode(wide))
    at = lambda c: ((F.col(c) - F.pmod(F.col(c), width(F.col(level)))) / width(F.col(level))).cast("long")  # noqa: E731  a multiple of the width, so the quotient is whole
    return df.withColumn(first, at(lo)).withColumn(cell, F.explode(F.sequence(F.col(first), at(hi))))


def overlapping(left: DataFrame, right: DataFrame, axes: list[tuple[str, str, str, str]], keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows of equal ``keys`` that overlap on every axis (left low, left high, right low, right high), once each.

    Column names of both sides must differ but for the keys. Ends are whole
    numbers below 2**53; a row with a null end, or an end before its start,
    overlaps nothing.
    """
    keys = keys or []
    for a, b, c, d in axes:
        left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    if not keys:
        return on_grids(left, right, axes, keys)
    a, b, c, d = axes[0]
    counted = [df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col(x) < F.col(y)).alias("wide")).withColumn("side", F.lit(k)) for k, (df, x, y) in enumerate(((left, a, b), (right, c, d)))]
    every = counted[0].union(counted[1])
    seen = {r["side"]: r for r in every.groupBy("side").agg(F.max("wide").alias("wide"), F.count_if(F.col("n") > FEW).alias("many")).collect()}
    wide = [k in seen and seen[k]["wide"] for k in (0, 1)]
    if not any(r["many"] for r in seen.values()):
        return in_keys(left, right, axes, keys, *wide)
    many = every.where(F.col("n") > FEW).select(*keys).distinct()
    split = lambda how: (left.join(many, keys, how), right.join(many, keys, how), axes, keys)
    return in_keys(*split("left_anti"), *wide).union(on_grids(*split("left_semi")))


def in_keys(left: DataFrame, right: DataFrame, axes: list[tuple[str, str, str, str]], keys: list[str], left_wide: bool, right_wide: bool) -> DataFrame:
    """Pairs of keys with few rows; ``left_wide`` and ``right_wide`` tell whether a side has intervals on the first axis that are no points."""
    a, b, c, d = axes[0]
    points = left.where(F.col(a) == F.col(b))
    cases = [(points.withColumn("_at", F.col(a)), right.where(F.col(c) == F.col(d)).withColumn("_at", F.col(c)), [*keys, "_at"])]
    if left_wide:
        cases.append((left.where(F.col(a) < F.col(b)), right, keys))
    if right_wide:
        cases.append((points, right.where(F.col(c) < F.col(d)), keys))
    ok = F.lit(True)
    for lo, hi, start, stop in axes:
        ok = ok & (F.col(lo) <= F.col(stop)) & (F.col(start) <= F.col(hi))
    out = None
    for one, two, on in cases:
        pairs = one.join(two, on).where(ok).select(*keys, *(x for x in left.columns if x not in keys), *(x for x in right.columns if x not in keys))
        out = pairs if out is None else out.union(pairs)
    return out


def on_grids(left: DataFrame, right: DataFrame, axes: list[tuple[str, str, str, str]], keys: list[str]) -> DataFrame:
    """Pairs through the cells of grids, for keys with any number of rows, or without keys."""
    levels = lambda df, ends: df.select(F.array(*(level_of(F.col(x), F.col(y)) for x, y in ends)).alias("k")).distinct().collect()  # noqa: E731  a few small numbers
    both = [levels(left, [(a, b) for a, b, _, _ in axes]), levels(right, [(c, d) for _, _, c, d in axes])]
    used = [[sorted({r["k"][i] for r in side}) for side in both] for i in range(len(axes))]
    out = None
    for wider in product((0, 1), repeat=len(axes)):  # on each axis: 0, the left side is at least as wide; 1, the right side is wider
        one, two, on, ok = left, right, list(keys), F.lit(True)
        for k, (w, (a, b, c, d)) in enumerate(zip(wider, axes, strict=True)):
            one = placed(one, "l", k, a, b, used[k][1] if w else None, bool(w))
            two = placed(two, "r", k, c, d, None if w else used[k][0], False)
            on += [f"_level{k}", f"_cell{k}"]
            ok = ok & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col(f"_cell{k}") == F.greatest(f"_lfirst{k}", f"_rfirst{k}"))
        pairs = one.join(two, on).where(ok).select(*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))
        out = pairs if out is None else out.union(pairs)
    return out
