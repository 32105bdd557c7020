"""Embedding whitening through a bidiagonal qd solver.

Vectors become whole numbers x, whose sums are exact. Centred rows are reduced
by blockwise QR: tasks fold their rows into one triangle R, and triangles are
folded ``FAN`` at a time in rounds of tasks, so that no task reads more of
them as the table grows. One task brings the last R to upper bidiagonal form
by Householder reflections, finds its singular values by dqds, which keeps
each accurate to its own size, and their vectors by twisted factorisations of
the shifted tridiagonal form. So nothing is squared that is later to be told
apart, and only the leading directions come back to the driver.

A last pass projects all vectors, and the covariance of what came out, summed
over all rows, is held against the identity.

Edge cases: vectors that are null or hold null or non-finite components take
no part, nor those with a component that is no long once scaled; rows with
null or repeated ids are rows like others; an empty vector has no components
and so no rows; vectors of different lengths are fitted and whitened apart;
fewer than ``keep`` dimensions give fewer components; a component whose
deviation is within rounding of none (single rows, equal rows, dependent
dimensions) has null whitened values and no part in the error, which is null
where no component is left; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_length, saved

EPS = float(np.finfo(float).eps)
CLOSE = 1e-3  # eigenvalues nearer than this share of the largest have their vectors made orthogonal
FAN = 16  # triangles a task folds into one
ROWS = 4096  # rows of a block, at most
EXACT = 1 << 62


# --- the solver -------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors V of r = U B V', by Householder reflections from both sides."""
    a = np.array(r, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """u and the first component of (I - 2 u u') x, whose others vanish."""
        size = float(np.linalg.norm(x))
        if size == 0 or not np.any(x[1:]):
            return np.zeros(len(x)), float(x[0])
        alpha = -math.copysign(size, x[0])
        u = x.copy()
        u[0] -= alpha
        return u / np.linalg.norm(u), alpha

    diag, above = np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        u, diag[k] = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 1:
            u, above[k] = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return diag, above, v


def qd_step(q: np.ndarray, e: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One dqds transform of a qd array by the shift ``tau``: new q and e, the least d, and whether only the last d was negative."""
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = least = q[0] - tau
    for i in range(n - 1):
        if d < 0:
            return nq, ne, least, False
        nq[i] = d + e[i]
        ratio = q[i + 1] / nq[i]  # not by zero: a block is cut where e is
        ne[i] = e[i] * ratio
        d = d * ratio - tau
        least = min(least, d)
    nq[-1] = d
    return nq, ne, least, d < 0


def dqds(diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling; each to a few units of its own last place."""
    found: list[float] = []
    blocks = [(diag * diag, above * above, 0.0)]
    tiny, steps, limit = (10 * EPS) ** 2, 0, 100 * len(diag)
    while blocks:
        q, e, sigma = blocks.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            small = e <= tiny * (sigma + np.minimum(q[:-1], q[1:]))
            if small[-1]:
                found.append(q[-1] + sigma)
                q, e = q[:-1], e[:-1]
                continue
            if small.any():
                at = int(np.flatnonzero(small)[-1]) + 1
                blocks.append((q[:at], e[: at - 1], sigma))
                q, e = q[at:], e[at:]
                continue
            if q[0] < q[-1] / 2:  # graded the wrong way round: the same values in reverse
                q, e = q[::-1].copy(), e[::-1].copy()
            # The smaller value of the last two rows of L U is no lower bound, so a step may fail; then the shift gives way.
            a, b, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1], math.sqrt(e[-1] * q[-2])
            gap = (a - b) / 2
            least = b - c * c / (gap + math.hypot(gap, c)) if gap > 0 else (a + b) / 2 - math.hypot(gap, c)
            tau = max(0.0, min(least, q[-1])) * (1 - 2 * EPS)
            fails = 0
            while True:
                nq, ne, least, last = qd_step(q, e, tau)
                if least >= 0 and np.isfinite(nq).all():
                    break
                fails += 1
                tau = max(0.0, (tau + least) * (1 - 2 * EPS)) if last and fails == 1 else (tau / 4 if fails < 4 else 0.0)
            q, e, sigma, steps = nq, ne, sigma + tau, steps + 1
            if steps > limit:
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.array(found))[::-1]


@dataclass
class Twists:
    """Factorisations of T - lam, T = B'B, from above (pivots ``plus``) and from below (``minus``), and the pivot where they meet."""

    low: np.ndarray
    up: np.ndarray
    plus: np.ndarray
    minus: np.ndarray
    pivot: np.ndarray

    @classmethod
    def of(cls, diag: np.ndarray, above: np.ndarray, lam: float) -> Twists:
        n = len(diag)
        q, e, off = diag * diag, above * above, diag[:-1] * above
        floor = EPS * EPS * max(float(q.max()), lam, float(np.finfo(float).tiny))
        kept = lambda d: d if abs(d) > floor else math.copysign(floor, d)  # noqa: E731  no pivot is zero
        low, up, s, p, plus, minus = np.zeros(n), np.zeros(n), np.empty(n), np.empty(n), np.empty(n), np.empty(n)
        s[0], p[-1] = -lam, q[-1] - lam
        for i in range(n - 1):  # stationary
            plus[i] = kept(q[i] + s[i])
            low[i] = off[i] / plus[i]
            s[i + 1] = (low[i] * above[i] / diag[i] * s[i] if diag[i] else e[i]) - lam
        for i in range(n - 2, -1, -1):  # progressive
            minus[i + 1] = kept(e[i] + p[i + 1])
            up[i] = off[i] / minus[i + 1]
            p[i] = p[i + 1] * (q[i] / minus[i + 1]) - lam
        plus[-1], minus[0] = kept(q[-1] + s[-1]), kept(p[0])
        return cls(low, up, plus, minus, np.array([kept(x) for x in s + p + lam]))

    def spread(self, w: np.ndarray, at: int) -> np.ndarray:
        """Back-substitution outwards from the twist."""
        x = w.copy()
        for i in range(at - 1, -1, -1):
            x[i] -= self.low[i] * x[i + 1]
        for i in range(at, len(x) - 1):
            x[i + 1] -= self.up[i] * x[i]
        return x

    def solved(self, rhs: np.ndarray) -> np.ndarray:
        """x, of unit length, along the solution of (T - lam) x = rhs."""
        at, y = int(np.argmin(np.abs(self.pivot))), rhs.copy()
        for i in range(1, at + 1):
            y[i] -= self.low[i - 1] * y[i - 1]
        for i in range(len(y) - 2, at - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        d = np.r_[self.plus[:at], self.pivot[at], self.minus[at + 1 :]]
        x = y / d
        return unit(self.spread(x / np.abs(x).max(), at))

    def vector(self) -> np.ndarray:
        """The eigenvector, read off the twist whose pivot is the least."""
        at, w = int(np.argmin(np.abs(self.pivot))), np.zeros(len(self.pivot))
        w[at] = 1.0
        return unit(self.spread(w, at))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x)


def vectors(diag: np.ndarray, above: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` leading squared singular values of a bidiagonal matrix and their right vectors, orthogonal also where values agree."""
    top = float(max(np.abs(diag).max(initial=0), np.abs(above).max(initial=0)))
    cuts = [0, *(int(i) + 1 for i in np.flatnonzero(np.abs(above) <= EPS * top)), len(diag)]
    parts = list(zip(cuts, cuts[1:], strict=False))  # blocks that hang together; vectors of different blocks are orthogonal as they stand
    order = sorted(((float(v), a, b) for a, b in parts for v in dqds(diag[a:b], above[a : b - 1])), reverse=True)[:keep]
    out, random = np.zeros((len(diag), len(order))), np.random.default_rng(11)
    for j, (lam, a, b) in enumerate(order):
        twists = Twists.of(diag[a:b], above[a : b - 1], lam)
        near = out[a:b, [i for i in range(j) if order[i][1] == a and order[i][0] - lam <= CLOSE * order[0][0]]]
        beside = lambda x, near=near: x - near @ (near.T @ x)
        z = beside(twists.vector())
        if np.linalg.norm(z) < 0.5:  # the value agrees with one before to rounding: inverse iteration beside the vectors found
            z = beside(random.standard_normal(b - a))
            for _ in range(4):
                z = beside(twists.solved(unit(z)))
        out[a:b, j] = unit(beside(unit(z)))
    return np.array([v for v, _, _ in order]), out


def directions(r: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading singular values of r, falling, their right vectors as columns, and the sum of all squares."""
    n, scale = r.shape[1], float(np.abs(r).max(initial=0))
    if not scale:
        return np.zeros(min(keep, n)), np.eye(n)[:, :keep], 0.0
    diag, above, v = bidiagonal(np.vstack([r, np.zeros((max(0, n - len(r)), n))]) / scale)
    squares, z = vectors(diag, above, keep)
    return np.sqrt(squares) * scale, v @ z, float((r / scale * (r / scale)).sum()) * scale * scale


# --- over the table ---------------------------------------------------------


def whole(vec: Column, scale: int, shift: int) -> Column:
    """floor(scale * component) + shift as longs; null for vectors that are null or hold a component that is null, not finite or too large for a long."""
    fits = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(EXACT), F.lit(False)))  # false for NaN as well: it compares as the largest value
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")))


def summed(rows: DataFrame) -> DataFrame:
    """dim, pos, n, s, high: how many vectors of a length there are, and the exact sum and the largest magnitude at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                h = held.setdefault(d, [0, np.zeros(d, object), np.zeros(d, np.int64)])
                high = np.abs(x).max(axis=0) if d else np.zeros(0, np.int64)
                fast = not d or int(high.max()) * len(x) < EXACT
                h[0], h[1], h[2] = h[0] + len(x), h[1] + (x if fast else x.astype(object)).sum(axis=0), np.maximum(h[2], high)
        for d, (n, s, high) in held.items():
            if d:
                cols = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0)), pa.array(high)]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "pos", "n", "s", "high"])

    parts = rows.select("x").mapInArrow(run, "dim int, pos int, n long, s decimal(38,0), high long")
    return parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.max("high").alias("high"))


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    high: int
    sizes: np.ndarray | None = None  # singular values over the square root of n: the roots of the leading eigenvalues
    axes: np.ndarray | None = None  # their unit vectors, as columns
    trace: float = 0.0

    def off_centre(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs while they fit, else as Python's integers."""
        if (self.high + 1) * self.n < EXACT // 2:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def squared(self, y: np.ndarray) -> list[int]:
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < EXACT:
            return (y * y).sum(axis=1).tolist()
        return (y.astype(object) ** 2).sum(axis=1).tolist()

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(float)

    def real(self) -> np.ndarray:
        """Which components have a deviation above rounding."""
        return self.sizes > 8 * EPS * len(self.sums) * self.sizes.max(initial=0)

    def explained(self) -> list[float]:
        return [float(v * v / self.trace) if self.trace else 0.0 for v in self.sizes]


TRIANGLE = "dim int, part long, r binary"


def triangle(d: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["dim", "part", "r"])


def triangles(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """One R of the centred rows for each task and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b.column(0)):
                for a in range(0, len(x) if d else 0, ROWS):
                    y = fits[d].centred(fits[d].off_centre(x[a : a + ROWS]))
                    held[d] = np.linalg.qr(np.vstack([held[d], y]) if d in held else y, mode="r")
        for d, r in held.items():
            yield triangle(d, TaskContext.get().partitionId(), r)

    return rows.select("x").mapInArrow(run, TRIANGLE)


def one_triangle(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """One R for each vector length: rounds in which up to ``FAN`` neighbouring triangles become one, each written."""

    def fold(group: pa.Table) -> pa.Table:
        d = group.column("dim")[0].as_py()
        r = np.linalg.qr(np.vstack([np.frombuffer(x.as_py()).reshape(-1, d) for x in group.column("r")]), mode="r")
        return pa.Table.from_batches([triangle(d, group.column("part")[0].as_py(), r)])

    parts = saved(triangles(rows, fits), "triangles")
    while parts.agg(F.max("part")).first()[0]:
        before = parts.withColumn("part", F.floor(F.col("part") / FAN))
        parts = saved(before.groupBy("dim", "part").applyInArrow(fold, TRIANGLE), "triangles")
    return parts


def fitted(rows: DataFrame, keep: int) -> dict[int, Fit]:
    """The fit of each vector length of ``rows`` (x); what comes to the driver is sums and ``keep`` directions."""
    sums = summed(rows).groupBy("dim").agg(F.max("n").alias("n"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))
    fits = {r["dim"]: Fit(r["n"], [int(x["s"]) for x in r["s"]], r["high"]) for r in sums.collect()}  # one row for each length

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                sizes, axes, total = directions(np.frombuffer(raw.as_py()).reshape(-1, d), keep)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([sizes.tolist()]), pa.array([axes.reshape(-1).tolist()]), pa.array([total])], ["dim", "sizes", "axes", "total"])

    if fits:
        for r in one_triangle(rows, fits).mapInArrow(solve, "dim int, sizes array<double>, axes array<double>, total double").collect():
            f = fits[r["dim"]]
            f.sizes, f.axes, f.trace = np.array(r["sizes"]) / math.sqrt(f.n), np.array(r["axes"]).reshape(r["dim"], -1), r["total"] / f.n
    return fits


def projected(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """id, dim, deviation, w: each vector's squared distance from the mean times n squared, exact (null beyond 38 digits), and its whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(b.column(1)):
                if not d:
                    continue
                f = fits[d]
                y, real = f.off_centre(x), f.real()
                far = pa.array([Decimal(v) if v < 10**38 else None for v in f.squared(y)], pa.decimal128(38, 0))
                w = f.centred(y) @ f.axes / np.where(real, f.sizes, 1.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(real)), pa.array(w.reshape(-1), mask=np.tile(~real, len(x))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(x), d, np.int32)), far, lists], ["id", "dim", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(run, "id long, dim int, deviation decimal(38,0), w array<double>")


def identity_errors(rows: DataFrame) -> DataFrame:
    """dim, identity_error: the largest entry of the covariance of ``w``, over all rows, less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = {}
            for d, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w.setdefault(d, []).append(row)
            for d, given in w.items():
                x = np.array(given, float)
                real = np.flatnonzero(~np.isnan(x[0]))
                mean = x[:, real].mean(axis=0)
                c = (x[:, real] - mean).T @ (x[:, real] - mean) + len(x) * np.outer(mean, mean)
                i, j = np.triu_indices(len(real))
                cols = [pa.array(np.full(len(i), d, np.int32)), pa.array(real[i].astype(np.int32)), pa.array(real[j].astype(np.int32)), pa.array(np.full(len(i), len(x))), pa.array(len(x) * mean[i]), pa.array(len(x) * mean[j]), pa.array(c[i, j])]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "i", "j", "n", "a", "b", "c"])

    parts = rows.select("dim", "w").mapInArrow(run, "dim int, i int, j int, n long, a double, b double, c double")
    each = parts.groupBy("dim", "i", "j").agg(*(F.sum(c).alias(c) for c in "nabc"))
    off = F.col("c") / F.col("n") - F.col("a") / F.col("n") * (F.col("b") / F.col("n")) - (F.col("i") == F.col("j")).cast("double")
    return each.groupBy("dim").agg(F.max(F.abs(off)).alias("identity_error"))


def whitened(df: DataFrame, id: str = "vec_id", vec: str = "embedding", keep: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each vector and each of its ``keep`` leading components."""
    rows = df.select(F.col(id).cast("long").alias("id"), whole(F.col(vec), scale, shift).alias("x")).where(F.col("x").isNotNull())
    fits = fitted(rows, keep)
    out = saved(projected(rows, fits), "whitened")
    errors = {r["dim"]: r["identity_error"] for r in identity_errors(out).collect()}  # one row for each length
    facts = [(d, f.n, f.explained(), errors.get(d)) for d, f in fits.items()]
    facts = df.sparkSession.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    each = out.join(F.broadcast(facts), "dim").select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "explained")).alias("p", "c"))
    return each.select("id", (F.col("p") + 1).alias("component"), "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
