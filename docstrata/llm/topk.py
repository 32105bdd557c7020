"""Exact top-k search by inner product: three-phase uniform threshold.

Vectors are cut into ``groups`` runs of dimensions (or as many as they have
dimensions, if fewer), so a pair's score is a sum
of partial scores, and a node holds one run of one block of rows.

1. Every node lists its best partial scores for each query; the best of each
   run are resolved, and the k-th best full score is the query's cutoff.
2. A row whose full score reaches the cutoff has a partial score of at least
   cutoff / runs in some run. Each node gets that bound and collects all
   entries that reach it, so no row that belongs to the answer is missed.
3. The partial scores that are still missing for collected rows are resolved
   exactly, and the best k rows of each query remain.

All queries are compared with all rows in blocks: query blocks meet row blocks
through an ordinary equality join on a salt, so neither side is broadcast.
Equal vectors are searched once, with the k + 1 smallest ids among them.

Edge cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; repeated rows count once;
equal scores go to the smaller id; vectors are compared only with vectors of
their own length, one dimension included; fewer than k candidates give fewer
rows; an empty table gives an empty result; columns other than the two used
are ignored, whatever their names. An id may stand beside several vectors:
queries of one id have one ranking, and a pair of ids the best of its scores.
Scores of 2**63 or more are given as 2**63 - 1, with their sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, saved

BLOCK_SCHEMA = "block long, dim int, n int, parts array<binary>, ids array<array<long>>"


def usable(vec: Column) -> Column:
    """Neither null nor empty, and every component finite."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(vec) > 0), F.lit(False))


def distinct_vectors(df: DataFrame, keep: int) -> DataFrame:
    """One row (z, ids) for each distinct vector; ids: the ``keep`` smallest. Tasks keep no more of a vector's rows than that, before any shuffle."""
    w = Window.partitionBy("z").orderBy("id")
    few = df.select("id", "z").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return few.groupBy("z").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def blocks(df: DataFrame, size: int, groups: int) -> DataFrame:
    """Rows (z, ids) packed into blocks of at most ``size`` vectors of one length; ``parts`` holds a matrix for each run of dimensions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows, ids = zip(*held.pop(dim), strict=True)
            z = np.vstack(rows)
            parts = [np.ascontiguousarray(x, np.float64).tobytes() for x in np.array_split(z, min(groups, dim), axis=1)]
            block = (TaskContext.get().partitionId() << 32) + made
            made += 1
            cols = [pa.array([block]), pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([parts], pa.list_(pa.binary())), pa.array([list(ids)], pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(cols, ["block", "dim", "n", "parts", "ids"])

        for b in batches:
            for z, ids in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                row = z.values.to_numpy(zero_copy_only=False)
                at = held.setdefault(len(row), [])
                at.append((row, ids))
                if len(at) == size:
                    yield out(len(row))
        for dim in list(held):
            yield out(dim)

    return df.select("z", "ids").mapInArrow(pack, BLOCK_SCHEMA)


def matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows as exact integers: in float64 while sums stay below 2**53, else in Python's integers, cut to the range of a long."""
    if fits(q, x):
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return to_long(whole(q) @ whole(x).T)


MOST = int(np.iinfo(np.int64).max)
LEAST = -MOST  # so that a score can be negated


def fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether inner products of rows of q and x are exact in float64."""
    return not q.size or not x.size or float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53


def to_long(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(p, LEAST), MOST).astype(np.int64)


def once(q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Positions of the highest score of each pair of q and vec."""
    order = np.lexsort((-score, vec, q))
    a, b = q[order], vec[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order


def best_of(q: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to smaller ``tie``."""
    order = np.lexsort((tie, -score, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else first
    return order[np.arange(len(order)) - start < k]


ENTRIES = "qb long, block long, g int, q array<int>, x array<int>, p array<long>"


def entries(pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """Partial scores of a node: those that reach cutoff / runs where the query has a cutoff (column ``cut``, by query), else the k + 1 best where ``cut`` is null, else all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                p = product(matrix(r["qdata"], r["qn"]), matrix(r["xdata"], r["n"]))
                if r["cut"] is None:
                    top = min(k + 1, p.shape[1])
                    x = np.argpartition(-p, top - 1, axis=1)[:, :top]
                    q = np.repeat(np.arange(p.shape[0]), top)
                    x = x.reshape(-1)
                else:
                    lowest = np.iinfo(np.int64).min
                    runs = min(groups, r["dim"])
                    cut = np.array([lowest if c is None else -(-c // runs) for c in r["cut"]])  # runs * p >= c
                    q, x = np.nonzero(p >= cut[:, None])
                if len(q):
                    cols = [pa.array([r["qb"]]), pa.array([r["block"]]), pa.array([r["g"]], pa.int32())]
                    cols += [pa.array([q.astype(np.int32)], pa.list_(pa.int32())), pa.array([x.astype(np.int32)], pa.list_(pa.int32())), pa.array([p[q, x]], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["qb", "block", "g", "q", "x", "p"])

    return pairs.mapInArrow(run, ENTRIES)


def resolved(found: DataFrame, qblocks: DataFrame, xblocks: DataFrame, k: int) -> DataFrame:
    """The best k rows (qb, q, query_id, vec_id, score) of each query in each block, among the entries found; missing partial scores are computed here."""
    lists = found.groupBy("qb", "block").agg(F.collect_list(F.struct("g", "q", "x", "p")).alias("lists"))
    qs = qblocks.select(F.col("block").alias("qb"), F.col("n").alias("qn"), F.col("parts").alias("qparts"), F.col("ids").alias("qids"))
    both = lists.join(qs, "qb").join(xblocks.select("block", "n", "parts", "ids"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                n = r["n"]
                keys = [np.array(e["q"], np.int64) * n + np.array(e["x"], np.int64) for e in r["lists"]]
                every = np.unique(np.concatenate(keys))
                exact = all(fits(matrix(qd, r["qn"]), matrix(xd, n)) for qd, xd in zip(r["qparts"], r["parts"], strict=True))
                total = np.zeros(len(every), np.int64 if exact else object)
                for g, (qd, xd) in enumerate(zip(r["qparts"], r["parts"], strict=True)):
                    part, known = np.zeros(len(every), total.dtype), np.zeros(len(every), bool)
                    for e, key in zip(r["lists"], keys, strict=True):
                        if e["g"] == g and exact:
                            at = np.searchsorted(every, key)
                            part[at], known[at] = e["p"], True
                    left = np.flatnonzero(~known)
                    qm, xm = matrix(qd, r["qn"]), matrix(xd, n)
                    for a in range(0, len(left), 1 << 15):
                        at = left[a : a + (1 << 15)]
                        one, two = qm[every[at] // n], xm[every[at] % n]
                        part[at] = np.einsum("ij,ij->i", one, two).astype(np.int64) if exact else [sum(int(u) * int(v) for u, v in zip(*uv, strict=True)) for uv in zip(one, two, strict=True)]
                    total += part
                total = total if exact else to_long(total)
                ids = r["ids"]
                count = np.array([len(i) for i in ids])
                flat, first = np.concatenate([np.array(i, np.int64) for i in ids]), np.r_[0, np.cumsum(count)]
                x = every % n
                rep = np.repeat(np.arange(len(every)), count[x])
                within = np.arange(len(rep)) - np.repeat(np.cumsum(count[x]) - count[x], count[x])
                vec = flat[first[x[rep]] + within]
                q, score = (every // n)[rep], total[rep]
                qid = np.array([i[0] for i in r["qids"]], np.int64)
                other = vec != qid[q]
                q, vec, score = q[other], vec[other], score[other]
                at = once(q, score, vec)
                q, vec, score = q[at], vec[at], score[at]
                at = best_of(q, score, vec, k)
                cols = [pa.array(np.full(len(at), r["qb"])), pa.array(q[at].astype(np.int32)), pa.array(qid[q[at]]), pa.array(vec[at]), pa.array(score[at])]
                yield pa.RecordBatch.from_arrays(cols, ["qb", "q", "query_id", "vec_id", "score"])

    return both.mapInArrow(run, "qb long, q int, query_id long, vec_id long, score long")


def search(queries: DataFrame, rows: DataFrame, k: int = 5, groups: int = 2, block: int = 2048, query_block: int = 256, salts: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``rows`` (id, z) for each of ``queries`` (id, z), its own id left out. z: whole numbers as doubles."""
    def packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
        """Blocks of a written table, in no more tasks than there are full blocks, so that few blocks stay part-filled."""
        vectors = saved(vectors, "vectors")
        out = saved(blocks(vectors.coalesce(max(1, -(-vectors.count() // size))), size, groups), name)
        dropped(vectors)
        return out

    xb = packed(distinct_vectors(rows, k + 1), block, "rows")
    qb = packed(queries.select("id", "z").distinct().select("z", F.array("id").alias("ids")), query_block, "queries")

    def nodes(q: DataFrame) -> DataFrame:
        left = q.select("dim", F.col("block").alias("qb"), F.col("n").alias("qn"), "cut", F.posexplode("parts").alias("g", "qdata"))
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = xb.select("dim", "block", "n", (F.col("block") % salts + F.shiftright("block", 32)).alias("_s"), F.posexplode("parts").alias("g", "xdata"))
        right = right.withColumn("salt", (F.col("_s") % salts).cast("int")).drop("_s")
        return left.join(right, ["dim", "g", "salt"]).select("dim", "qb", "qn", "cut", "block", "n", "g", "qdata", "xdata")

    listed = entries(nodes(qb.withColumn("cut", F.lit(None).cast("array<long>"))), k, groups)
    flat = listed.select("qb", "block", "g", F.explode(F.arrays_zip("q", "x", "p")).alias("e")).select("qb", "block", "g", "e.*")
    best = Window.partitionBy("qb", "g", "q").orderBy(F.desc("p"), "block", "x")
    flat = flat.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    first = flat.groupBy("qb", "block", "g").agg(F.collect_list(F.struct("q", "x", "p")).alias("e")).select("qb", "block", "g", "e.q", "e.x", "e.p")
    ranked = Window.partitionBy("qb", "q").orderBy(F.desc("score"), "vec_id")
    tops = resolved(first, qb, xb, k).groupBy("qb", "q", "vec_id").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == k)
    cuts = saved(tops.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("q", "score"))).alias("cuts")), "cutoffs")
    aligned = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at(F.col("cuts"), i))
    bounded = qb.join(cuts.withColumnRenamed("qb", "block"), "block", "left").withColumn("cuts", F.coalesce("cuts", F.create_map().cast("map<int,long>"))).withColumn("cut", aligned).drop("cuts")
    full = resolved(entries(nodes(bounded), k, groups), qb, xb, k)
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = full.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def whole_numbers(vec: Column, scale: int = 256) -> Column:
    """floor(scale * component), in double precision."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
