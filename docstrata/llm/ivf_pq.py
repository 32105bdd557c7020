"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (``sample`` vectors of
smallest hash); every vector is indexed. A query probes its nearest lists,
bounds the distances of their codes by asymmetric tables and each vector's
quantisation error, and measures exactly, on the original vectors, all of a
block that can be among its k best. So only lists that are not probed cost
recall. The number of lists to probe is the smallest that holds the share
``target`` of the true neighbours of sample queries within the sample.

Lists are stored in blocks dealt out by list and salt, one salt for each
``block`` vectors of the list, and queries are packed by list, so a list that
holds a third of all vectors, or that every query probes, is searched by as
many tasks as its size asks. Equal vectors are stored once with the
k + 1 smallest ids among them.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; repeated rows count once;
vectors of different lengths are searched apart; fewer than k candidates give
fewer rows; an empty table gives an empty result; equal distances go to the
smaller id; columns other than the two used are ignored, whatever their names.
An id may stand beside several vectors: queries of one id have one ranking,
and a pair of ids the least of its distances. Where components pass ``LARGE``,
lists and codes are made of vectors scaled down by a power of two; distances
are of the vectors as they are, and infinite only where no double holds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, saved
from .topk import best_of, distinct_vectors, once
from .topk import usable as finite

RESULT = "query_id long, vec_id long, score double"
PAIRS = 1 << 14  # pairs of vectors that are measured at a time
LARGE = 1e100  # components whose squares are still far from the largest double
SAMPLE_BYTES = 64 << 20
ROUNDING = 1e-6  # more than the rounding of tabled distances, as a share of the lengths they come from


def usable(vec: Column) -> Column:
    """Finite, not empty and not zero."""
    return finite(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a from the row of b."""
    off = a - b
    top = np.abs(off).max(axis=1, initial=0)
    unit = np.where(top > LARGE, top, 1.0)
    return np.where(np.isfinite(top), unit * np.sqrt(((off / unit[:, None]) ** 2).sum(axis=1)), np.inf)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; an empty cluster is put on the row farthest from its centre."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = squared(x, c)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        far = np.argsort(-d[np.arange(len(x)), own])
        new = np.zeros_like(c)
        for j in range(x.shape[1]):
            new[:, j] = np.bincount(own, weights=x[:, j], minlength=len(c))
        new[n > 0] /= n[n > 0, None]
        new[n == 0] = x[far[: (n == 0).sum()]]
        c = new
    return c


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: list[np.ndarray]  # one for each run of dimensions
    probes: int
    scale: float = 1.0  # of the vectors it was fitted on

    def runs(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.codebooks), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x * self.scale
        own = squared(x, self.centroids).argmin(1)
        rest = x - self.centroids[own]
        codes = [squared(part, book).argmin(1).astype(np.uint8) for part, book in zip(self.runs(rest), self.codebooks, strict=True)]
        return own, np.stack(codes, axis=1)

    def nearest_lists(self, q: np.ndarray) -> np.ndarray:
        d = squared(q * self.scale, self.centroids)
        return np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes]

    def search(self, q: np.ndarray, lst: int, codes: np.ndarray, vecs: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and vector positions with exact distances, of each query's ``keep`` nearest vectors in a block and all as near as the last."""
        rest = q * self.scale - self.centroids[lst]
        adc, size = np.zeros((len(q), len(codes))), np.sqrt((rest * rest).sum(axis=1))[:, None]
        for j, (part, book) in enumerate(zip(self.runs(rest), self.codebooks, strict=True)):
            adc += squared(part, book)[:, codes[:, j]]
        adc = np.sqrt(adc, out=adc)
        coded = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.codebooks)], axis=1)
        own = vecs * self.scale - self.centroids[lst]
        # A vector is at most its quantisation error nearer or farther than its code; the last term covers rounding.
        error = np.sqrt(((own - coded) ** 2).sum(axis=1)) + ROUNDING * (size + np.sqrt((own * own).sum(axis=1)) + np.sqrt((coded * coded).sum(axis=1)))
        top = min(keep, len(codes)) - 1
        cut = np.partition(adc + error, top, axis=1)[:, top]
        qi, x = np.nonzero(adc - error <= cut[:, None])
        d = np.empty(len(qi))
        for a in range(0, len(qi), PAIRS):
            at = slice(a, a + PAIRS)
            d[at] = distances(q[qi[at]], vecs[x[at]])
        first = np.searchsorted(qi, np.arange(len(q) + 1))
        far = np.array([np.partition(d[a:b], top)[top] for a, b in zip(first, first[1:], strict=False)])
        near = d <= far[qi]
        return qi[near], x[near], d[near]


def fit(x: np.ndarray, rows: int, k: int, target: float, subspace: int = 4, seed: int = 3) -> Index:
    """An index over ``rows`` vectors, from the sample ``x``."""
    lists = int(min(max(1, round(rows**0.5 / 2)), 4096, len(x)))
    c = k_means(x, lists, 8, seed)
    own = squared(x, c).argmin(1)
    rest = (x - c[own])[:8192]
    books = [k_means(part, min(256, len(part)), 6, seed + j) for j, part in enumerate(np.array_split(rest, max(1, x.shape[1] // subspace), axis=1))]
    ask = x[:200]
    d = squared(ask, x)
    d[np.arange(len(ask)), np.arange(len(ask))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(squared(ask, c), axis=1), axis=1)
    depth = np.sort(rank[np.arange(len(ask))[:, None], own[near]].reshape(-1))
    probes = int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]) + 1
    return Index(c, books, min(probes, lists))


def _search_one(queries: DataFrame, rows: DataFrame, n_queries: int, k: int, sample: int, target: float, block: int) -> DataFrame:
    dim, many, top = rows.agg(F.max(F.size("z")), F.count("*"), F.max(F.array_max(F.transform("z", F.abs)))).first()
    if not many:
        return rows.sparkSession.createDataFrame([], RESULT)
    picked = rows.select("z").orderBy(F.xxhash64("z")).limit(min(sample, max(256, SAMPLE_BYTES // (8 * dim)))).toArrow().column(0).combine_chunks()
    scale = 1.0 if top <= LARGE else 2.0 ** math.floor(math.log2(LARGE) - math.log2(top))
    index = fit(picked.flatten().to_numpy().reshape(-1, dim) * scale, many, k, target)
    index.scale = scale

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).values.to_numpy(zero_copy_only=False)[b.column(0).offsets[0].as_py() :].reshape(b.num_rows, -1)
                own, codes = index.encode(x)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array([v.tobytes() for v in x]), b.column(1)], ["lst", "code", "vec", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            codes, vecs, ids = zip(*held, strict=True)
            cols = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([b"".join(codes)]), pa.array([b"".join(vecs)]), pa.array([list(ids)], pa.list_(pa.list_(pa.int64())))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["lst", "salt", "n", "codes", "vecs", "ids"])

        for b in batches:
            for lst, salt, *row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if held and ((lst, salt) != key or len(held) == block):
                    yield out()
                key = (lst, salt)
                held.append(row)
        if held:
            yield out()

    coded = saved(rows.select("z", "ids").mapInArrow(encode, "lst int, code binary, vec binary, ids array<long>"), "coded")
    salts = coded.groupBy("lst").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))  # one row for each list
    salts = F.broadcast(saved(salts, "salts"))
    dealt = coded.join(salts, "lst").select("lst", F.pmod(F.xxhash64("vec"), "salts").cast("int").alias("salt"), "code", "vec", "ids").repartition("lst", "salt").sortWithinPartitions("lst", "salt")
    stored = saved(dealt.mapInArrow(pack, "lst int, salt int, n int, codes binary, vecs binary, ids array<array<long>>"), "lists")
    dropped(coded)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() :].reshape(b.num_rows, -1)
                lists = index.nearest_lists(q)
                at = np.repeat(np.arange(len(q)), lists.shape[1])
                raw = [v.tobytes() for v in q]
                yield pa.RecordBatch.from_arrays([pa.array(lists.reshape(-1).astype(np.int32)), b.column(0).take(pa.array(at)), pa.array([raw[i] for i in at])], ["lst", "id", "vec"])

    chunks = max(1, -(-n_queries // 256))
    asked = queries.select("id", "z").mapInArrow(probe, "lst int, id long, vec binary")
    packed = asked.groupBy("lst", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("id", "vec")).alias("q"))
    packed = packed.join(salts, "lst").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = packed.join(stored, ["lst", "salt"]).select("lst", "q.id", "q.vec", "n", "codes", "vecs", "ids")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                n, qid = r["n"], np.array(r["id"], np.int64)
                q = np.frombuffer(b"".join(r["vec"]), np.float64).reshape(len(qid), -1)
                count = np.array([len(i) for i in r["ids"]])
                flat, first = np.concatenate([np.array(i, np.int64) for i in r["ids"]]), np.cumsum(count) - count
                shared = int(np.unique(flat, return_counts=True)[1].max())  # vectors of one id
                qi, x, d = index.search(q, r["lst"], np.frombuffer(r["codes"], np.uint8).reshape(n, -1), np.frombuffer(r["vecs"], np.float64).reshape(n, -1), (k + 1) * shared)
                rep = np.repeat(np.arange(len(x)), count[x])
                vec = flat[first[x[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(count[x]) - count[x], count[x])]
                qi, d = qi[rep], d[rep]
                other = vec != qid[qi]
                qi, d, vec = qi[other], d[other], vec[other]
                at = once(qi, -d, vec)
                qi, d, vec = qi[at], d[at], vec[at]
                at = best_of(qi, -d, vec, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[qi[at]]), pa.array(vec[at]), pa.array(d[at])], ["query_id", "vec_id", "score"])

    return both.mapInArrow(look, RESULT)


def search(queries: DataFrame, rows: DataFrame, k: int = 10, sample: int = 16_384, target: float = 0.97, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the neighbours found in ``rows`` (id, z) of ``queries`` (id, z), own ids left out."""
    few = saved(distinct_vectors(rows, k + 1), "vectors")
    ask = queries.select("id", "z").distinct()
    sizes = ask.groupBy(F.size("z").alias("d")).count().collect()  # one row for each vector length
    found = rows.sparkSession.createDataFrame([], RESULT)
    for r in sizes:
        mine = F.size("z") == r["d"]
        found = found.union(_search_one(ask.where(mine), few.where(mine), r["count"], k, sample, target, block))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
