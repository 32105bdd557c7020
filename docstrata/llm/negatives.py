"""Hard negatives: anchor clusters share lists of candidates sorted by angular upper bounds.

An anchor's positives are its best rows of the same label. Its negatives, for
each positive, are the best rows of other labels whose score lies in a band
below the positive's. Scores are inner products of whole numbers.

Anchors are packed by cluster. For a pack and a block of candidates, with an
axis through the pack and the largest angle between the axis and a member, no
member's score with a candidate x exceeds |member| |x| cos(angle(axis, x) -
that angle). The block is sorted by this bound once for the pack, and every
member walks the same list, in steps of growing length, until what it has
found is certain: its k-th score within the band lies above the bound of all
that follows, or that bound lies below the band. Only then are members let go,
so the results are exact.

Positives come from packs of one label, which meet only blocks that hold it;
negatives from packs by cluster. Packs and blocks are cut from tables sorted by
range, id last, so a label, a cluster or a list of any size is dealt out to as
many tasks as it needs. They meet by a salt that grows with the number of
blocks. Centroids of clusters are fitted on ``sample`` anchors (of smallest
hash) and decide nothing but who shares a list.

Edge cases: rows with a null id or label, and vectors that are null, empty or
hold null or non-finite components take no part; of rows that share an id, that
with the smallest label, then the smallest vector, stands for all, so repeated
rows count once; equal scores go to the smaller id; vectors are compared only
with vectors of their own length; scores of 2**63 or more are given as 2**63 - 1,
with their sign; a positive below zero has an empty band; fewer candidates give fewer
rows; an anchor without positives or a pair without negatives gives none; an
empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .ivf_pq import k_means, squared
from .shared import by_length, saved
from .topk import LEAST, MOST, best_of, matrix, product

PACK, BLOCK_BYTES = 64, 1 << 20  # members of a pack, and bytes of a block's vectors
BATCH = 4  # pairs of pack and block in an Arrow batch
SLACK = 1e-7  # more than the rounding of an angle


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, of any size a double holds."""
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def units(x: np.ndarray) -> np.ndarray:
    size = lengths(x)
    return x / np.where(size > 0, size, 1)[:, None]


def bounds(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of x, the most that a member of u can score with it for each unit of the member's length."""
    one = units(u)
    axis = units(one.sum(axis=0)[None])[0]
    if not axis.any():
        axis = np.eye(1, x.shape[1])[0]  # members that cancel out
    angle = lambda y: np.arccos(np.clip(units(y) @ axis, -1, 1))
    return lengths(x) * (np.cos(np.clip(angle(x) - angle(u).max() - SLACK, 0, np.pi)) + SLACK)


def walk(u: np.ndarray, x: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ids: np.ndarray, first: int = 64) -> tuple[np.ndarray, ...]:
    """Member, band, row of x and score: for each member of u and each of its bands, the k best scores from low to high among the rows that it may take."""
    bound = bounds(u, x)
    order = np.argsort(-bound, kind="stable")
    size, (m, n) = lengths(u), may.shape
    score, met, left, at, step = np.zeros((m, n), np.int64), np.zeros((m, n), bool), np.arange(m), 0, first
    may = may[:, order]
    while at < n and len(left):
        score[left, at : at + step] = product(u[left], x[order[at : at + step]])
        met[left, at : at + step] = may[left, at : at + step]
        at, step = min(n, at + step), 2 * step
        if at < n:
            most = size[left] * bound[order[at]]
            certain = met[left, :at] & (score[left, :at] > most[:, None])
            sure = np.ones(len(left), bool)
            for lo, hi in zip(low[left].T, high[left].T, strict=True):
                s = score[left, :at]
                sure &= (lo > hi) | (most < lo) | ((certain & (s >= lo[:, None]) & (s <= hi[:, None])).sum(axis=1) >= k)
            left = left[~sure]
    out = []
    for j in range(low.shape[1]):
        q, c = np.nonzero(met & (score >= low[:, j : j + 1]) & (score <= high[:, j : j + 1]))
        s = score[q, c]
        best = best_of(q, s, ids[order[c]], k)
        out.append((q[best], np.full(len(best), j), order[c[best]], s[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 4


def packed(rows: DataFrame, keys: list[str], size: int | None = None, scores: str | None = None) -> DataFrame:
    """Rows (id, label, z) sorted by ``keys`` and packed: ``size`` members of equal keys, or as many as fill ``BLOCK_BYTES``; of one vector length always."""
    schema = "pack long, dim int, n int, lo long, hi long, ids array<long>, labels array<long>, data binary" + (", scores array<array<long>>" if scores else "")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, key = 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal made
            dim, ids, labels, vecs, more = zip(*held, strict=True)
            row = [(TaskContext.get().partitionId() << 32) + made, dim[0], len(held), min(labels), max(labels), list(ids), list(labels), b"".join(vecs)] + [list(more)] * bool(scores)
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=False)], [c.split()[0] for c in schema.split(", ")])

        for b in batches:
            flat, at = b.column("z").values.to_numpy(zero_copy_only=False), b.column("z").offsets.to_numpy()
            for i, (uid, label, more, *own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "label", "more", *(f"k{i}" for i in range(len(keys))))), strict=True)):
                dim = int(at[i + 1] - at[i])
                here = (dim, *own) if size else (dim,)
                if held and (here != key or len(held) >= (size or max(1, BLOCK_BYTES // (8 * dim)))):
                    yield out()
                key = here
                held.append((dim, uid, label, flat[at[i] : at[i + 1]].tobytes(), more))
        if held:
            yield out()

    more = F.col(scores) if scores else F.lit(None).cast("array<long>")
    order = [f"k{i}" for i in range(len(keys))]
    given = rows.select("id", "label", "z", F.size("z").alias("dim"), more.alias("more"), *(F.col(k).alias(o) for k, o in zip(keys, order, strict=True)))
    dealt = given.repartitionByRange(max(1, -(-rows.count() // 4096)), "dim", *order, "id").sortWithinPartitions("dim", *order, "id")
    return dealt.mapInArrow(run, schema)


def clustered(anchors: DataFrame, sample: int) -> DataFrame:
    """``anchors`` with the number of the nearest of centroids, fitted for each vector length on the directions of a bounded sample."""
    many = anchors.count()
    some = anchors.select("z").orderBy(F.xxhash64("z")).limit(sample).toArrow().column("z").combine_chunks()
    centres = {d: k_means(units(x), int(min(len(x), 1024, max(1, many // PACK))), 6, 7) for d, _, x in by_length(some)} if len(some) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.zeros(b.num_rows, np.int32)
            for d, at, x in by_length(b.column("z")):
                if d in centres:
                    own[at] = squared(units(x), centres[d]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "cluster"])

    return anchors.mapInArrow(run, StructType([*anchors.schema.fields, StructField("cluster", IntegerType())]))


def looked_up(packs: DataFrame, blocks: DataFrame, k: int, percents: tuple[int, int] | None) -> DataFrame:
    """query, band, id, score of the k best of each block, for each member and band of each pack. Without ``percents``, of the member's own label and one band that is open; else of others, and bands between those shares of ``scores``."""
    many = blocks.count()
    salts = max(min(many, 24), -(-many // 8))
    left = packs.select("dim", F.col("lo").alias("label"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("labels").alias("qlabels"), F.col("data").alias("qdata"), "scores" if percents else F.lit(None).alias("scores"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(0, salts - 1)))))
    right = blocks.withColumn("salt", F.pmod(F.col("pack") + F.shiftright("pack", 32), F.lit(max(1, salts))).cast("int"))
    both = left.join(right, ["dim", "salt"])
    if not percents:
        both = both.where(F.col("label").between(F.col("lo"), F.col("hi")))
    names = ["qn", "qids", "qlabels", "qdata", "scores", "n", "ids", "labels", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qn, qids, qlabels, qdata, scores, n, ids, labels, data = (b.column(c)[i].as_py() for c in names)
                qids, ids, same = np.array(qids), np.array(ids), np.array(qlabels)[:, None] == np.array(labels)[None]
                if percents:
                    wide = max(map(len, scores))
                    limits = [[(-(-s * percents[0] // 100), s * percents[1] // 100) for s in row] + [(MOST, LEAST)] * (wide - len(row)) for row in scores]
                    low, high, may = *np.moveaxis(np.array(limits, np.int64).reshape(qn, wide, 2), 2, 0), ~same
                else:
                    low, high, may = np.full((qn, 1), LEAST), np.full((qn, 1), MOST), same & (qids[:, None] != ids[None])
                q, band, x, s = walk(matrix(qdata, qn), matrix(data, n), may, low, high, k, ids)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(band.astype(np.int32)), pa.array(ids[x]), pa.array(s)], ["query", "band", "id", "score"])

    return both.select(*names).mapInArrow(run, "query long, band int, id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (id, label, z) that ``anchor`` picks; z: whole numbers as doubles. A negative's score is ``low`` to ``high`` percent of its positive's."""
    one = rows.groupBy("id").agg(F.min(F.struct("label", "z")).alias("r")).select("id", F.col("r.label").cast("long").alias("label"), "r.z")
    one = saved(one, "vectors")
    anchors = saved(clustered(one.where(anchor), sample), "anchors")
    blocks = saved(packed(one, ["label"]), "blocks")
    own = saved(packed(anchors, ["label", "cluster"], PACK), "packs")
    near = saved(best(looked_up(own, blocks, positives, None), positives), "positives", BATCH)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    asked = saved(anchors.join(lists, anchors["id"] == lists["query"]).select("id", "label", "z", "cluster", F.col("near.score").alias("scores")), "asked")
    mixed = saved(packed(asked, ["cluster"], PACK, "scores"), "packs")
    hard = best(saved(looked_up(mixed, blocks, negatives, (low, high)), "negatives", BATCH), negatives)
    pairs = near.select(F.col("query").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("band"))
    hard = hard.select(F.col("query").alias("anchor_id"), "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(hard, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
