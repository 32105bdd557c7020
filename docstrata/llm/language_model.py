"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: tasks count bigrams of their own texts, and send the counts, packed
by hash bucket, to the bucket's reducer, which adds them up and stores the
bucket as arrays sorted by hash. A second, smaller exchange does the same for
words (counts, successors by count, distinct predecessors). Scoring tasks
memory-map these arrays and look up what their texts hold; the pages of the
files are shared by all workers of a machine, and nothing of the model passes
through the driver but eight counts of counts and two totals.

Where ``spark.checkpoint.dir`` is a mounted folder the arrays are mapped in
place; in an object store or HDFS, executors fetch the files themselves
(``SparkContext.addFile``) and map their copy.

All bigrams are stored. With ``least`` = 2 those seen once are not: their mass
goes to the back-off weight of their context, and probabilities still add up
to one. Words and pairs are told apart by 64-bit hash.

Edge cases: a null or empty text is the end token alone; a very long text is
one numpy pass; repeated rows and ids count and are scored each time; a null
id counts as a training row; sums are exact counts, so there are no ties; an
empty table gives an empty result, and with no training text the base score is
0 and the model is uniform over one unknown word; columns other than doc_id
and text are ignored, whatever their names. A missing model folder is an error.
"""

from __future__ import annotations

import os
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import mixed, slices, word_hashes
from .shared import held_out, lean, saved, table_path

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
DONE = "whole"  # a file that stands beside a model's buckets when all are written
PER_BUCKET = 12 << 20  # bytes of text whose counts meet in one bucket
LOOKED_UP = 2 << 20  # bytes of text whose look-ups are sorted by bucket and made together
FLUSH = 3_000_000  # bigrams that a task holds before it sends them on
HOT = 1 / 2048  # a context of more than this share is dealt out over buckets by its successors


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and targets of every token (words, then the end), and the number of tokens of each text."""
    words, count = word_hashes(texts)
    first = np.cumsum(count + 1) - (count + 1)
    total = int((count + 1).sum())
    is_end = np.zeros(total, bool)
    is_end[first + count] = True
    target = np.full(total, END)
    target[~is_end] = words
    context = np.full(total, START)
    context[1:] = target[:-1]
    context[first] = START
    return context, target, count + 1


def pair_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mixed(h1 * np.uint64(0x9E3779B97F4A7C15) + mixed(h2))


@dataclass
class Layout:
    bits: int  # 2**bits buckets
    hot: np.ndarray  # contexts dealt out by successor, sorted; at most 1/HOT

    def of_word(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_pair(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return self.of_word(h1)
        at = np.minimum(np.searchsorted(self.hot, h1), len(self.hot) - 1)
        return self.of_word(np.where(self.hot[at] == h1, pair_key(h1, h2), h1))


def summed(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of each value array over equal keys; keys come back sorted."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, [v.astype(np.int64) for v in values]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order].astype(np.int64), at) for v in values]


def _blob(*arrays: np.ndarray) -> bytes:
    """Hashes as they are; counts deflated, as most are 0 or 1."""
    return pickle.dumps([a if a.dtype == np.uint64 else zlib.compress(a.astype(np.uint32).tobytes(), 1) for a in arrays])


def _unblob(data: bytes) -> list[np.ndarray]:
    return [a if isinstance(a, np.ndarray) else np.frombuffer(zlib.decompress(a), np.uint32).astype(np.int64) for a in pickle.loads(data)]


def _rows(bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    names, at = np.unique(bucket, return_index=True)
    blobs = [_blob(*(a[x:y] for a in arrays)) for x, y in zip(at, np.r_[at[1:], len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["bucket", "data"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Joined arrays of each bucket, from rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = bucket
            held.append(_unblob(data))
    if held:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


def _store(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Writes arrays of one length into one file, under its final name only when whole, so a task that runs again changes nothing."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    path = f"{root}/{name}"
    mine = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(mine, path)


@dataclass
class Model:
    folder: str
    local: bool
    layout: Layout
    least: int
    tokens: int  # N
    vocabulary: int  # V
    continuations: int
    discounts: tuple[float, float, float, float]  # of bigram counts 0, 1, 2, 3 and more
    low_discounts: tuple[float, float, float, float]
    low_backoff: float

    def opened(self, name: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
        """The arrays of a bucket, mapped; a bucket that nothing fell into has no file."""
        path = self.folder if self.local else SparkFiles.get(self.folder.rsplit("/", 1)[-1])
        if not os.path.exists(f"{path}/{DONE}"):
            raise FileNotFoundError(f"the model's folder {path} is not there: spark.checkpoint.dir has to be one that all executors share")
        file = f"{path}/{name}"
        if not os.path.exists(file):
            return [np.zeros(0, kind) for kind in kinds]
        data = np.memmap(file, np.uint8, "r")
        wide = [np.dtype(kind).itemsize for kind in kinds]
        n = len(data) // sum(wide)
        at = np.cumsum([0, *wide]) * n
        return [data[x:y].view(kind) for x, y, kind in zip(at, at[1:], kinds, strict=False)]

    def find(self, kind: str, types: tuple[type, ...], bucket: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """Values stored for sorted keys' buckets; zeros where there is none."""
        out = [np.zeros(len(key), np.int64) for _ in types[1:]]
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        for name, x, y in zip(names, at, np.r_[at[1:], len(key)], strict=True):
            stored = self.opened(f"{kind}{name}", types)
            if not len(stored[0]):
                continue
            mine = order[x:y]
            pos = np.minimum(np.searchsorted(stored[0], key[mine]), len(stored[0]) - 1)
            hit = stored[0][pos] == key[mine]
            for o, s in zip(out, stored[1:], strict=True):
                o[mine[hit]] = s[pos[hit]]
        return out

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability, base log10 probability and training count of every token."""
        both, back = np.unique(np.r_[context, target], return_inverse=True)
        types = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)
        count, n1, n2, n3, cont = self.find("w", types, self.layout.of_word(both), both)
        end = np.searchsorted(both, END)
        if end < len(both) and both[end] == END:
            s = np.array([START])
            count[end] = self.find("w", types, self.layout.of_word(s), s)[0][0]  # as many ends as starts
        c, t = back[: len(context)], back[len(context) :]
        d, low = np.array(self.discounts), np.array(self.low_discounts)
        p1 = (np.maximum(cont - low[np.minimum(cont, 3)], 0) / max(self.continuations, 1)) + self.low_backoff / (self.vocabulary + 1)
        once = d[1] if self.least < 2 else 1.0  # bigrams that are not stored give all their mass to the back-off
        gamma = np.where(count > 0, (once * n1 + d[2] * n2 + d[3] * n3) / np.maximum(count, 1), 1.0)
        gamma = np.where(both == END, 1.0, gamma)
        pair = pair_key(context, target)
        keys, first, inv = np.unique(pair, return_index=True, return_inverse=True)
        (seen,) = self.find("b", (np.uint64, np.uint32), self.layout.of_pair(context[first], target[first]), keys)
        k = seen[inv]
        p = np.maximum(k - d[np.minimum(k, 3)], 0) / np.maximum(count[c], 1) + gamma[c] * p1[t]
        base = (count[t] + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))
        return np.log10(p), np.log10(base), count[t]


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts from the number of items seen 1, 2, 3 and 4 times; half the count where these are too few."""
    n1, n2, n3, n4 = n
    if not n1 or not n2 or not n3:
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return 0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def count_model(train: DataFrame, least: int = 1) -> Model:
    """Counts all texts of ``train`` (text) and stores the model in the shared folder."""
    spark = train.sparkSession

    def glance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b, 0):
                h, n = np.unique(sequences(texts)[0], return_counts=True)
                often = n * 2000 >= n.sum()
                size = pa.array(np.r_[sum(map(len, texts)), np.zeros(often.sum(), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.uint64(0), h[often]].view(np.int64)), pa.array(np.r_[0, n[often]]), pa.array(np.r_[n.sum(), np.zeros(often.sum(), np.int64)]), size], ["h", "n", "all", "bytes"])

    # Only the layout depends on this glance at one row in a hundred: results are the same for any layout.
    seen = train.sample(0.01, seed=1).mapInArrow(lean(glance), "h long, n long, all long, bytes long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.sum("bytes").alias("bytes"))
    top = seen.orderBy(F.desc("bytes"), F.desc("n")).limit(int(1 / HOT)).collect()
    size, every = sum(r["bytes"] for r in top) * 100, sum(r["all"] for r in top)
    hot = np.sort(np.array([r["h"] for r in top if r["n"] > HOT * every], np.int64).view(np.uint64))
    layout = Layout(max(4, int(size / PER_BUCKET).bit_length()), hot)
    folder = table_path(spark, "model")
    fs_local = folder.startswith("file:")
    mounted = "/" + folder.removeprefix("file:").lstrip("/")
    uri = f"file://{mounted}" if fs_local else folder

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            (h1, h2), (n,) = summed(tuple(np.concatenate(x) for x in list(zip(*held, strict=True))[:2]), (np.concatenate([x[2] for x in held]),))
            held.clear()
            return _rows(layout.of_pair(h1, h2), [h1, h2, n])

        for b in batches:
            for _, texts in slices(b, 0):
                h1, h2, _ = sequences(texts)
                (h1, h2), (n,) = summed((h1, h2), (np.ones(len(h1), np.int64),))
                held.append((h1, h2, n))
                size += len(h1)
                if size > FLUSH:
                    yield out()
                    size = 0
        if held:
            yield out()

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.append_column("times", pa.nulls(rows.num_rows, pa.list_(pa.int64())))

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, times = [], 0, np.zeros(5, np.int64)

        def out() -> pa.RecordBatch:
            (h,), v = summed((np.concatenate([x[0] for x in held]),), tuple(np.concatenate([x[k] for x in held]) for k in range(1, 6)))
            held.clear()
            return _rows(layout.of_word(h), [h, *v])

        for bucket, arrays in _grouped(batches):
            (h1, h2), (n,) = summed((arrays[0], arrays[1]), (arrays[2],))
            times += np.bincount(np.minimum(n, 5), minlength=6)[1:6]
            keep = n >= least
            key = pair_key(h1[keep], h2[keep])
            order = np.argsort(key)
            _store(uri, f"b{bucket}", key[order], n[keep][order].astype(np.uint32))
            one = np.zeros(len(n), np.int64)
            (h,), v = summed((np.r_[h1, h2],), (np.r_[n, one], np.r_[n == 1, one], np.r_[n == 2, one], np.r_[n > 2, one], np.r_[one, one + 1]))
            held.append((h, *v))
            size += len(h)
            if size > FLUSH:
                yield told(out())
                size = 0
        if held:
            yield told(out())
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""]), pa.array([times.tolist()], pa.list_(pa.int64()))], ["bucket", "data", "times"])

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket")

    pairs = saved(by_bucket(train.mapInArrow(lean(spread), "bucket long, data binary")).mapInArrow(lean(add_pairs), "bucket long, data binary, times array<long>"), "words")

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, arrays in _grouped(batches):
            (h,), v = summed((arrays[0],), tuple(arrays[1:]))
            _store(uri, f"w{bucket}", h, *(x.astype(np.uint32) for x in v))
            n, cont = v[0], v[4]
            sums = [n.sum(), (n > 0).sum(), cont.sum(), *np.bincount(np.minimum(cont[cont > 0], 5), minlength=6)[1:5]]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], list("abcdefg"))

    totals = by_bucket(pairs.where("bucket >= 0").select("bucket", "data")).mapInArrow(lean(add_words), "a long, b long, c long, d long, e long, f long, g long")
    s = [x or 0 for x in totals.agg(*(F.sum(c) for c in "abcdefg")).first()]
    times = [x or 0 for x in pairs.where("bucket < 0").agg(*(F.sum(F.get("times", k)) for k in range(4))).first()]
    low = discounts(s[3:7])
    types = np.array([*s[3:5], 0], float)
    types[2] = s[1] - s[3] - s[4]
    backoff = (low[1] * types[0] + low[2] * types[1] + low[3] * max(types[2], 0)) / s[2] if s[2] else 1.0
    _store(uri, DONE)
    if not fs_local:
        spark.sparkContext.addFile(folder, recursive=True)
    return Model(mounted if fs_local else folder, fs_local, layout, least, s[0], s[1], s[2], discounts(times), low, backoff)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b, 1, LOOKED_UP):
                context, target, n = sequences(texts)
                p, base, count = model.log_probs(context, target)
                first = np.cumsum(n) - n
                cols = [part.column(0), pa.array(n), *(pa.array(np.add.reduceat(x, first)) for x in ((count > 0).astype(np.int64), base, p))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity_scores(spark: SparkSession, docs: DataFrame, fold: int = 5, least: int = 1) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod ``fold`` is not 1, scores all, with perplexity a token."""
    model = count_model(docs.where(~held_out("doc_id", fold)).select("text"), least)
    s = score(docs, model).withColumn("held_out", held_out("doc_id", fold)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return s.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
