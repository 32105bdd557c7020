"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the
whole text, each chunk is max-pooled, and the chunk maxima are combined
(largest and mean over chunks) into one probability.

Edge cases: a null or empty text is one chunk of padding and gets a score; a
very long text is pooled slice by slice; a score hangs on the row's own text
alone, so repeated rows, and rows in any order or partition, score the same; a
score of exactly 0.5 counts as good; rows with a null id are scored; labels
that are null are ignored; with no usable labels every score is 0.5; with one
class only, the network learns that class; an empty table gives an empty
result; columns other than doc_id and text are never read, whatever their
names, and ``kept`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out, lean

WIDTH, STRIDE, HOP = 8, 2, 256  # filter width, its step, and new bytes a chunk; a chunk reads HOP + WIDTH - STRIDE bytes
SLICE = 1 << 19  # padded bytes that one numpy pass works on; long texts are cut at chunk borders, and their pools merged


@dataclass
class ByteConvNet:
    emb: np.ndarray  # 256 x E
    filt: np.ndarray  # WIDTH*E x N
    bias: np.ndarray  # N
    out_w: np.ndarray  # 2N
    out_b: float

    @classmethod
    def fresh(cls, dims: int, filters: int, seed: int) -> ByteConvNet:
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.5, (256, dims)).astype(np.float32)
        filt = r.normal(0, 1 / np.sqrt(WIDTH * dims), (WIDTH * dims, filters)).astype(np.float32)
        return cls(emb, filt, np.zeros(filters, np.float32), np.zeros(2 * filters, np.float32), 0.0)

    def responses(self, data: np.ndarray) -> list[np.ndarray]:
        """One array (chunks, HOP/WIDTH, N) for each of the WIDTH/STRIDE offsets; data: chunks * HOP bytes and WIDTH more."""
        chunks = (len(data) - WIDTH) // HOP
        dims = self.emb.shape[1]
        e = self.emb[data]
        return [(e[o : o + chunks * HOP].reshape(-1, WIDTH * dims) @ self.filt).reshape(chunks, HOP // WIDTH, -1) for o in range(0, WIDTH, STRIDE)]

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(chunks, N): the largest rectified response in each chunk."""
        best = None
        for r in self.responses(data):
            m = r.max(axis=1)
            best = m if best is None else np.maximum(best, m, out=best)
        return np.maximum(best + self.bias, 0)

    def probability(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.hstack([top, mean]).astype(np.float64) @ self.out_w.astype(np.float64) + self.out_b
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded to whole chunks in one array, the chunks that hold text, and the place of each text's first among these.

    An empty chunk follows every text: the last windows of a text reach into
    it, and not into the next text.
    """
    n = np.array([max(1, -(-len(t) // HOP)) for t in texts])
    begin = np.cumsum(n + 1) - (n + 1)
    data = np.zeros((n + 1).sum() * HOP + WIDTH, np.uint8)
    for t, c in zip(texts, begin, strict=True):
        data[c * HOP : c * HOP + len(t)] = np.frombuffer(t, np.uint8)
    real = np.ones((n + 1).sum(), bool)
    real[begin + n] = False
    return data, np.flatnonzero(real), np.r_[0, np.cumsum(n)]


def scores(net: ByteConvNet, texts: list[bytes]) -> np.ndarray:
    """A probability for each whole text, from its own bytes alone; work arrays stay below a few SLICE bytes whatever a text's length."""
    out = np.empty(len(texts))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) + 2 * HOP <= SLICE):
            size += len(texts[j]) + 2 * HOP
            j += 1
        data, real, first = laid_out(texts[i:j])
        step, chunks = SLICE // HOP, (len(data) - WIDTH) // HOP
        p = np.vstack([net.pooled(data[a * HOP : min(a + step, chunks) * HOP + WIDTH]) for a in range(0, chunks, step)])[real]
        top = np.maximum.reduceat(p, first[:-1], axis=0)
        mean = np.add.reduceat(p, first[:-1], axis=0) / np.diff(first)[:, None]
        out[i:j] = net.probability(top, mean)
        i = j
    return out


def trained(texts: list[bytes], y: np.ndarray, dims: int = 4, filters: int = 16, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Adam on the logistic loss over mini-batches; gradients flow to the window that won each maximum."""
    net = ByteConvNet.fresh(dims, filters, seed)
    if not texts:
        return net
    r = np.random.default_rng(seed)
    share = min(max(float(y.mean()), 0.02), 0.98)
    net.out_b = float(np.log(share / (1 - share)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # between balanced and as found
    params = [net.emb, net.filt, net.bias, net.out_w, np.array([net.out_b], np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    size = 32
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = r.permutation(len(texts))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            data, real, first = laid_out([texts[k] for k in pick])
            resp = np.concatenate(net.responses(data), axis=1)[real]  # chunks x windows x N, offset-major
            won = resp.argmax(axis=1)
            pre = np.take_along_axis(resp, won[:, None, :], axis=1)[:, 0] + net.bias
            p = np.maximum(pre, 0)
            doc = np.repeat(np.arange(len(pick)), np.diff(first))
            n = np.diff(first)[:, None]
            top = np.maximum.reduceat(p, first[:-1], axis=0)
            mean = np.add.reduceat(p, first[:-1], axis=0) / n
            feats = np.hstack([top, mean])
            err = ((net.probability(top, mean) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g_out = feats.T @ err + 1e-4 * net.out_w
            g_feat = err[:, None] * net.out_w[None]
            g_p = (g_feat[:, filters:] / n)[doc] + g_feat[:, :filters][doc] * (p == top[doc])
            g_p = (g_p * (pre > 0)).astype(np.float32)
            per = HOP // WIDTH
            start = real[:, None] * HOP + (won // per) * STRIDE + (won % per) * WIDTH
            window = data[start[:, :, None] + np.arange(WIDTH)]  # chunks x N x WIDTH
            e = net.emb[window].reshape(len(real), filters, -1)
            g_filt = np.einsum("cf,cfk->kf", g_p, e)
            g_e = g_p[:, :, None] * net.filt.T[None]
            g_emb = np.zeros_like(net.emb)
            np.add.at(g_emb, window.reshape(-1), g_e.reshape(-1, dims))
            t += 1
            for k, g in enumerate((g_emb, g_filt, g_p.sum(axis=0), g_out, np.array([err.sum()], np.float32))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            net.out_b = float(params[4][0])
    return net


def spread(text: Column, pieces: int = 32, size: int = 512) -> Column:
    """The text, or of one over ``pieces * size`` characters that many pieces spread evenly from its first character to its last."""
    step = (F.length(text) - size) / (pieces - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > pieces * size, F.array_join(cut, " ")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 3, max_rows: int = 2500) -> ByteConvNet:
    """Learns from at most ``max_rows`` labelled texts, of any length; a long one is learned from by pieces of all of it.

    Rows whose crc32(doc_id as text) mod ``fold`` is 1 are never learned from.
    The sample is drawn from the labels of smallest id hash, half for each
    value, so it is the same whatever the partitioning.
    """
    lab = labels.where(~held_out("doc_id", fold) & F.col("quality").isin(0, 1)).select("doc_id", "quality").withColumn("_o", F.xxhash64("doc_id"))
    least = [lab.where(F.col("quality") == q).orderBy("_o", "doc_id").limit(max_rows // 2) for q in (0, 1)]  # ids only, and never more than max_rows
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", spread(F.col("text")).alias("text")).join(F.broadcast(least[0].union(least[1])), "doc_id")
    # An id may stand in many rows, so the bound is set again before anything is collected.
    pick = rows.orderBy("_o", "doc_id", "text", "quality").limit(max_rows).collect()
    texts = [x["text"].encode() for x in pick]
    return trained(texts, np.array([x["quality"] for x in pick], np.float64))


def score(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id and the score of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(net, texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 3, **bounds: int) -> DataFrame:
    """doc_id, held_out, score (1: good likelier) and predicted for every row of ``docs``."""
    net = fit(docs, labels, fold, **bounds)
    s = score(docs, net)
    return s.select("doc_id", held_out("doc_id", fold).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, net: ByteConvNet, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(scores(net, texts) >= least))

    return docs.mapInArrow(lean(run), docs.schema)
