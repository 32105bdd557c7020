"""Short and unspaced lines, long labelled texts, ids beside several vectors, very large components, and the network against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import ivf_pq, line_dedup, quality, topk


def test_short_and_unspaced_lines(spark):
    unspaced = "漢字" * 30
    docs = [(1, f"All rights reserved here\n{unspaced}\nok\nfour words are short"), (2, f"{unspaced}\nAll  rights reserved here \nok\nfour words are short"), (3, "漢" * 19 + "\n" + "é" * 20), (4, "漢" * 19 + "\n" + "é" * 20)]
    got = {r["doc_id"]: r["g"] for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), positions="g").collect()}
    assert got == {1: None, 2: [0, 1], 3: None, 4: [1]}  # 21, 60, 2, 17, 19 and 20 characters


def test_long_labelled_texts_are_learned_from(spark):
    long = "".join(chr(97 + i % 26) + " " for i in range(500_000))
    cut = spark.createDataFrame([(long,), ("short",), (None,)], "text string").select(quality.spread(F.col("text")).alias("t")).collect()
    assert cut[1]["t"] == "short" and cut[2]["t"] is None and 16_384 <= len(cut[0]["t"]) < 17_000
    assert cut[0]["t"].startswith(long[:512]) and cut[0]["t"].endswith(long[-512:])
    docs = spark.createDataFrame([(i, (f"good words {i} " if i % 2 else f"$$$ @@ {i} ") * (60_000 if i < 4 else 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > max(got[i] for i in range(0, 60, 2))


def test_network_against_a_plain_loop():
    r = np.random.default_rng(4)
    rows = [bytes(r.integers(32, 127, int(n)).astype(np.uint8)) for n in (0, 1, 30, 200, 900)]
    net = quality.trained([b"abc def " * 9, b"$$$ @@@ " * 9], np.array([1.0, 0.0]))
    got = quality.scores(net, rows)
    data, real, first = quality.laid_out(rows)
    for k, text in enumerate(rows):
        best, total, n = np.zeros(net.filt.shape[1]), np.zeros(net.filt.shape[1]), 0
        for c in real[first[k] : first[k + 1]]:
            top = np.full(net.filt.shape[1], -np.inf)
            for at in range(c * quality.HOP, (c + 1) * quality.HOP, quality.STRIDE):
                window = np.concatenate([net.emb[b] for b in data[at : at + quality.WIDTH]])
                top = np.maximum(top, window @ net.filt)
            p = np.maximum(top + net.bias, 0)
            best, total, n = np.maximum(best, p), total + p, n + 1
        z = np.r_[best, total / n] @ net.out_w + net.out_b
        assert got[k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5), text[:20]


def both_searches(spark, rows):
    e = spark.createDataFrame(rows, "id long, z array<double>")
    inner = [tuple(r) for r in topk.search(e.where("id % 50 = 0"), e, 5).collect()]
    near = [tuple(r) for r in ivf_pq.search(e.where("id % 50 = 0"), e, 5).collect()]
    return sorted(inner), sorted(near)


def plain(rows, score, k=5):
    out = []
    for q in {i for i, _ in rows if i % 50 == 0}:
        best = {}
        for _, a in [r for r in rows if r[0] == q]:
            for i, b in rows:
                if i != q and len(a) == len(b):
                    best[i] = min(best.get(i, math.inf), score(a, b))
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:k])]
    return sorted(out)


def test_ids_beside_several_vectors(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(c) for c in r.integers(-9, 9, 4)]) for i in r.integers(0, 60, 300)] + [(50, [1.0, 2.0, 3.0, 4.0]), (50, [4.0, 3.0, 2.0, 1.0]), (0, [0.0, 1.0, 0.0, 0.0])]
    inner, near = both_searches(spark, rows)
    assert inner == [(q, k, i, -int(s)) for q, k, i, s in plain(rows, lambda a, b: -sum(x * y for x, y in zip(a, b, strict=True)))]
    want = plain(rows, math.dist)
    assert [x[:3] for x in near] == [x[:3] for x in want] and [x[3] for x in near] == pytest.approx([x[3] for x in want])


def test_very_large_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [-1e200, 2.0]), (2, [1e200, 3.0]), (3, [1.0, 0.0]), (4, [1.7e308, 0.0]), (5, [-1.7e308, 0.0]), (50, [3.0, 4.0])]
    inner, near = both_searches(spark, rows)
    cut = lambda v: max(1 - 2**63, min(2**63 - 1, v))
    assert inner == [(q, k, i, -s) for q, k, i, s in plain(rows, lambda a, b: -cut(sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))]
    assert {(q, i): d for q, _, i, d in near}[50, 3] == pytest.approx(math.dist([3, 4], [1, 0])) and {(q, i): d for q, _, i, d in near}[0, 2] == pytest.approx(2.0)


def test_half_of_the_vectors_in_one_list(spark):
    r = np.random.default_rng(9)
    hot = np.r_[1.0, np.zeros(7)] + 0.01 * r.standard_normal((1500, 8))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(np.vstack([hot, r.standard_normal((1500, 8))]))]
    e = spark.createDataFrame(rows, "id long, z array<double>")
    got = {}
    for x in ivf_pq.search(e.where("id % 100 = 0"), e, 10, block=128).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    x = np.array([v for _, v in rows])
    hits = sum(len(got[q] & set(np.argsort(np.where(np.arange(len(x)) == q, np.inf, ((x - x[q]) ** 2).sum(axis=1)))[:10].tolist())) for q in range(0, 3000, 100))
    assert hits >= 0.9 * 300
