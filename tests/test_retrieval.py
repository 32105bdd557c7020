"""Phrases and spans of any length over small tables."""

import math
import struct

import pytest

from docstrata.plans import retrieval

TEXTS = {1: "Alpha beta gamma delta epsilon zeta eta", 2: "Alpha beta gamma delta epsilon other", 3: "say hello world", 4: "hello, World! x", 5: None, 6: ""}
ASKED = {1: "alpha beta gamma delta epsilon zeta", 2: "hello world", 3: "beta", 4: "beta gamma delta", 5: "ello wor", 6: "ta", 7: "", 8: None, 9: "gamma zeta"}


@pytest.fixture
def given(monkeypatch, spark):
    tables = {"documents": (TEXTS, "doc_id"), "benchmark": (ASKED, "item_id")}
    monkeypatch.setattr(retrieval, "table", lambda spark, _, name: spark.createDataFrame(list(tables[name][0].items()), f"{tables[name][1]} long, text string"))


def test_phrases(spark, given, monkeypatch):
    rows = [(i, t, "READY", "ACTIVE") for i, t in TEXTS.items()] + [(7, "beta", "READY", "REVOKED"), (8, "beta", "FAILED", "ACTIVE")]
    monkeypatch.setattr(retrieval, "versions", lambda spark, _: spark.createDataFrame(rows, "doc_id long, text string, status string, source_status string"))
    got = sorted(map(tuple, retrieval.phrase_search(spark, "").collect()))
    assert got == [(1, 1), (2, 3), (2, 4), (3, 1), (3, 2), (4, 1), (4, 2)]


def test_spans(spark, given):
    got = {r["item_id"]: r["n_docs"] for r in retrieval.span_hits(spark, "").collect()}
    assert got == {i: sum(s is not None and t is not None and s in t for t in TEXTS.values()) for i, s in ASKED.items()}


def test_recall_counts_short_spans(spark, given, monkeypatch):
    hits = spark.createDataFrame([(2, 3, 0)], "item_id long, doc_id long, rank int")
    monkeypatch.setattr(retrieval, "rrf_fuse", lambda spark, _: hits)
    got = {r["k"]: (r["n"], r["hits"]) for r in retrieval.recall_at_k(spark, "").collect()}
    assert got[1] == (sum(any(s is not None and t is not None and s in t for t in TEXTS.values()) for s in ASKED.values()), 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_for_spans(spark, given):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan_of(retrieval.span_pairs(spark, ""))[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


VECTORS = {i: [float(i % 7), float(i % 5), 0.1 * (i // 20)] for i in range(90)} | {90: None, 91: [1.0, 2.0], 92: [1.0, 2.5], 93: []}


@pytest.mark.parametrize("few", [10_000, 2])
def test_nearest_with_copies_and_odd_vectors(spark, monkeypatch, few):
    """The same rows by batches and by a join; vectors are dealt out by number, whatever their bytes."""
    tables = {"embeddings": ([(i, v) for i, v in VECTORS.items()], "vec_id long, embedding array<float>"), "benchmark": ([(i, "") for i in (0, 3, 50, 90, 91, 200)], "item_id long, text string")}
    monkeypatch.setattr(retrieval, "table", lambda spark, _, name: spark.createDataFrame(*tables[name]))
    monkeypatch.setattr(retrieval, "versions", lambda spark, _: spark.createDataFrame([(i, "READY" if i % 9 else "FAILED", "ACTIVE") for i in VECTORS], "doc_id long, status string, source_status string"))
    monkeypatch.setattr(retrieval, "FEW", few)
    df = retrieval.vector_leg(spark, "", 5)
    assert "RepartitionByExpression [doc_id" in plan_of(df)[0] and "REPARTITION_BY_NUM" in plan_of(df)[1]
    f32 = lambda v: [float(struct.unpack("f", struct.pack("f", x))[0]) for x in v]
    want = []
    for q in (0, 3, 50, 91):
        d = [(round(sum((a - b) ** 2 for a, b in zip(f32(VECTORS[q]), f32(v), strict=True)) ** 0.5, 6), i) for i, v in VECTORS.items() if v is not None and len(v) == len(VECTORS[q]) and i != q and i % 9]
        want += [(q, i, x, k) for k, (x, i) in enumerate(sorted(d)[:5])]
    assert sorted((r["item_id"], r["doc_id"], r["distance"], r["rank"]) for r in df.collect()) == sorted(want)


def test_documents_without_id_count_in_the_statistics(spark, monkeypatch):
    rows = [(1, "alpha beta"), (2, "alpha gamma Thé"), (None, "alpha delta epsilon zeta"), (3, None)]
    tables = {"documents": (rows, "doc_id long, text string"), "benchmark": ([(7, "Alphas the")], "item_id long, text string")}
    monkeypatch.setattr(retrieval, "table", lambda spark, _, name: spark.createDataFrame(*tables[name]))
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(spark, "", spark.createDataFrame([(1,), (3,)], "doc_id long")).collect()}
    n, df, avgdl = 4, 3, (2 + 2 + 4 + 0) / 4
    assert got == {1: round(math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avgdl)), 6)}
