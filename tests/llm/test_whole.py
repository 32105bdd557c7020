"""Operators on small tables where a cut of the work would show."""

import collections
import math
import time
import zlib

import numpy as np
import pytest

from docstrata.llm import ivf_pq, language_model, line_dedup, ngram_join, pieces, pii, quality, topk
from docstrata.llm.queries import QUERIES


def test_language_model_keeps_bigrams_seen_once(spark):
    r = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 200) % 150)) for i in range(60)]
    toks = {i: [*t.encode().split(), None] for i, t in docs}
    count, pairs = collections.Counter(), collections.Counter()
    for i, x in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(x)
            pairs.update(zip([0, *x], x, strict=False))
    assert collections.Counter(pairs.values())[1] > 100
    d = language_model.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    before = collections.Counter(b for _, b in pairs)
    low = language_model.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    left = sum(low[min(n, 3)] for n in before.values()) / len(pairs)
    context, mass = collections.Counter(), collections.Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        mass[a] += d[min(n, 3)]

    def p(a, b):
        q = max(before[b] - low[min(before[b], 3)], 0) / len(pairs) + left / (len(count) + 1)
        return q if a not in context else max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / context[a] + mass[a] / context[a] * q

    assert sum(p(b"w1", w) for w in count) + mass[b"w1"] / context[b"w1"] * left / (len(count) + 1) == pytest.approx(1)
    for x in language_model.perplexity_scores(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        t = toks[x["doc_id"]]
        assert x["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *t], t, strict=False)), rel=1e-9)


def test_neighbours_in_a_group_of_near_copies(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(27_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:3000] = x[0] + r.normal(size=(3000, 16)) * 0.001
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, z array<double>")
    got = collections.defaultdict(set)
    for f in ivf_pq.search(rows.where("id < 3000 and id % 100 = 0"), rows, 10, sample=512).collect():
        got[f["query_id"]].add(f["vec_id"])
    hit = 0
    for i in range(0, 3000, 100):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        hit += len(got[i] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.97 * 300


def test_block_search_is_exact():
    r = np.random.default_rng(8)
    index = ivf_pq.fit(r.normal(size=(300, 8)), 300, 5, 0.97)
    vecs = np.r_[index.centroids[0] + r.normal(size=(400, 8)), 1.0 + r.normal(size=(600, 8)) * 1e-4]
    rest = vecs - index.centroids[0]
    codes = np.stack([ivf_pq.squared(p, b).argmin(1).astype(np.uint8) for p, b in zip(index.runs(rest), index.codebooks, strict=True)], axis=1)
    q = vecs[::25]
    qi, x, d = index.search(q, 0, codes, vecs, 6)
    for k in range(len(q)):
        assert set(np.argsort(np.linalg.norm(vecs - q[k], axis=1))[:6]) <= set(x[qi == k])
        assert d[qi == k] == pytest.approx(np.linalg.norm(vecs[x[qi == k]] - q[k], axis=1))


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_near_duplicates_of_one_tiny_text(spark, words):
    docs = spark.createDataFrame([(1, " ".join("abcd"[:words]))], "doc_id long, text string")
    assert [(r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, 5, 80).collect()] == [(1, 1)]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = [(None, one), (1, one), (2, two), (2, one), (2, one), (3, one + " more"), (None, None), (4, two)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect())
    assert got == [(0, 0, None), (0, 38, None), (1, 38, 1), (2, 38, 1), (2, 38, 1), (2, 38, 2), (3, 39, 1), (4, 38, 2)]


@pytest.mark.parametrize("cell", [3, 512])
def test_tree_join_finds_every_pair(spark, monkeypatch, cell):
    """All pairs of different components whose sets reach the bound are among the candidates, also where an element's sets fill many cells."""
    monkeypatch.setattr(ngram_join, "CELL", cell)
    r = np.random.default_rng(12)
    sets = []
    for _ in range(80):
        base = sorted(r.choice(200, int(r.integers(10, 40)), replace=False).tolist()) if not sets or r.random() < 0.5 else sets[int(r.integers(len(sets)))]
        sets.append(sorted(set(base[: len(base) - int(r.integers(0, 2))]) | {int(r.integers(200))}))
    prefix = [s[: len(s) - -(-len(s) * 80 // 100) + 1] for s in sets]
    rows = [(e, len(s), k, i, i % 7) for i, s in enumerate(sets) for k, e in enumerate(prefix[i])]
    got = {(x["a"], x["b"]) for x in ngram_join.tree_pairs(spark.createDataFrame(rows, "e long, size long, pos int, rep long, c long"), 80).collect()}
    near = lambda a, b: 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b})
    want = {(i, j) for j in range(80) for i in range(j) if i % 7 != j % 7 and near(sets[i], sets[j])}
    assert want and want <= got and len(got) < 20 * len(want) and all(i % 7 != j % 7 for i, j in got)


def test_quality_is_of_a_text_alone(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    net = quality.fit(d, labels)
    rows = d.select("doc_id", "text").collect()
    together = quality.scores(net, [(r["text"] or "").encode() for r in rows])
    alone = [quality.scores(net, [(r["text"] or "").encode()])[0] for r in rows]
    back = quality.scores(net, [(r["text"] or "").encode() for r in rows[::-1]])[::-1]
    assert together == pytest.approx(alone, abs=1e-6) and together == pytest.approx(back, abs=1e-6)
    spread = {r["doc_id"]: r["score"] for r in quality.score(d.repartition(7, "text"), net).collect()}
    assert [spread[r["doc_id"]] for r in rows] == pytest.approx(alone, abs=1e-6)


def test_topk_of_one_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0]), *((k + 1, [float(-k)]) for k in range(1, 12))], "id long, z array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.search(rows.where("id = 1"), rows, 5).orderBy("rank").collect()]
    assert got == [(k + 1, -k) for k in range(1, 6)]


def test_pieces_of_long_words():
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Vocabulary.load()
    r = np.random.default_rng(13)
    for chars in ("abcdefgh", "ab\u4e00\U0001f600\u1234q", "a", " x"):
        text = "".join(r.choice(list(chars), 100_000))
        began = time.perf_counter()
        ids, n = pieces.Encoder(v).encode([text.encode(), b"", "q r".encode()])
        assert time.perf_counter() - began < 20
        assert ids[: n[0]].tolist() == sp.encode(text) and n[1] == 0 and pieces.decode(v, ids[: n[0]].tolist()) == text


def test_personal_data_of_long_digit_runs(spark):
    text = "0" * 5000 + ".1.1.1 and " + "9" * 6000 + ".1.1.1 " + "1" * 7000
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["kind"], s["start"], s["end"]) for s in got["base"]] == [(1, 0, 5006)]


def test_personal_data_added(spark):
    """Spans that the base patterns miss are added where labelers and surroundings speak for them, and version numbers and sums are not."""
    r = np.random.default_rng(14)
    docs, planted = [], {}
    for i in range(400):
        name, host = ("".join(r.choice(list("abcdefghij"), 6)) for _ in range(2))
        digits = "".join(map(str, r.integers(0, 10, 10)))
        good = [f"contact {name} (at) {host} (dot) com today", f"e-mail {name}@{host}.org now", f"call {digits[:3]}-{digits[3:6]}-{digits[6:]} now"][i % 3]
        bad = [f"order {digits}{digits[:6]} shipped", "they met at noon. then left", f"invoice {digits[:3]} {digits[3:6]} {digits[6:]}x paid"][i % 3]
        docs.append((i, f"Some words first. {good}. Then {bad}."))
        if i % 3 == 0:
            planted[i] = docs[-1][1].index(name), docs[-1][1].index(" today")
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["added"] if s["kind"] == 0] for x in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(planted[i] in got[i] for i in planted) >= 0.95 * len(planted)
    assert sum(bool(v) for i, v in got.items() if i not in planted) == 0


def test_lines_of_rows_that_share_an_id(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(9)) for c in "xyz")
    docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{z}\n{x}"), (2, f"other\n{z}\n{y}")], "doc_id long, text string")
    got = sorted(r["text"] for r in line_dedup.deduplicated(docs).collect())
    assert got in (sorted([f"{x}\n{y}", z, "other"]), sorted([f"{x}\n{y}", "", f"other\n{z}"]))


def test_language_model_wants_its_folder(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(20)], "doc_id long, text string")
    model = language_model.count_model(docs.select("text"))
    model.folder += "-elsewhere"
    with pytest.raises(FileNotFoundError):
        model.log_probs(np.array([1], np.uint64), np.array([2], np.uint64))


def test_quality_classifier_query_reads_labels_of_its_fold_only(spark):
    assert {r["held_out"] for r in QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.001").collect()} == {True, False}
