"""Operators against brute force, exact round trips, libraries and held-out labels, on the small table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from docstrata.llm import line_dedup, mixing, ngram_join, pieces, pii, quality, secrets
from docstrata.llm.queries import MIX, QUERIES, SHARES
from docstrata.llm.topk import product

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < n else frozenset(zip(*[w[k:] for k in range(n)], strict=False))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in ngram_join.join(spark.read.parquet(f"{DATA}/documents.parquet"), n, percent).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, percent)


def test_ngram_join_chains(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for k in range(60):
        if r.random() < 0.2:
            words = [f"w{i}" for i in r.integers(0, 400, 60)]
        words = list(words)
        words[int(r.integers(60))] = f"n{k}"
        docs.append((k, " ".join(words)))
    sets = {i: shingles(t, 2) for i, t in docs}
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), 2, 85).collect()}
    assert got == components(sets, 85)


def test_trie_prunes_nothing_that_matches():
    r = np.random.default_rng(1)
    for _ in range(30):
        centre = np.unique(r.integers(0, 80, 40)).astype(np.uint64)
        sets = [np.unique(np.r_[r.choice(centre, int(r.integers(20, len(centre)))), r.integers(0, 80, 3)]).astype(np.uint64) for _ in range(20)]
        ok = ngram_join.trie_matches(centre, sets, [s.astype(">u8").reshape(-1, 1).view(np.uint8) for s in sets], 80)
        for s, y in zip(sets, ok, strict=True):
            both = len(np.intersect1d(s, centre))
            assert y == (100 * both >= 80 * (len(s) + len(centre) - both))


def test_edit_neighbourhood(spark):
    r = np.random.default_rng(2)
    lines = []
    for _ in range(60):
        if not lines or r.random() < 0.3:
            w = [f"x{i}" for i in r.integers(0, 50, 10)]
        else:
            w = lines[int(r.integers(len(lines)))].split()
            k = int(r.integers(len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + ["new"] + w[k:], [*w[:k], "sub", *w[k + 1 :]], w][int(r.integers(4))]
        lines.append(" ".join(w))
    docs = spark.createDataFrame([(i // 3, "\n".join(lines[i : i + 3])) for i in range(0, 60, 3)], "doc_id long, text string")
    got = {(x["doc_id"], p) for x in line_dedup.removed(docs).collect() for p in x["gone"]}
    want = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            x, y = a.split(), b.split()
            near = min(len(x), len(y)) >= 8 and line_dedup.within_one(x, y)
            if (len(x) >= 5 or sum(map(len, x)) >= 20) and (x == y or near):
                want.add((i // 3, i % 3))
    assert got == want


def test_word_edit_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    r = np.random.default_rng(3)
    for _ in range(400):
        a, b = ([str(x) for x in r.integers(0, 2, int(r.integers(0, 6)))] for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def test_pieces_equal_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = pieces.Vocabulary.load()
    many = [*texts.values(), "", " ", "   x", "a\tb\n\n", "▁▁ ▁", "naïve café 漢字 😀\0", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 " * 30, "x" * 5000]
    raw = [t.encode() for t in many]
    ids, n = pieces.Encoder(v).encode(raw)
    at = np.r_[0, np.cumsum(n)]
    assert pieces.same_bytes(v, ids, n, raw).all()
    for t, a, b in zip(many, at, at[1:], strict=False):
        assert ids[a:b].tolist() == sp.encode(t)
        assert pieces.decode(v, ids[a:b].tolist()) == sp.decode(ids[a:b].tolist())


def spans_sha(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans(spark, texts):
    pats = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(x) < 256 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15]
    hard = ["a@b@c.d.e@f.g", "..@x.y", "1.2.3.4.5.6.7.8.9", "999.1.1.1 1.1.1.1", "+12(34)-- +1 2", "4111-1111 1111 1111-", "x@y..z x@y.z-", "1.2.3", "@a.b", "0001.0.0.255"]
    for t in [*texts.values(), *hard]:
        want = [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(pats[k], t) if good[k](m[0])]
        assert pii.base_spans(t) == want
    got = {r["doc_id"]: r for r in QUERIES["op4_personal_data"](spark, DATA).collect()}
    for i, t in texts.items():
        assert got[i]["base_sha256"] == spans_sha(pii.base_spans(t), pii.KINDS)


def test_secrets_base(spark, tmp_path, texts):
    kinds = ("assign", "access", "hex")
    hard = ["secret=token:abcdefgh", "Token : 'abc' password=\"abcdef\"", "api_key=x api-key=abcdefg APIKEY:  zzzzzz", "AKIA" + "A" * 15, "xAKIA" + "B" * 40, "f" * 23 + " " + "0" * 24, "é😀 passwd=Ünot abcdefabcdefabcdefabcdef1"]
    docs = [*texts.items(), *((10_000 + k, t) for k, t in enumerate(hard))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op10_secrets"](spark, str(tmp_path)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in docs:
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i]["base_sha256"] == spans_sha([(k, a, b) for a, k, b in sorted(s)], kinds), t


def battery(x):
    """The three tests of a token and Fisher's combination, in plain Python."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [("[0-9]+", "0123456789", 10), ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", 16), ("[a-z]+|[A-Z][a-z]+|[A-Z]+", lower, 26), ("[A-Z2-7]+=*", upper + "234567=", 32), (".*", upper + lower + "0123456789+/-_=", 64)]
    _, alphabet, size = next(k for k in kinds if re.fullmatch(k[0], x))
    x = x.lower() if size in (16, 26) else x
    n = len(x)
    tail = lambda z: max(1 / (1 + math.exp(1.5976 * (z := min(max(z, -8), 8)) + 0.07056 * z**3)), 1e-12)
    chi = size / n * sum(c * c for c in collections.Counter(x).values()) - n
    at = [alphabet.index(c) + 1 for c in x]
    mean = sum(at) / n
    high = sum(v >= mean for v in at)
    runs = 1 + sum((a >= mean) != (b >= mean) for a, b in zip(at, at[1:], strict=False))
    expected = 2 * high * (n - high) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = abs(runs - expected) / math.sqrt(variance) if variance > 0 else 8
    spread = sum((v - mean) ** 2 for v in at)
    along = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:], strict=False))
    z_serial = abs(along / spread) * math.sqrt(n) if spread > 0 else 8
    half = max(-(math.log(tail((chi - size + 1) / math.sqrt(2 * (size - 1)))) + math.log(2 * tail(z_runs)) + math.log(2 * tail(z_serial))), 0)
    return math.exp(-half) * (1 + half + half * half / 2)


def test_secrets_added(spark):
    """Candidates, their cells and the thresholds of the false-discovery control against plain Python."""
    r = np.random.default_rng(11)
    draw = lambda chars, n: "".join(r.choice(list(chars), n))
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    docs = []
    for i in range(300):
        words = [draw("etaoinshr", int(r.integers(20, 50))) for _ in range(2)] + [draw(b64, int(r.integers(20, 90))), draw(hexes.upper(), 30), "long-words-joined-by-9-hyphens"]
        words += ["secret=" + draw(b64, 30), draw(hexes, 40)] if i % 3 == 0 else ["1" * 40 + "é"] if i % 3 == 1 else []
        docs.append((i, " ".join(words[int(k)] for k in r.permutation(len(words)))))
    docs.append((300, " ".join(draw(b64, 22) + " token: " + draw(hexes, 25) for _ in range(150))))
    plain, tested = [], {}
    for i, t in docs:
        base = [m.span() for m in re.finditer(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}", t, re.I | re.A)]
        base += [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            if re.fullmatch("[A-Za-z]+", m[0]):
                plain.append(m[0])
            elif not any(a < m.end() and m.start() < b for a, b in base):
                tested.setdefault(i, []).append(m)
    level = lambda x: max(0, min(59, math.floor(-4 * math.log10(max(battery(x), 1e-300)))))
    size = lambda x: sum(len(x) > k for k in (24, 32, 48, 64))
    cells = [(size(m[0]), level(m[0])) for ms in tested.values() for m in ms]
    limit = []
    for k in range(5):
        null = [level(x) for x in plain if size(x) == k]
        null = null if len(null) >= 200 else [level(x) for x in plain]
        mine = [b for c, b in cells if c == k]
        ok = [b for b in range(60) if any(x <= b for x in mine) and (sum(x <= b for x in null) + 1) / (len(null) + 1) * len(mine) / sum(x <= b for x in mine) <= 0.05]
        limit.append(max(ok, default=-1))
    want = {i: [m.span() for m in ms if level(m[0]) <= limit[size(m[0])]] for i, ms in tested.items()}
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["added"]] for x in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: v for i, v in got.items() if v} == {i: v for i, v in want.items() if v}
    assert sum(map(len, want.values())) > 200


def test_random_strings_are_found_and_words_are_not(spark):
    r = np.random.default_rng(4)
    chars = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    docs = [(i, f"text {''.join(r.choice(chars, 40))}= end " + " ".join("".join(r.choice(list("aeinrst"), 24)) for _ in range(3)) + " long-hyphenated-words-in-a-row-9") for i in range(200)]
    found = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hits = [d[1][s["start"] : s["end"]] for d, row in zip(docs, sorted(found, key=lambda x: x["doc_id"]), strict=True) for s in row["added"]]
    assert sum(h.endswith("=") for h in hits) >= 150 and not any("hyphen" in h for h in hits)


def test_language_model(spark, texts):
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    count, pairs = collections.Counter(), collections.Counter()
    for i in train:
        count.update(toks[i])
        pairs.update(zip([0, *toks[i]], toks[i], strict=False))
    total, v = sum(count.values()), len(count)

    def discounts(n):
        y = n[1] / (n[1] + 2 * n[2])
        return [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]

    d = discounts(collections.Counter(pairs.values()))
    before = collections.Counter(b for _, b in pairs)
    low = discounts(collections.Counter(before.values()))
    t = sum(before.values())
    left = sum(low[min(n, 3)] for n in before.values()) / t
    context, mass = collections.Counter(), collections.Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        mass[a] += d[min(n, 3)]

    def p(a, b):
        q = max(before[b] - low[min(before[b], 3)], 0) / t + left / (v + 1)
        n = pairs[a, b]
        return q if a not in context else max(n - d[min(n, 3)], 0) / context[a] + mass[a] / context[a] * q

    assert sum(p(b"the", w) for w in count) + left / (v + 1) * mass[b"the"] / context[b"the"] == pytest.approx(1)
    for r in QUERIES["op9_language_model"](spark, DATA).collect():
        x = toks[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([0, *x], x, strict=False)), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in x), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(w in count for w in x), total)


def test_neighbour_recall(spark):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = collections.defaultdict(list)
    for r in QUERIES["op5_nearest_neighbours"](spark, DATA).collect():
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(np.linalg.norm(v[r["query_id"]] - v[r["vec_id"]]), abs=1e-12)
    hit = sum(len(set(sorted((k for k in v if k != q), key=lambda k: (np.linalg.norm(v[q] - v[k]), k))[:10]) & set(got[q])) for q in v if q % 100 == 0)
    assert hit >= 0.9 * 10 * sum(q % 100 == 0 for q in v)


def test_topk_beyond_doubles():
    q, x = np.array([[2.0**30, 3.0]]), np.array([[2.0**31, 1.0], [1.0, 2.0]])
    assert product(q, x).tolist() == [[2**61 + 3, 2**30 + 6]]


@pytest.mark.parametrize(("shares", "anchor"), [(SHARES, "clean"), (MIX, None)])
def test_mixing_meets_targets(spark, shares, anchor):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixed(d, mixing.domain_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet")), shares, anchor).collect()
    t, p, w, n = (np.array([r[c] for r in rows], float) for c in ("tokens", "p", "rate", "copies"))
    now = (t[:, None] * p * w[:, None]).sum(0)
    assert (w >= 0).all() and now / now.sum() == pytest.approx(list(shares.values()), abs=1e-4)
    if anchor:
        assert (n[p[:, 0] >= 0.5] >= 1).all()
    else:
        assert now.sum() == pytest.approx(t.sum(), rel=1e-4) and (n >= 2).sum() > 100
    # Copies are the rates on average: totals differ by no more than a few standard deviations of the draws.
    spread = np.sqrt((t[:, None] ** 2 * p**2 * ((w - np.floor(w)) * (1 - w + np.floor(w)))[:, None]).sum(0))
    assert (np.abs((t[:, None] * p * n[:, None]).sum(0) - now) <= 5 * spread + 1).all()


def test_rates_solve_the_bounded_least_squares(spark):
    """Rates stay at 0 or more and leave no residual where plain projected gradients on the driver, run long, leave none."""
    r = np.random.default_rng(9)
    p, t = r.dirichlet([0.3, 0.3, 0.3], 400), r.integers(1, 900, 400)
    post = spark.createDataFrame([(i, int(x), y) for i, (x, y) in enumerate(zip(t, p.tolist(), strict=True))], "doc_id long, tokens long, p array<double>")
    shares = np.array([0.65, 0.27, 0.08])
    want, gram = np.ones(400), np.linalg.inv((t[:, None] * p).T @ p)
    for _ in range(5000):
        want = np.maximum(want - p @ (gram @ (t @ (p * want[:, None]) - t.sum() * shares)), 0)
    assert t @ (p * want[:, None]) / t.sum() == pytest.approx(shares, abs=1e-4)
    got = {x["doc_id"]: x["rate"] for x in mixing.rates(post, None, shares.tolist(), None).collect()}
    w = np.array([got[i] for i in range(400)])
    assert (w >= 0).all() and (w == 0).any() and t @ (p * w[:, None]) / t.sum() == pytest.approx(shares, abs=1e-4)


def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in got if y == k] for k in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.97


def test_pipeline(spark, texts):
    """The five stages against plain Python on the small table; the networks' scores and the rates come from their operators, one text at a time."""
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    net = quality.fit(docs, labels)
    left = {i: t for i, t in texts.items() if quality.scores(net, [(t or "").encode()])[0] >= 0.5}

    lines = [(i, k, x.split()) for i in sorted(left) for k, x in enumerate((left[i] or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5 or sum(map(len, x[2])) >= 20]
    gone, seen = collections.defaultdict(set), []
    for i, k, w in lines:
        if any(w == y or (min(len(w), len(y)) >= 8 and abs(len(w) - len(y)) <= 1 and line_dedup.within_one(w, y)) for y in seen):
            gone[i].add(k)
        seen.append(w)
    for i, ks in gone.items():
        left[i] = "\n".join(x for k, x in enumerate(left[i].split("\n")) if k not in ks)
        if not left[i].strip(" "):
            del left[i]

    group = components({i: shingles(t, 5) for i, t in left.items()}, 80)
    left = {i: t for i, t in left.items() if group[i] == i}

    rated = mixing.mixed(spark.createDataFrame(list(left.items()), "doc_id long, text string"), mixing.domain_of(labels), SHARES, "clean")
    times = {r["doc_id"]: r["copies"] for r in rated.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((i, sp.encode(t or "")) for i, t in left.items() for _ in range(times[i]))
    assert want and sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, DATA).collect()) == want
