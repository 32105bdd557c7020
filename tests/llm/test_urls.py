"""URL filter: parts and rules on literals, segmentation and Bayes against plain Python."""

import collections
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from docstrata.llm import urls
from docstrata.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Example.com/En/?q#f", ("www.example.com", "/En/", "com/", "allow")),
        ("http://a.example.com/en/1", ("a.example.com", "/en/1", "example.com/en/", "block")),
        ("http://www.example.com/en/1", ("www.example.com", "/en/1", "www.example.com/en/", "allow")),
        ("http://m.www.example.com/en/", ("m.www.example.com", "/en/", "www.example.com/en/", "allow")),
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://x.net/fr/", ("x.net", "/fr/", "net/fr/", "block")),
        ("http://x.net/fr", ("x.net", "/fr", None, None)),
        ("http://com", ("com", "", None, None)),
        ("http://com?/", ("com", "", None, None)),
        ("a://b://c/d", ("b:", "//c/d", None, None)),
        ("://", ("", "", None, None)),
        ("no scheme", ("", "", None, None)),
        (None, ("", "", None, None)),
        ("x://É.NET/es/\nz", ("É.net", "/es/\nz", "net/es/", "block")),
    ],
)
def test_parts_and_rules(spark, url, want):
    host, path = urls.host_and_path(F.lit(url).cast("string"))
    assert tuple(spark.range(1).select(host, path, *urls.ruled(host, path)).first()) == want


def every_cut(name):
    for cuts in itertools.product((0, 1), repeat=len(name) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
        yield [name[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_segmentation_is_the_cheapest_cut(spark):
    counts = {"free": 40, "bets": 30, "bet": 20, "s": 3, "the": 500, "rat": 9, "her": 12, "at": 90, "casino": 4, "win": 8, "x": 2, "fr": 1}
    table = urls.saved(spark.createDataFrame(list(counts.items()), "word string, c long"), "words")
    total = sum(counts.values())
    cost = lambda w: math.log10(total / counts[w]) if w in counts else math.log10(total) + len(w)
    given = ["freebets", "therat", "casinowin", "zzz", "x", "thefree", "b3ts", "freebetz"]
    got = {r["name"]: r["words"] for r in urls.segmented(spark.createDataFrame([(n,) for n in given * 2], "name string"), table).collect()}
    assert len(got) == len(given)
    for n in given:
        assert "".join(got[n]) == n
        assert sum(map(cost, got[n])) == pytest.approx(min(sum(map(cost, c)) for c in every_cut(n)))
    assert got["freebets"] == ["free", "bets"] and got["casinowin"] == ["casino", "win"]


def plain(pages):
    seen = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)
    counts = collections.Counter(w for _, _, html in pages for w in re.findall(r"[^\W\d_]+", seen.sub(" ", html or "").lower()) if len(w) <= 24)
    total = sum(counts.values()) or 1
    out = []
    for pid, url, _ in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        words = []
        for name in re.findall(r"[^\W_]+", host):
            known = {(a, b - a): math.log10(total / counts[name[a:b]]) for a in range(len(name)) for b in range(a + 1, len(name) + 1) if name[a:b] in counts}
            words += urls.cheapest(name, known, math.log10(total))
        tokens = words + ["/" + ("0" if t.isdigit() else t) for t in re.findall(r"[^\W\d_]+|\d+", path.lower())]
        out.append((pid, host, path, words, tokens, bool(set(words) & set(urls.BLOCKED))))
    n = {b: sum(r[5] == b for r in out) for b in (True, False)}
    c = {b: collections.Counter(t for r in out if r[5] == b for t in r[4]) for b in (True, False)}
    v = len(c[True] | c[False])
    log = lambda t, b: math.log((c[b][t] + 1) / (c[b].total() + v))
    return {r[0]: (r[1], r[2], " ".join(r[3]), math.log((n[True] + 1) / (n[False] + 1)) + sum(log(t, True) - log(t, False) for t in r[4])) for r in out}


def test_query(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    want = plain(pages)
    got = QUERIES["op13_url_filter"](spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, words, score = want[r["page_id"]]
        assert (r["host"], r["path"], r["words"]) == (host, path, words) and r["score"] == pytest.approx(score)
        assert r["verdict"] == ({"com/": "allow", "www.example.com/en/": "allow"}.get(r["rule"], "block") if r["rule"] else "block" if score > 0 else "allow")


def test_learned_words_block_beyond_rules(spark):
    pages = [(i, f"http://{h}.example.org/en/{i}", "<p>free bets lucky spin garden tools</p>") for i, h in enumerate(["freebets", "luckybets", "luckyspin", "gardentools"] + ["garden"] * 9)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0]["words"] == "free bets example org" and [got[i]["verdict"] for i in range(4)] == ["block", "block", "block", "allow"] or got[2]["score"] > got[3]["score"]


def test_edges(spark):
    schema = "page_id long, url string, html string, host string, path string, words string, n int, token string"
    rows = [(1, None, None), (None, "http://a.org/", ""), (None, "http://a.org/", ""), (2, "", "x"), (3, "http://" + "ab" * 5000 + ".org/" + "q/" * 5000, "<p>ab</p>"), (4, "http://../..", "<script>"), (5, "http://漢字.org/漢", None)]
    df = spark.createDataFrame([(*r, "h", "p", "w", 1, "t") for r in rows], schema)
    got = urls.judged(df).collect()
    assert len(got) == 7 and {r["verdict"] for r in got} == {"allow"}
    by = {r["page_id"]: r for r in got if r["page_id"]}
    assert by[1]["words"] == by[2]["words"] == by[4]["words"] == "" and by[3]["words"] == " ".join(["ab"] * 5000 + ["org"]) and by[5]["words"].endswith("org")
    assert urls.judged(df.where("page_id < 0")).count() == 0
