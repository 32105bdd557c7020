"""Dates, exclusive times and references against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.operators.dates import MONTHS, PATTERNS, PLACES, dates_in
from docstrata.operators.references import resolved, title_tokens
from docstrata.operators.timing import exclusive


def plain_dates(text):
    found = []
    for p, (y, m, d) in zip(PATTERNS, PLACES, strict=True):
        for x in re.finditer(p, text, re.ASCII):
            month = x[m] if x[m].isdigit() else 1 + [k[:3] for k in MONTHS].index(x[m][:3].lower())
            try:
                found.append((x.start(), -x.end(), datetime.date(int(x[y]), int(month), int(x[d])).isoformat()))
            except ValueError:
                continue
    out, end = [], -1
    for a, b, iso in sorted(found):
        if a >= end:
            out.append((a, -b, iso))
            end = -b
    return out


def test_dates(spark):
    texts = [
        "March 21, 2018", "Mar. 21 2018 and march 21st, 2018", "the 21st day of March, 2018; 21st of March 2018", "2018-03-21 03/21/2018", "2018-02-30 13/01/2018 0/1/2018", "1 March 5, 1999", "May 5 2020 May 6 2020",
        "Sept. 9, 2009 sept 31, 2009", "29 February 2024 29 February 2023", "", "é漢 2020-01-02 漢", "12021-03-04", "3/4/20215", "may 2020", "June 5, 0000",
    ]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for r in df.select("t", dates_in(F.col("t")).alias("d")).collect():
        assert [tuple(x) for x in r["d"]] == (plain_dates(r["t"]) if r["t"] else []), r["t"]


@pytest.mark.parametrize("seed", range(3))
def test_exclusive_times(spark, seed):
    r = random.Random(seed)
    names = [("outer", 1), ("b", 2), ("a", 2), ("inner", 3)]
    spans = []
    for k in range(4):
        for _ in range(12):
            name, depth = r.choice(names)
            a = r.randrange(100)
            spans.append((k, name, depth, a, a + r.choice([0, 1, 5, 30]) - (r.random() < 0.1) * 40))
    got = {(x["k"], x["name"]): x["time"] for x in exclusive(spark.createDataFrame(spans, "k long, name string, depth int, start long, stop long"), ["k"]).collect()}
    want = {}
    for k in range(4):
        mine = [s for s in spans if s[0] == k and s[3] <= s[4]]
        edges = sorted({t for s in mine for t in s[3:]})
        for a, b in zip(edges, edges[1:], strict=False):
            active = sorted((-d, n) for _, n, d, x, y in mine if x <= a and y >= b)
            name = active[0][1] if active else "overhead"
            want[k, name] = want.get((k, name), 0) + b - a
        assert sum(v for (i, _), v in got.items() if i == k) == edges[-1] - edges[0]
    assert got == want


def test_references(spark):
    day = datetime.date
    docs = [(1, "Supply Agreement for Steel", day(2020, 1, 1), ["acme", "bolt"]), (2, "Supply Contract for Steel", day(2021, 1, 1), ["acme"]), (3, "Lease of a Mill", day(2020, 1, 1), ["acme"]), (4, "Lease", day(2020, 1, 1), ["zinc"])]
    refs = [
        (10, "the Lease", None, ["acme"]), (11, "Supply steel", None, ["acme"]), (12, "Supply steel", day(2021, 1, 1), ["acme"]), (13, "the Agreement", day(2020, 1, 1), ["bolt"]), (14, "the Agreement", day(2020, 1, 1), ["acme"]),
        (15, "the Agreement", None, ["bolt"]), (16, "Lease", None, ["bolt"]), (17, "Lease of a Ship", None, ["acme"]), (18, "", day(2020, 1, 1), ["zinc", "other"]), (19, None, day(2020, 1, 1), ["zinc"]), (20, "lease", None, []),
    ]
    d = spark.createDataFrame(docs, "doc long, title string, day date, parties array<string>").withColumn("have", title_tokens(F.col("title")))
    r = spark.createDataFrame(refs, "ref long, title string, day date, parties array<string>").withColumn("want", title_tokens(F.col("title")))
    assert sorted(map(tuple, resolved(r, d).collect())) == [(10, 3), (12, 2), (13, 1), (18, 4), (19, 4)]
