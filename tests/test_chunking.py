"""Splits, packs, table chunks and page markers against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.operators import chunking


def fall(x, cap):
    if len(x) <= cap:
        return [x]
    out = []
    for s in re.split(r"(?<=[.!?][ \t\n\r\f])", x):
        if len(s) <= cap:
            out.append(s)
            continue
        for w in re.split(r"(?<=[ \t\n\r\f])(?=[^ \t\n\r\f])", s):
            out += [w] if len(w) <= cap else [w[i : i + cap] for i in range(0, len(w), cap)]
    return [p for p in out if p]


def packed(text, cap):
    out = []
    for p in (p for line in re.findall(r"[^\n]*\n|[^\n]+", text) for p in fall(line, cap)):
        if out and len(out[-1]) + len(p) <= cap:
            out[-1] += p
        else:
            out.append(p)
    return out


def texts():
    r = random.Random(3)
    made = ["", "\n", "\n\n\n", "word", "x" * 100, "a b. c! d? e", "漢字。" * 40, "end. \nnext line is here. It goes on and on! Why? " * 5, "  lead  and  spaces   " * 6]
    for _ in range(40):
        made.append("".join(r.choice(["a", "bb ", "ccc. ", "\n", "dddd! ", "e" * r.randrange(1, 50), " ", "é? ", "3.14 "]) for _ in range(r.randrange(60))))
    return made


@pytest.mark.parametrize("cap", [7, 20, 64])
def test_text_chunks(spark, cap):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    for r in df.select("t", chunking.text_chunks(F.col("t"), cap).alias("c"), chunking.prefixed_chunks(F.lit("pre "), F.col("t"), cap).alias("p")).collect():
        assert "".join(r["c"]) == r["t"] and all(len(c) <= cap for c in r["c"])
        assert r["c"] == packed(r["t"], cap)
        head = "pre "[: cap // 2]
        assert r["p"] == [head + c for c in packed(r["t"], cap - len(head))]


def parsed(chunk):
    lines = chunk.strip("\n").split("\n")
    cells = [[c for c in line[2:-2].split(" | ")] for line in lines]
    assert set(cells[1]) == {"---"} and all(len(r) == len(cells[0]) for r in cells)
    return cells[0], cells[2:]


@pytest.mark.parametrize("cap", [60, 90, 200])
def test_table_chunks(spark, cap):
    r = random.Random(4)
    header = ["item", "quantity", "note"]
    rows = [[f"i{k}", str(r.randrange(999)), "n" + "abcdefgh"[: r.randrange(8)] * r.choice([1, 1, 1, 6, 20])] for k in range(40)] + [["short"], ["a", "b", "c", "d"]]
    chunks = spark.createDataFrame([(header, rows)], "h array<string>, r array<array<string>>").select(chunking.table_chunks(F.col("h"), F.col("r"), cap).alias("c")).first()["c"]
    assert all(len(c) <= cap for c in chunks)
    got = {h: "" for h in header}
    for c in chunks:
        names, body = parsed(c)
        for row in body:
            for h, cell in zip(names, row, strict=True):
                got[h] += cell
    full = [(x + [""] * 3)[:3] if len(x) <= 3 else [*x[:2], " ".join(x[2:])] for x in rows]
    assert got == {h: "".join(x[k] for x in full) for k, h in enumerate(header)}


def test_rows_that_fit_share_a_header(spark):
    chunks = spark.createDataFrame([(["a", "b"], [["1", "2"], ["3", "4"], ["5", "6"]])], "h array<string>, r array<array<string>>").select(chunking.table_chunks(F.col("h"), F.col("r"), 44).alias("c")).first()["c"]
    assert chunks == ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n", "| a | b |\n| --- | --- |\n| 5 | 6 |\n"]
    assert spark.range(1).select(chunking.table_chunks(F.array(F.lit("a")), F.array().cast("array<array<string>>"), 40).alias("c")).first()["c"] == []


def test_planted_pages_are_found_in_order(spark):
    r = random.Random(5)
    pages = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(60)) for _ in range(12)]
    anchors = [p[:40] for p in pages]
    anchors[3], anchors[7] = "too short", "z" * 40  # these two stay without a marker
    text = "front matter " + "".join(pages)
    df = spark.createDataFrame([(text, anchors)], "t string, a array<string>").withColumn("at", chunking.page_starts(F.col("t"), F.col("a")))
    df = df.withColumn("m", chunking.marked(F.col("t"), F.col("at")))
    row = df.withColumn("c", chunking.page_spans(chunking.text_chunks(F.col("m"), 300))).first()
    begin = [len("front matter ") + sum(map(len, pages[:k])) + 1 for k in range(12)]
    assert row["at"] == [None if k in (3, 7) else b for k, b in enumerate(begin)]
    assert re.sub(r"<!--PAGE:\d+-->\n", "", row["m"]) == text
    assert [int(x) for x in re.findall(r"PAGE:(\d+)", row["m"])] == [k + 1 for k in range(12) if k not in (3, 7)]
    spans = [(c["page_start"], c["page_end"]) for c in row["c"] if c["page_end"]]
    assert spans == sorted(spans) and spans[-1][1] == 12 and all(a is None or a <= b for a, b in spans)


def test_a_repeated_anchor_never_goes_backwards(spark):
    a, b = "same opening line of every single page here", "another line that is long enough to serve"
    text = f"{a} 1 {b} 2 {a} 3 {b}"
    at = spark.createDataFrame([(text, [b, a, a, b])], "t string, a array<string>").select(chunking.page_starts(F.col("t"), F.col("a")).alias("at")).first()["at"]
    assert at == [text.index(b) + 1, text.rindex(a) + 1, None, text.rindex(b) + 1]
