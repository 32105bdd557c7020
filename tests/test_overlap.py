"""The new window that shares the most runs with each old one, against SQL on documents that repeat words and ids."""

import random

import duckdb

from docstrata import catalog
from docstrata.plans import library


def test_alias_overlap(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    rows = [(1, text(900, 3)), (2, text(640, 10**6)), (3, "a b c d e"), (4, None), (5, ""), (6, "x " * 700), (7, text(420, 50)), (7, text(300, 2)), (8, text(201, 9)), (None, text(300, 4))]
    rows += [(9, text(350, 40))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(library, "table", lambda *_: docs)
    df = library.alias_overlap(spark, "")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "old_ordinal", "new_ordinal", "shared"]
    want = c.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE['alias_overlap']})").fetchall()
    assert sorted(tuple(x[n] for n in names) for x in df.collect()) == sorted(want)
