"""Names in questions and entities against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docstrata.operators.components import components
from docstrata.operators.names import entities, keys_of, named, word_windows


def united(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 2000 + i) for i in range(80)]
    r.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    assert {x["id"]: x["component"] for x in components(df).collect()} == united(pairs)
    assert components(df.where("a < 0")).count() == 0


@pytest.mark.parametrize(("name", "keys"), [("The Acme & Sons, Inc.", ["acme and sons inc", "acme and sons"]), ("Inc.", []), ("Bob", []), ("of the", []), ("Bolt Co", ["bolt co", "bolt"]), ("", [])])
def test_keys(spark, name, keys):
    assert spark.range(1).select(keys_of(F.lit(name)).alias("k")).first()["k"] == keys


def test_longest_names_win(spark):
    variants = spark.createDataFrame([("acme", 1), ("acme steel", 2), ("acme steel of ohio", 3), ("steel of", 4), ("ohio bolt", 5), ("ohio bolt", 6), ("bolt", 7)], "key string, entity long")
    asked = [(1, "Does Acme Steel of Ohio bolt things?"), (2, "acme or Acme?"), (3, "Acme-Steel, not Bolt"), (4, ""), (5, None), (6, "the acme steel")]
    got = sorted((r["id"], r["entity"], r["key"], r["start"], r["stop"]) for r in named(spark.createDataFrame(asked, "id long, text string"), variants).collect())
    assert got == [(1, 3, "acme steel of ohio", 1, 5), (1, 5, "ohio bolt", 4, 6), (1, 6, "ohio bolt", 4, 6), (2, 1, "acme", 2, 3), (3, 2, "acme steel", 0, 2), (3, 7, "bolt", 3, 4), (6, 2, "acme steel", 1, 3)]
    n = spark.range(1).select(F.size(word_windows(F.lit(" ".join(f"w{i}" for i in range(10))))).alias("n")).first()["n"]
    assert n == sum(min(6, 10 - i) for i in range(10))


def test_entities_do_not_depend_on_order(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    names = [(h, f"{r.choice(words)} {r.randrange(40)} {r.choice(['Inc', 'Ltd', ''])}".strip()) for h in range(60) for _ in range(2)]
    links = []
    key = lambda n: " ".join(w for w in n.lower().split() if w not in ("inc", "ltd"))
    by_holder = {}
    for h, n in names:
        by_holder.setdefault(h, set()).update({n.lower(), key(n)})
    for ks in by_holder.values():
        links += list(itertools.product(ks, ks))
    want = united(links)
    got = []
    for _ in range(2):
        r.shuffle(names)
        got.append({x["key"]: x["entity"] for x in entities(spark.createDataFrame(names, "holder long, name string").repartition(3)).collect()})
    assert got[0] == got[1] and got[0].keys() == want.keys()
    assert len(set(got[0].values())) == len(set(want.values())) == len({(got[0][k], want[k]) for k in want})


def test_windows_of_wanted_sizes(spark):
    """Windows of as many words as no variant has are not made, and the others are as they were."""
    q = spark.createDataFrame([(1, "Did Anna Lee Smith call the Big Red Dog?"), (2, ""), (3, None)], "id int, text string")
    every, some = ({r["id"]: r["w"] for r in q.select("id", word_windows(F.col("text"), s).alias("w")).collect()} for s in (None, [2, 3]))
    assert [w for w in every[1] if w["stop"] - w["start"] in (2, 3)] == some[1] and len(some[1]) < len(every[1])
    assert some[2] is None and some[3] is None
