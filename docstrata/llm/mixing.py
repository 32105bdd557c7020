"""Mixing sources to target weights, with soft domain membership, in DataFrame functions only.

A naive Bayes classifier over informative words, learned from a bounded sample
of a labelled table, gives every document a posterior over domains. Rates
(expected copies) then start at 1 and follow projected gradients of the
least-squares distance between expected domain token totals and targets; each
step is one aggregation over documents that brings as many sums as there are
domains to the driver, and a column expression that moves every rate and cuts
it at 0. The residual is weighted by the inverse of the domains' token Gram
matrix over the rows that are not at their bound, so a step in which no rate
reaches the bound meets the targets at once.

The classifier's bounds (``max_rows`` labelled rows, ``vocabulary`` words,
``sharpness``) belong to its fit alone: it is applied to every row, and rates
and totals are those of all rows.

Edge cases: a null or empty text has no words and the prior as its posterior;
its rate moves but weighs nothing; a long text counts with all its words;
repeated rows are rated and drawn alike; rows that share an id but not the
text have rates of their own; a null id is rated, its copies are drawn as for
id 0; words of equal gain enter the vocabulary in their own order; without
labels all posteriors are equal; a domain without any tokens cannot be raised
and keeps its residual; an empty table gives an empty result; columns other
than doc_id and text, whatever their names, pass through ``resampled``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import document
from .shared import dropped, few, free_name, saved


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+"), lambda w: w != "")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = 6000, vocabulary: int = 300, least: int = 4, clear: float = 5.0) -> tuple[list[float], dict[str, list[float]]]:
    """Log priors and the log weights of informative words, from at most ``max_rows`` labelled documents (doc_id, domain) of smallest id hash."""
    pick = labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain").withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(max_rows)
    seen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("domain", F.array_distinct(words(F.col("text"))).alias("w"))
    seen = saved(seen, "sample")
    size = dict(seen.groupBy("domain").count().collect())
    total = sum(size.values())
    prior = [math.log((size.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    if not total:
        return prior, {}
    count = seen.select("domain", F.explode("w").alias("w")).groupBy("w").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)), F.count("*").alias("n")).where(F.col("n") >= least)
    # A word informs if a domain's documents hold it far more often than all documents do: standard deviations above what is expected.
    expected = [F.col("n") * (max(size.get(d, 0), 1) / total) for d in domains]
    above = [(F.col(f"n{k}") - x) / F.sqrt(x + 1) for k, x in enumerate(expected)]
    best = count.withColumn("gain", F.greatest(*above)).where(F.col("gain") >= clear).orderBy(F.desc("gain"), "w").limit(vocabulary).collect()
    dropped(seen)
    weight = {}
    for r in best:
        mean = (r["n"] + 0.5) / (total + 1)
        weight[r["w"]] = [math.log((r[f"n{k}"] + 10 * mean) / (size.get(d, 0) + 10) / mean) for k, d in enumerate(domains)]
    return prior, weight


def posteriors(docs: DataFrame, prior: list[float], weight: dict[str, list[float]], sharpness: float = 3.0) -> DataFrame:
    """doc_id, text hash, tokens and p (array, one value a domain) of every row; ``sharpness`` multiplies the log odds of a few hundred words, which alone are too even."""
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    start = F.array(*map(F.lit, prior))
    if weight:
        table = F.create_map(*(x for w, v in weight.items() for x in (F.lit(w), F.array(*map(F.lit, v)))))
        known = F.array_intersect("w", F.array(*map(F.lit, weight)))
        logit = F.aggregate(known, start, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
    else:
        logit = start
    d = d.select("doc_id", "h", F.size("w").cast("long").alias("tokens"), logit.alias("z"))
    e = F.transform("z", lambda x: F.exp(F.greatest((x - F.array_max("z")) * sharpness, F.lit(-50.0))))
    d = d.select("doc_id", "h", "tokens", e.alias("e"))
    return d.select("doc_id", "h", "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rates(post: DataFrame, targets: np.ndarray | None, shares: list[float], anchor: int | None, rounds: int = 24, tolerance: float = 1e-6) -> DataFrame:
    """``post`` (with tokens and p) and the fitted ``rate``.

    Targets are token totals; without them they are ``shares`` of the total
    found, or, with ``anchor``, of the total that leaves that domain's as found.
    With ``anchor``, rows that more likely than not belong to it have a rate of
    1 at least, so all of them stay; the other rates make up for it.
    """
    k = len(shares)
    p = [F.element_at("p", i + 1) for i in range(k)]
    t = F.col("tokens").cast("double")
    gram = post.agg(*(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(t * x).alias(f"s{i}") for i, x in enumerate(p))).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    found = np.array([gram[f"s{i}"] or 0.0 for i in range(k)])
    if targets is None:
        share = np.array(shares) / sum(shares)
        total = found.sum() if anchor is None else found[anchor] / share[anchor]
        targets = total * share
    out = post.withColumn("rate", F.lit(1.0))
    if not found.sum():
        return out
    floor = F.lit(0.0) if anchor is None else F.when(p[anchor] >= 0.5, 1.0).otherwise(0.0)
    # Rows at their bound do not move, so the Gram matrix that scales the next step is that of the others.
    free = F.when(F.col("rate") > floor, t).otherwise(0.0)
    sums = [F.sum(t * p[i] * F.col("rate")).alias(f"s{i}") for i in range(k)] + [F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    now, last = found, math.inf
    for r in range(rounds):
        residual = now - targets
        size = float(np.abs(residual).max() / targets.sum())
        if size <= tolerance or size >= last * 0.999:
            break
        last = size
        step = np.linalg.pinv(g + 1e-9 * np.trace(g) * np.eye(k)) @ residual
        move = sum((p[i] * F.lit(float(step[i])) for i in range(1, k)), p[0] * F.lit(float(step[0])))
        out = out.withColumn("rate", F.greatest(F.col("rate") - move, floor))
        if r % 4 == 3:  # keeps the rate's expression short
            kept, out = out, saved(out, "rates")
            dropped(kept)
        row = out.agg(*sums).first()
        now = np.array([row[f"s{i}"] for i in range(k)])
        g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return out


def copies(rate: Column, doc_id: str) -> Column:
    """Whole copies with the rate as expectation, drawn by the id's hash; rates count to nine decimals."""
    rate = F.round(rate, 9)
    draw = F.pmod(F.xxhash64(F.lit(11), F.coalesce(F.col(doc_id), F.lit(0))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(rate - F.floor(rate) > draw, 1).otherwise(0)).cast("int")


def domain_of(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else clean or junk by quality."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", name.alias("domain")).where(F.col("domain").isNotNull())


def mixed(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], anchor: str | None = None, **bounds: int) -> DataFrame:
    """doc_id, text hash (h), tokens, p, rate and copies of every row."""
    domains = list(shares)
    post = saved(posteriors(docs, *classifier(docs, labelled, domains, **bounds)), "posteriors")
    out = rates(post, None, list(shares.values()), domains.index(anchor) if anchor else None)
    return out.withColumn("copies", copies(F.col("rate"), "doc_id"))


def resampled(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], anchor: str | None = None, **bounds: int) -> DataFrame:
    """``docs``, all columns, each row as often as its copies say; rows with a null id stay once."""
    doc, times = free_name(docs, "doc"), free_name(docs, "times")
    rated = mixed(docs, labelled, shares, anchor, **bounds)
    other = rated.where((F.col("copies") != 1) & F.col("doc_id").isNotNull()).groupBy("doc_id", "h").agg(F.max("copies").alias("copies"))
    other = few(saved(other, "copies")).select(F.struct("doc_id", "h").alias(doc), F.col("copies").alias(times))
    joined = docs.withColumn(doc, document()).join(other, doc, "left")
    n = F.coalesce(times, F.lit(1))
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)
