"""Scores and statistics: agreement, intervals, paired tests, percentiles, rollups and samples."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import table
from ..registry import query

Z = 1.959963984540054


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two verdicts: the label, and a rule on the text (letters carry most of it)."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return l.join(d, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("gold"), F.when(letters * 10 >= F.length("text") * 8, 1).otherwise(0).alias("rule"))


JUDGED = r"""j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality AS gold, CASE WHEN length(regexp_replace(d.text, '[^\p{L}]', '', 'g')) * 10 >= length(d.text) * 8 THEN 1 ELSE 0 END AS rule
  FROM labels l JOIN documents d USING (doc_id))"""


def wilson(k: Column, n: Column, sign: int) -> Column:
    p = k / n
    return F.round((p + Z * Z / (2 * n) + sign * Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n), 6)


def wilson_sql(sign: str) -> str:
    return f"round((k / n + {Z * Z} / (2 * n) {sign} {Z} * sqrt((k / n * (1 - k / n) + {Z * Z} / (4 * n)) / n)) / (1 + {Z * Z} / n), 6)"


@query(f"""WITH {JUDGED}, g AS (SELECT lang, CAST(sum(gold) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY lang) SELECT lang, round(k / n, 6) AS rate, {wilson_sql("-")} AS low, {wilson_sql("+")} AS high FROM g""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judged(spark, sf_dir).groupBy("lang").agg(F.sum("gold").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    k, n = F.col("k"), F.col("n")
    return g.select("lang", F.round(k / n, 6).alias("rate"), wilson(k, n, -1).alias("low"), wilson(k, n, 1).alias("high"))


@query(f"""WITH {JUDGED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (gold = 1 AND rule = 1) AS tp, count(*) FILTER (gold = 0 AND rule = 1) AS fp, count(*) FILTER (gold = 1 AND rule = 0) AS fn, count(*) FILTER (gold = 0 AND rule = 0) AS tn FROM j GROUP BY lang),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n) AS pe FROM c)
SELECT lang, n, tp, fp, fn, tn, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k""")
def kappa_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and Cohen's kappa of the two verdicts."""
    cell = lambda g, r: F.count_if((F.col("gold") == g) & (F.col("rule") == r))
    c = judged(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    n, tp, fp, fn, tn = (F.col(x) for x in ("n", "tp", "fp", "fn", "tn"))
    pe = ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    return c.select("lang", "n", "tp", "fp", "fn", "tn", F.round(((tp + tn) / n - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def log_factorial(n: Column) -> Column:
    """Logarithm of n!, by Stirling's series eight steps further up."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return series - F.log(reduce(mul, (x - k for k in range(1, 9))))


@query(f"""WITH {JUDGED}, f AS (SELECT lang, count(*) FILTER (gold = 1 AND rule = 0) AS lost, count(*) FILTER (gold = 0 AND rule = 1) AS won FROM j GROUP BY lang),
t AS (SELECT *, unnest(generate_series(0, least(lost, won))) AS i FROM f WHERE lost + won > 0)
SELECT lang, lost, won, round(1e-9 + least(1.0, 2 * sum(exp(lgamma(CAST(lost + won + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(lost + won - i + 1 AS DOUBLE)) - (lost + won) * ln(2.0)))), 6) AS p_value FROM t GROUP BY ALL""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact paired test on discordant verdicts, within each language's one row of counts. Terms more than 40 standard deviations below the last are too small to show. The tiny addend keeps exact halves from rounding either way."""
    f = judged(spark, sf_dir).groupBy("lang").agg(F.count_if((F.col("gold") == 1) & (F.col("rule") == 0)).alias("lost"), F.count_if((F.col("gold") == 0) & (F.col("rule") == 1)).alias("won")).where("lost + won > 0")
    n, last = F.col("lost") + F.col("won"), F.least("lost", "won")
    first = F.greatest(F.lit(0), last - (20 * F.sqrt(n)).cast("long") - 50)
    all_ways = log_factorial(n) - n * F.log(F.lit(2.0))
    p = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda acc, i: acc + F.exp(all_ways - log_factorial(i) - log_factorial(n - i)))
    return f.select("lang", "lost", "won", F.round(F.lit(1e-9) + F.least(F.lit(1.0), 2 * p), 6).alias("p_value"))


@query(f"""WITH {JUDGED} SELECT lang, source, grouping(lang) * 2 + grouping(source) AS level, count(*) AS n, round(avg(gold), 6) AS pass_rate, count(*) FILTER (toxic = 1) AS toxic FROM j GROUP BY GROUPING SETS ((lang), (source), ())""")
def slice_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return j.groupingSets([["lang"], ["source"], []], "lang", "source").agg((F.grouping("lang") * 2 + F.grouping("source")).alias("level"), F.count("*").alias("n"), F.round(F.avg("gold"), 6).alias("pass_rate"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY lang""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*(F.round(F.percentile("n_chars", p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)))


@query(f"""WITH {JUDGED}, b AS (SELECT *, CASE WHEN gold = rule THEN 'agree' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 500 THEN 'short' WHEN rule = 1 THEN 'missed junk' ELSE 'false alarm' END AS bucket FROM j)
SELECT bucket, lang, count(*) AS n FROM b GROUP BY ALL""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that holds, for every disagreement."""
    b = F.when(F.col("gold") == F.col("rule"), "agree").when(F.col("toxic") == 1, "toxic").when(F.col("n_chars") < 500, "short").when(F.col("rule") == 1, "missed junk").otherwise("false alarm")
    return judged(spark, sf_dir).groupBy(b.alias("bucket"), "lang").agg(F.count("*").alias("n"))


@query(f"""WITH {JUDGED}, q AS (SELECT source, count(*) AS n, sum(gold) AS k FROM j GROUP BY source)
SELECT source, n, CASE WHEN k = n THEN 'PASS' WHEN k * 2 > n THEN 'MAJORITY' ELSE 'FAIL' END AS verdict, list_filter([CASE WHEN n < 5 THEN 'few runs' END, CASE WHEN k < n THEN 'has failures' END], lambda x: x IS NOT NULL) AS reasons FROM q""")
def pass_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judged(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("gold").alias("k"))
    verdict = F.when(F.col("k") == F.col("n"), "PASS").when(F.col("k") * 2 > F.col("n"), "MAJORITY").otherwise("FAIL")
    return q.select("source", "n", verdict.alias("verdict"), F.array_compact(F.array(F.when(F.col("n") < 5, "few runs"), F.when(F.col("k") < F.col("n"), "has failures"))).alias("reasons"))


UNIT = "(CAST(concat('0x', substr(sha256(concat('w', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) + 1) / 4294967297.0"


def unit_draw(salt: str) -> Column:
    """A number in (0, 1) from the id alone."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)


@query(f"""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(ln({UNIT}) / greatest(n_chars, 1), 12) DESC, doc_id) <= 10""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each source, drawn in proportion to length without replacement (exponential keys)."""
    key = F.round(F.log(unit_draw("w")) / F.greatest("n_chars", F.lit(1)), 12)
    w = Window.partitionBy("source").orderBy(F.desc("k"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", key.alias("k")).withColumn("r", F.row_number().over(w)).where("r <= 10").select("doc_id", "source")


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS turn FROM documents)
SELECT doc_id, lang, turn FROM s WHERE turn <= 25""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.withColumn("turn", F.row_number().over(w)).where("turn <= 25").select("doc_id", "lang", "turn")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of the pass rate of each language: 200 Poisson(1) resamples in one pass, from counts drawn by id."""
    j = judged(spark, sf_dir).select("doc_id", "lang", "gold").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = F.pmod(F.xxhash64("doc_id", "b"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cuts = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)
    weight = sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))
    m = j.withColumn("w", weight).groupBy("lang", "b").agg((F.sum(F.col("w") * F.col("gold")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    return m.groupBy("lang").agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))
