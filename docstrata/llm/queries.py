"""The thin opN queries: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ivf_pq, language_model, line_dedup, mixing, negatives, ngram_join, pieces, pii, quality, secrets, topk, urls, whitening
from .shared import free_name, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def of_kind(k: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == k


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("embedding")).alias("z"))
    return topk.search(rows.where(F.col("id") % 50 == 0), rows, k=5)


ORACLE["op2_exact_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, max(CAST(list_inner_product(q.z, x.z) AS BIGINT)) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.z) = len(x.z) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.perplexity_scores(spark, read(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    many = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *many, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(spans).alias("spans"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    many = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *many, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(spans).alias("spans"))


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & ivf_pq.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))
    return ivf_pq.search(rows.where(F.col("id") % 100 == 0), rows, k=10)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    gone = free_name(docs, "gone")
    out = line_dedup.deduplicated(docs, positions=gone)
    n = F.size(F.coalesce(gone, F.array().cast("array<int>"))).cast("long")
    return out.select("doc_id", n.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE["op7_line_dedup"] = r"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line FROM parts WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, pos, line, string_split(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), ' ') AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min((doc_id, pos)) AS first FROM w WHERE len(ws) >= 5 OR length(array_to_string(ws, '')) >= 20 GROUP BY ws),
v AS (SELECT ws, n, first, unnest(generate_series(1, n)) AS i FROM c WHERE n >= 8),
d AS (SELECT ws, n, first, i, list_concat(ws[1:i-1], ws[i+1:n]) AS k FROM v),
near AS (SELECT DISTINCT a.ws FROM d a JOIN (SELECT k, i, n, min(first) AS f FROM d GROUP BY ALL) b ON a.k = b.k AND a.i = b.i AND a.n = b.n WHERE b.f < a.first
         UNION SELECT DISTINCT a.ws FROM d a JOIN c b ON b.ws = a.k AND b.n >= 8 WHERE b.first < a.first
         UNION SELECT DISTINCT b.ws FROM d a JOIN c b ON b.ws = a.k AND b.n >= 8 WHERE a.first < b.first),
gone AS (SELECT w.doc_id, w.pos FROM w JOIN c ON c.ws = w.ws LEFT JOIN near ON near.ws = w.ws WHERE near.ws IS NOT NULL OR c.first < (w.doc_id, w.pos)),
s AS (SELECT l.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS t FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(CASE WHEN n_removed > 0 THEN t ELSE d.text END, '')) AS text_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""


SHARES = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}  # of the pipeline, which leaves clean text as found
MIX = {"clean": 0.6, "junk": 0.25, "toxic": 0.15}  # lowers the plenty and repeats what is scarce


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(read(spark, sf_dir, "documents"), mixing.domain_of(read(spark, sf_dir, "labels")), MIX)
    return out.select("doc_id", "tokens", *(F.element_at("p", k + 1).alias(f"p_{d}") for k, d in enumerate(MIX)), "rate", "copies")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"), pieces.Vocabulary.load())


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(read(spark, sf_dir, "embeddings"), keep=8)
    whole = F.col("deviation").try_cast("long")
    return out.select(F.col("id").alias("vec_id"), F.col("component").cast("int").alias("component"), "n", whole.alias("deviation"), "whitened", "explained", "identity_error")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & topk.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), topk.whole_numbers(F.col("embedding")).alias("z"))
    return negatives.mined(rows, F.col("id") % 100 == 0)


ORACLE["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'z': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))}) AS r FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, x.r.label = a.r.label AS same, CAST(list_inner_product(a.r.z, x.r.z) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id <> x.vec_id AND len(a.r.z) = len(x.r.z) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))
