"""Lexical, vector and fused retrieval for a batch of questions (the benchmark table), eligibility before every cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TERMS_SQL, TOKENS_SQL, indexed, term, terms, tokens
from ..model import KEYWORD_OK, VECTOR_OK, VERSIONS, keyword_eligible, table, vector_eligible, versions
from ..registry import query

K1, B, RRF, POOL, CUT = 1.2, 0.75, 60, 30, 12
SMALL = 100_000  # rows of a question-side table that may be broadcast
FEW = 10_000  # questions whose vectors may go to each task


def fits(df: DataFrame, rows: int = SMALL) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame) -> DataFrame:
    """Marks a question-side table for broadcast if it is small; else it is joined by shuffle."""
    return F.broadcast(df) if fits(df) else df


def top(df: DataFrame, by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each question, ranked from 0."""
    w = Window.partitionBy("item_id").orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)  # a bound on row_number itself lets tasks keep k rows before the shuffle


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


EVERY = ""  # no term is empty: stands in each document once, for the statistics


def bm25(spark: SparkSession, sf_dir: str, ok: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of the documents in ``ok`` that share a term with a question; statistics over the whole index.

    Texts are cut into terms once: what stands of the questions' terms, and one
    ``EVERY`` for each document, is shuffled by document, and all that follows
    up to the first k of each question stays in that partition.
    """
    asked = question_terms(spark, sf_dir)
    kept = F.broadcast if fits(asked) else lambda x: x  # no table below has more rows than ``asked``
    wanted = asked.select("term").union(spark.createDataFrame([(EVERY,)], "term string")).distinct()

    def postings(docs: DataFrame) -> DataFrame:
        cut = docs.select("doc_id", F.coalesce(indexed(F.col("text")), F.array().cast("array<string>")).alias("t")).withColumn("dl", F.size("t"))
        each = cut.select("doc_id", "dl", F.explode(F.concat("t", F.array(F.lit(EVERY)))).alias("token")).select("doc_id", "dl", term(F.col("token")).alias("term"))
        return each.join(kept(wanted), "term", "left_semi").repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))

    docs = table(spark, sf_dir, "documents")
    tf = postings(docs.where("doc_id IS NOT NULL"))
    every = tf.union(postings(docs.where("doc_id IS NULL")))  # apart, since they count but join nothing: else the join's own filter would part its plan from that of the statistics
    # Written as one aggregate each over all of ``every``, so that both plans keep the exchange of ``tf`` as it is.
    whole = F.col("term") == EVERY
    stats = every.agg(F.count_if(whole & (F.col("tf") > 0)).alias("n"), F.avg(F.when(whole, F.col("dl"))).alias("avgdl"))
    df = every.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") >= 0)).alias("df"))
    p = tf.join(ok, "doc_id", "left_semi").join(kept(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = p.select("doc_id", "term", part.alias("part")).join(kept(asked), "term")
    return scored.groupBy("item_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


BM25 = f"""q AS (SELECT item_id, unnest(list_distinct({TERMS_SQL.format("text")})) AS term FROM benchmark),
len AS (SELECT doc_id, coalesce({TERMS_SQL.format("text")}, []) AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM len),
hit AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM len),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM hit WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * {K1 + 1} / (tf.tf + {K1} * (1 - {B} + {B} * tf.dl / st.avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def lexical_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = keyword_eligible(versions(spark, sf_dir)).select("doc_id")
    return top(bm25(spark, sf_dir, ok), [F.desc("score"), F.col("doc_id")], POOL)


LEXICAL = f"""lex AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank
  FROM bm SEMI JOIN (SELECT doc_id FROM ver WHERE {KEYWORD_OK}) e USING (doc_id) QUALIFY rank < {POOL})"""


@query(f"WITH {VERSIONS}, {BM25}, {LEXICAL} SELECT item_id, doc_id, score, rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_leg(spark, sf_dir).select("item_id", "doc_id", "score", "rank")


@query(f"""WITH {VERSIONS}, {BM25} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank
  FROM bm SEMI JOIN (SELECT doc_id FROM ver WHERE {KEYWORD_OK} AND source_id = 'src3') e USING (doc_id) QUALIFY rank < 5""")
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking inside one source; the scope applies before the cut."""
    ok = keyword_eligible(versions(spark, sf_dir)).where("source_id = 'src3'").select("doc_id")
    return top(bm25(spark, sf_dir, ok), [F.desc("score"), F.col("doc_id")], 5).select("item_id", "doc_id", "score", "rank")


NEAR = 2e-6  # distances that are equal to six places differ by less
BLOCK = 1_000_000  # distances that a task holds at a time


def vectors(df: pa.Table | pa.RecordBatch, name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` components as rows, and which of them have null components."""
    x = df.column(name).combine_chunks() if isinstance(df, pa.Table) else df.column(name)
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(df.num_rows, dim), x.flatten().is_null().to_numpy(zero_copy_only=False).reshape(df.num_rows, dim)
    return x[0], x[1].any(axis=1)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` to each of ``q``, summed in the order of components."""
    out = np.zeros((len(x), len(q)))
    for a, b in zip(x.T, q.T, strict=True):
        gap = a[:, None] - b
        out += gap * gap
    return np.sqrt(out)


def nearest(asked: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch (doc_id, dim, v), for each question of that length, the k + 1 nearest rows and all that six places may not tell from them; null distances are nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = {n: asked.filter(pa.compute.equal(asked["dim"], n)) for n in asked["dim"].unique().to_pylist()}
        questions = {n: (t["item_id"].combine_chunks(), *vectors(t, "q", n)) for n, t in questions.items()}
        for batch in batches:
            for dim, (items, q, q_null) in questions.items():
                rows = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                if not rows.num_rows:
                    continue
                x, x_null = vectors(rows, "v", dim)
                step = max(1, BLOCK // len(x))
                for at in range(0, len(items), step):
                    d = distances(x, q[at : at + step])
                    d[x_null], d[:, q_null[at : at + step]] = -np.inf, -np.inf
                    edge = np.partition(d, k, axis=0)[k] if len(x) > k else np.full(d.shape[1], np.inf)
                    row, col = np.nonzero(~(d > edge + NEAR))
                    found = d[row, col]
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(col + at)), rows.column("doc_id").take(pa.array(row)), pa.array(found, mask=np.isneginf(found))], names=["item_id", "doc_id", "distance"])

    return run


def vector_leg(spark: SparkSession, sf_dir: str, k: int = POOL) -> DataFrame:
    """Exact Euclidean neighbours of each question's vector (vec_id = item_id) among eligible documents' vectors (vec_id = doc_id).

    Vectors are few bytes for much work, so they are dealt out by number.
    Where the questions are few, tasks compare them with batches of vectors and
    keep what may be among the first k; else both sides are joined.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL").withColumn("dim", F.size("v"))
    asked = table(spark, sf_dir, "benchmark").select("item_id").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", "dim", F.col("v").alias("q"))
    ok = vector_eligible(versions(spark, sf_dir)).select("doc_id")
    rows = e.withColumnRenamed("vec_id", "doc_id").join(ok, "doc_id", "left_semi").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    few = asked.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW:
        types = {**dict(asked.dtypes), **dict(rows.dtypes)}
        pairs = rows.mapInArrow(nearest(few, k), f"item_id {types['item_id']}, doc_id {types['doc_id']}, distance double")
    else:
        dist = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
        pairs = rows.join(small(asked), "dim").select("item_id", "doc_id", dist.alias("distance"))
    pairs = pairs.where("doc_id <> item_id").select("item_id", "doc_id", F.round("distance", 6).alias("distance"))
    return top(pairs, [F.col("distance"), F.col("doc_id")], k)


VECTOR = f"""vec AS (SELECT b.item_id, x.vec_id AS doc_id, round(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(qe.embedding AS DOUBLE[])), 6) AS distance,
    row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(qe.embedding AS DOUBLE[])), 6), x.vec_id) - 1 AS rank
  FROM benchmark b JOIN embeddings qe ON qe.vec_id = b.item_id JOIN embeddings x ON x.vec_id <> b.item_id
  SEMI JOIN (SELECT doc_id FROM ver WHERE {VECTOR_OK}) e ON e.doc_id = x.vec_id QUALIFY rank < {POOL})"""


@query(f"WITH {VERSIONS}, {VECTOR} SELECT item_id, doc_id, distance, rank FROM vec")
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_leg(spark, sf_dir).select("item_id", "doc_id", "distance", "rank")


def fused(legs: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (item_id, doc_id, rank)."""
    every = None
    for leg, weight in legs:
        part = leg.select("item_id", "doc_id", (F.lit(weight) / (RRF + F.col("rank") + 1)).alias("part"))
        every = part if every is None else every.unionByName(part)
    score = every.groupBy("item_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(score, [F.desc("score"), F.col("doc_id")], k)


def fused_sql(w1: float, w2: float, k: int) -> str:
    return f"""fus AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM
  (SELECT item_id, doc_id, round(sum(part), 9) AS score FROM (SELECT item_id, doc_id, CAST({w1} AS DOUBLE) / ({RRF} + rank + 1) AS part FROM lex
   UNION ALL SELECT item_id, doc_id, CAST({w2} AS DOUBLE) / ({RRF} + rank + 1) FROM vec) GROUP BY ALL) QUALIFY rank < {k})"""


LEGS = f"WITH {VERSIONS}, {BM25}, {LEXICAL}, {VECTOR}"


@query(f"{LEGS}, {fused_sql(1.0, 1.0, CUT)} SELECT item_id, doc_id, score, rank FROM fus")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused([(lexical_leg(spark, sf_dir), 1.0), (vector_leg(spark, sf_dir), 1.0)], CUT).select("item_id", "doc_id", "score", "rank")


@query(f"{LEGS}, {fused_sql(1.5, 1.0, CUT)} SELECT item_id, doc_id, score, rank FROM fus")
def weighted_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused([(lexical_leg(spark, sf_dir), 1.5), (vector_leg(spark, sf_dir), 1.0)], CUT).select("item_id", "doc_id", "score", "rank")


@query(f"""{LEGS}, {fused_sql(1.0, 1.0, CUT)},
res AS (SELECT f.*, v.source_id, concat('[', v.source_id, ' #', substr(sha256(v.text), 1, 12), ']') AS label, CAST(ceil(length(v.text) / 3.0) AS BIGINT) AS tokens FROM fus f JOIN ver v USING (doc_id)),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM res)
SELECT item_id, rank, doc_id, source_id, label, score, tokens FROM cum WHERE rank = 0 OR used <= 6000""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs fused, resolved to citation labels, and cut to a token budget that keeps the first."""
    hits = fused([(lexical_leg(spark, sf_dir), 1.0), (vector_leg(spark, sf_dir), 1.0)], CUT)
    label = F.format_string("[%s #%s]", F.col("source_id"), F.left(F.sha2("text", 256), F.lit(12)))
    used = F.sum("tokens").over(Window.partitionBy("item_id").orderBy("rank"))
    bounded = fits(table(spark, sf_dir, "benchmark"), SMALL // CUT)  # each question has CUT hits at most, so the fused plan need not run to be counted
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "text")
    found = docs.join(F.broadcast(hits) if bounded else hits, "doc_id").select("item_id", "rank", "doc_id", "source_id", label.alias("label"), "score", F.ceil(F.length("text") / 3.0).alias("tokens"))
    each = found.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left")  # a row for each version, as a document with several labels has; no text is shuffled
    out = each.withColumn("used", used).where((F.col("rank") == 0) | (F.col("used") <= 6000))
    return out.select("item_id", "rank", "doc_id", "source_id", "label", "score", "tokens")


def run_of(t: str) -> Column:
    """Tokens as one string, each between spaces."""
    return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))


def lengths(asked: DataFrame) -> list[int]:
    """The few different lengths ``n`` of the keys of ``asked``."""
    return sorted(r["n"] for r in asked.select("n").distinct().collect())


def grams(units: str, sizes: list[int], between: str) -> Column:
    """The distinct runs of ``sizes`` units."""

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(units) - k + 1), lambda i: F.array_join(F.slice(units, i, k), between))
        return F.when(F.size(units) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *map(of, sizes)))


def holding(d: DataFrame, keys: Column, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the texts of ``d`` that hold a span of ``asked`` (item_id, span, key) and its key; a text is shuffled only where the spans are too many for a broadcast."""
    within = F.contains("text", "span")
    if fits(asked):
        return d.select("doc_id", "text", F.explode(keys).alias("key")).join(F.broadcast(asked), "key").where(within).select("item_id", "doc_id")
    cand = d.select("doc_id", F.explode(keys).alias("key")).join(asked, "key").select("item_id", "doc_id", "span")
    return d.join(cand, "doc_id").where(within).select("item_id", "doc_id")


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of the texts that hold a gold span verbatim: candidates by the span's longest inner word, or its first characters where it has none, then an exact test."""
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span")).where(F.col("span").isNotNull())
    inner = F.slice(F.split("span", r"\s+"), 2, F.greatest(F.size(F.split("span", r"\s+")) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = gold.select("item_id", "span", key.alias("key"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = holding(d, F.array_distinct(F.split("text", r"\s+")), keyed.where(F.col("key").isNotNull()))
    short = keyed.where(F.col("key").isNull()).withColumn("c", F.split("span", ""))
    short = short.withColumn("n", F.when(F.col("span") == "", 0).otherwise(F.least(F.size("c"), F.lit(4))))
    short = short.select("item_id", "span", "n", F.array_join(F.slice("c", F.lit(1), F.col("n")), "").alias("key"))
    if sizes := lengths(short):
        found = found.union(holding(d.withColumn("c", F.split("text", "")), grams("c", sizes, ""), short))
    return found.distinct()


@query(f"""WITH {VERSIONS}, b AS (SELECT item_id, {TOKENS_SQL.format("text")} AS t FROM benchmark),
d AS (SELECT doc_id, concat(' ', array_to_string({TOKENS_SQL.format("text")}, ' '), ' ') AS t FROM ver WHERE {KEYWORD_OK})
SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, concat(' ', array_to_string(b.t, ' '), ' ')) WHERE len(b.t) > 0""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible documents that hold all of a question's tokens in a row: candidates by its longest token, then the whole run."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    key = F.array_max(F.transform("t", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.select("item_id", run_of("t").alias("phrase"), key.alias("key"))
    ok = keyword_eligible(versions(spark, sf_dir)).select("doc_id", "text")
    d = ok.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.array_distinct("t").alias("each"), run_of("t").alias("run"))
    cand = d.select("doc_id", F.explode("each").alias("key"), "run").join(small(asked), "key")
    return cand.where(F.contains("run", "phrase")).select("item_id", "doc_id")


@query(f"""WITH b AS (SELECT item_id, text FROM benchmark) SELECT b.item_id, count(d.doc_id) AS n_docs, min(d.doc_id) AS first_doc FROM b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def span_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts hold each gold span verbatim."""
    gold, hit = table(spark, sf_dir, "benchmark").select("item_id"), span_pairs(spark, sf_dir)
    return gold.join(hit.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")), "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


@query(f"""{LEGS}, {fused_sql(1.0, 1.0, CUT)}, gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT g.item_id, min(f.rank) AS best FROM gold g LEFT JOIN fus f ON f.item_id = g.item_id AND f.doc_id = g.doc_id GROUP BY g.item_id)
SELECT k, count(*) AS n, sum(CASE WHEN best < k THEN 1 ELSE 0 END) AS hits, round(avg(CASE WHEN best < k THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN best < k THEN 1.0 / (best + 1) ELSE 0.0 END), 6) AS mrr
FROM h, (SELECT unnest([1, 3, 5, 12]) AS k) GROUP BY k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold spans whose text is among the first k fused hits, and the mean reciprocal rank."""
    hits = rrf_fuse(spark, sf_dir).select("item_id", "doc_id", "rank")
    best = span_pairs(spark, sf_dir).join(hits, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("best"))
    each = best.withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 12)))))
    hit = F.coalesce(F.col("best") < F.col("k"), F.lit(False))
    return each.groupBy("k").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.round(F.avg(F.when(hit, 1 / (F.col("best") + 1)).otherwise(0.0)), 6).alias("mrr"))
