"""Library state: eligibility, coverage, duplicates, change sets, segmentation and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import KEYWORD_OK, VECTOR_OK, VERSIONS, keyword_eligible, source_status, table, vector_eligible, versions, windows, windows_sql
from ..operators.overlap import overlapping_windows
from ..registry import query
from .retrieval import small


@query(f"WITH {VERSIONS} SELECT doc_id, source_id, ({KEYWORD_OK}) AS keyword_ok, ({VECTOR_OK}) AS vector_ok FROM ver")
def eligible_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which leg may serve each version: both need an active source."""
    active = F.col("source_status") == "ACTIVE"
    return versions(spark, sf_dir).select("doc_id", "source_id", (active & F.col("status").isin("READY", "TEXT_READY")).alias("keyword_ok"), (active & (F.col("status") == "READY")).alias("vector_ok"))


@query(f"""WITH {VERSIONS} SELECT source_id, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'TEXT_READY') AS text_ready, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS total FROM ver GROUP BY source_id""")
def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return v.groupBy("source_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "TEXT_READY", "FAILED")), F.count("*").alias("total"))


@query(f"""WITH {VERSIONS}, c AS (SELECT source_id, count(*) FILTER (status = 'READY') AS r, count(*) FILTER (status = 'TEXT_READY') AS t FROM ver WHERE source_status = 'ACTIVE' GROUP BY source_id)
SELECT source_id, CASE WHEN t = 0 THEN NULL ELSE round(r / (r + t), 6) END AS coverage FROM c""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of served versions that are fully indexed; null when all are."""
    v = versions(spark, sf_dir).where("source_status = 'ACTIVE'").groupBy("source_id").agg(F.count_if(F.col("status") == "READY").alias("r"), F.count_if(F.col("status") == "TEXT_READY").alias("t"))
    return v.select("source_id", F.when(F.col("t") > 0, F.round(F.col("r") / (F.col("r") + F.col("t")), 6)).alias("coverage"))


@query(f"""WITH {VERSIONS}, g AS (SELECT source_id, any_value(source_status) AS s, count(*) AS n, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'TEXT_READY') AS t FROM ver GROUP BY source_id)
SELECT source_id, CASE WHEN s <> 'ACTIVE' THEN 'unavailable' WHEN f = n THEN 'failed' WHEN t > 0 THEN 'indexing' ELSE 'ready' END AS readiness,
  list_filter([CASE WHEN f * 10 > n THEN 'many_failures' END, CASE WHEN n < 10 THEN 'few_files' END], lambda x: x IS NOT NULL) AS flags FROM g""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir).groupBy("source_id").agg(F.first("source_status").alias("s"), F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("f"), F.count_if(F.col("status") == "TEXT_READY").alias("t"))
    state = F.when(F.col("s") != "ACTIVE", "unavailable").when(F.col("f") == F.col("n"), "failed").when(F.col("t") > 0, "indexing").otherwise("ready")
    flags = F.array_compact(F.array(F.when(F.col("f") * 10 > F.col("n"), "many_failures"), F.when(F.col("n") < 10, "few_files")))
    return v.select("source_id", state.alias("readiness"), flags.alias("flags"))


@query("""SELECT sha256(text) AS content_hash, count(*) AS refs, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that more than one document refers to. Only hashes are dealt out, not texts."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "source", "doc_id")
    per = d.groupBy("content_hash", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    return per.groupBy("content_hash").agg(F.sum("n").alias("refs"), F.count("*").alias("n_sources"), F.min("m").alias("first_doc")).where("refs > 1")


@query("""WITH h AS (SELECT sha256(text) AS k, count(DISTINCT source) AS s, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) AS contents, CAST(sum(n) AS BIGINT) AS documents, max(s) AS max_sources, round(avg(s), 6) AS mean_sources, count(*) FILTER (s > 1) AS shared FROM h""")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k"), "source").agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("s"), F.sum("n").alias("n"))
    return d.agg(F.count("*").alias("contents"), F.sum("n").alias("documents"), F.max("s").alias("max_sources"), F.round(F.avg("s"), 6).alias("mean_sources"), F.count_if(F.col("s") > 1).alias("shared"))


CHUNKS = f"""{windows_sql()}, chk AS (SELECT doc_id, ordinal, start, len(words) AS n_words, sha256(array_to_string(words, ' ')) AS content_hash FROM win)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "start", F.size("words").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("content_hash"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, start, n_words, content_hash FROM chk")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query(f"""WITH {CHUNKS} SELECT concat('chk_', sha256(concat_ws('|', CAST(doc_id AS VARCHAR), 'w200-40', CAST(ordinal AS VARCHAR), content_hash))) AS chunk_id, doc_id, ordinal FROM chk""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on version, recipe, ordinal and content alone."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("w200-40"), F.col("ordinal").cast("string"), "content_hash")
    return chunks(spark, sf_dir).select(F.concat(F.lit("chk_"), F.sha2(key, 256)).alias("chunk_id"), "doc_id", "ordinal")


@query(f"""WITH {CHUNKS} SELECT doc_id, ordinal, lag(content_hash) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before, lead(content_hash) OVER (PARTITION BY doc_id ORDER BY ordinal) AS after FROM chk""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks(spark, sf_dir).select("doc_id", "ordinal", F.lag("content_hash").over(w).alias("before"), F.lead("content_hash").over(w).alias("after"))


@query(f"""WITH {CHUNKS} SELECT content_hash, doc_id, ordinal FROM chk QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id, ordinal) = 1""")
def dedupe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunk of each content; a partial minimum before the shuffle, so a hot content is no hot task."""
    first = chunks(spark, sf_dir).groupBy("content_hash").agg(F.min(F.struct("doc_id", "ordinal")).alias("f"))
    return first.select("content_hash", "f.doc_id", "f.ordinal")


SHINGLES = 6


@query(f"""WITH {windows_sql("a", 200, 40)}, {windows_sql("b", 150, 30)},
ga AS (SELECT DISTINCT doc_id, ordinal AS old_ordinal, words[i:i+5] AS g FROM (SELECT *, unnest(generate_series(1, len(words) - 5)) AS i FROM a WHERE len(words) >= 6)),
gb AS (SELECT DISTINCT doc_id, ordinal AS new_ordinal, words[i:i+5] AS g FROM (SELECT *, unnest(generate_series(1, len(words) - 5)) AS i FROM b WHERE len(words) >= 6)),
m AS (SELECT doc_id, old_ordinal, new_ordinal, count(*) AS shared FROM ga JOIN gb USING (doc_id, g) GROUP BY ALL)
SELECT doc_id, old_ordinal, new_ordinal, shared FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, old_ordinal ORDER BY shared DESC, new_ordinal) = 1""")
def alias_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which new chunk replaces each old one after a change of recipe: most shared word 6-grams."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    again = small(d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    once = d.join(again, "doc_id", "left_anti").select("doc_id", F.array("text").alias("texts"))  # a document's windows meet in its row, so that nothing is shuffled
    more = d.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    found = overlapping_windows((200, 40), (150, 30), SHINGLES)
    return once.union(more).mapInArrow(found, f"doc_id {dict(d.dtypes)['doc_id']}, old_ordinal int, new_ordinal int, shared long")


@query(f"""WITH {VERSIONS}, lexical AS (SELECT doc_id FROM ver WHERE status <> 'FAILED'), vector AS (SELECT vec_id AS doc_id FROM embeddings), now AS (SELECT doc_id FROM ver WHERE {VECTOR_OK}),
i AS (SELECT doc_id FROM lexical UNION SELECT doc_id FROM vector)
SELECT coalesce(i.doc_id, now.doc_id) AS doc_id, CASE WHEN now.doc_id IS NULL THEN 'stale' WHEN v.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'indexed' ELSE 'write' END AS action
FROM i FULL JOIN now ON now.doc_id = i.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM lexical) l ON l.doc_id = coalesce(i.doc_id, now.doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM vector) v ON v.doc_id = coalesce(i.doc_id, now.doc_id)""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed ids that are no longer current are stale; current ids in both indexes need nothing; the rest is written. One aggregation over tagged ids."""
    v = versions(spark, sf_dir)
    tag = lambda df, t: df.select("doc_id", F.lit(t).alias("t"))
    every = tag(v.where("status <> 'FAILED'"), "l").union(tag(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "v")).union(tag(vector_eligible(v), "n"))
    g = every.groupBy("doc_id").agg(*(F.max((F.col("t") == t).cast("int")).alias(t) for t in "lvn"))
    return g.select("doc_id", F.when(F.col("n") == 0, "stale").when((F.col("l") == 1) & (F.col("v") == 1), "indexed").otherwise("write").alias("action"))


@query("""SELECT coalesce(d.doc_id, p.page_id) AS file_id, CASE WHEN p.page_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted' WHEN d.n_chars <> length(p.html) THEN 'changed' ELSE 'same' END AS change
FROM documents d FULL JOIN pages p ON p.page_id = d.doc_id""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing (documents) against a stored state (pages) by id and size."""
    d, p = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"))
    kind = F.when(F.col("page_id").isNull(), "new").when(F.col("doc_id").isNull(), "deleted").when(F.col("n_chars") != F.col("size"), "changed").otherwise("same")
    return d.join(p, d["doc_id"] == p["page_id"], "full").select(F.coalesce("doc_id", "page_id").alias("file_id"), kind.alias("change"))


@query("""WITH m AS (SELECT source, lang, max(n_chars) AS top FROM documents GROUP BY ALL)
SELECT d.source, d.lang, max(d.doc_id) AS doc_id, count(*) AS ties FROM documents d JOIN m ON m.source = d.source AND m.lang = d.lang AND m.top = d.n_chars GROUP BY ALL HAVING count(*) = 1""")
def family_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest member of each family (here the longest text of a source and language); families with a tie are left alone."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang", "n_chars").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("ties"))
    best = d.groupBy("source", "lang").agg(F.max(F.struct("n_chars", "doc_id", "ties")).alias("b"))
    return best.select("source", "lang", "b.doc_id", "b.ties").where("ties = 1")


@query("""SELECT 'labels' AS edge, count(*) FILTER (d.doc_id IS NULL) AS dangling, count(*) AS total FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id
UNION ALL SELECT 'embeddings', count(*) FILTER (d.doc_id IS NULL), count(*) FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
UNION ALL SELECT 'pages', count(*) FILTER (d.doc_id IS NULL), count(*) FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table whose document is gone."""
    d = table(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("there", F.lit(True))
    out = None
    for name, key in (("labels", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id")):
        t = table(spark, sf_dir, name).select(F.col(key).alias("doc_id")).join(d, "doc_id", "left").agg(F.count_if(F.col("there").isNull()).alias("dangling"), F.count("*").alias("total")).select(F.lit(name).alias("edge"), "dangling", "total")
        out = t if out is None else out.union(t)
    return out


@query("""SELECT source, row_number() OVER (ORDER BY first_doc NULLS LAST, source) AS number FROM (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source)""")
def source_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers for sources, oldest first: sources are few, so one task ranks them after aggregation."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return s.select("source", F.row_number().over(Window.orderBy(F.col("first_doc").asc_nulls_last(), "source")).alias("number"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents), t AS (SELECT source, CASE CAST(substr(source, 4) AS INTEGER) % 10 WHEN 0 THEN 'REVOKED' WHEN 1 THEN 'MISSING' ELSE 'ACTIVE' END AS status FROM s),
e AS (SELECT * FROM (VALUES ('ACTIVE', 'pause', 'PAUSED'), ('ACTIVE', 'revoke', 'REVOKED'), ('ACTIVE', 'lose', 'MISSING'), ('MISSING', 'find', 'ACTIVE'), ('MISSING', 'revoke', 'REVOKED')) AS v(status, event, next))
SELECT t.source, e.event, e.next FROM t JOIN e USING (status)""")
def source_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each source's state allows, from a transition table."""
    edges = [("ACTIVE", "pause", "PAUSED"), ("ACTIVE", "revoke", "REVOKED"), ("ACTIVE", "lose", "MISSING"), ("MISSING", "find", "ACTIVE"), ("MISSING", "revoke", "REVOKED")]
    e = spark.createDataFrame(edges, "status string, event string, next string")
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("status", source_status(F.col("source")))
    return s.join(F.broadcast(e), "status").select("source", "event", "next")


@query(f"""WITH {VERSIONS} SELECT v.doc_id, min(o.doc_id) AS donor FROM ver v JOIN ver o ON sha256(o.text) = sha256(v.text) AND o.doc_id < v.doc_id AND o.status = 'READY' GROUP BY v.doc_id""")
def clone_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest ready version of the same content, for versions that can be cloned: an aggregate per hash, joined back, never pairs."""
    v = versions(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), "status")
    donor = v.where("status = 'READY'").groupBy("h").agg(F.min("doc_id").alias("donor"))
    return v.join(donor, "h").where("donor < doc_id").select("doc_id", "donor")


@query(f"""WITH {VERSIONS} SELECT source_id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(ceil(sum(CASE lang WHEN 'en' THEN 0.5 ELSE 0.8 END)) AS BIGINT) AS eta_s, (count(*) > 1000) AS broad FROM ver WHERE {KEYWORD_OK} GROUP BY source_id""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, broadness and a time estimate for each source, from costs by kind."""
    v = keyword_eligible(versions(spark, sf_dir))
    cost = F.when(F.col("lang") == "en", F.expr("0.5")).otherwise(F.expr("0.8"))
    return v.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.ceil(F.sum(cost)).cast("long").alias("eta_s"), (F.count("*") > 1000).alias("broad"))
