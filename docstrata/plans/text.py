"""Text scalar functions over whole tables, page parsing and table runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SUFFIXES, TOKENS_SQL, column_letters, column_number, core_name, normal_name, redact, redact_sql, tokens
from ..model import table
from ..registry import query
from ..sources.html import visible_blocks


@query(f"SELECT doc_id, sha256({redact_sql('text')}) AS redacted_sha256, length({redact_sql('text')}) AS n_chars FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, credentials, secrets, addresses and long digit runs out of every text, in that order."""
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("t")).select("doc_id", F.sha2("t", 256).alias("redacted_sha256"), F.length("t").alias("n_chars"))


NAME_SQL = r"regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[''’]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '^the ', '')"
CORE = f" ({'|'.join(SUFFIXES)})"


@query(f"""WITH n AS (SELECT c_custkey AS id, 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT p_partkey, 'part', p_name FROM part)
SELECT id, kind, {NAME_SQL.format("name")} AS normal, regexp_replace({NAME_SQL.format("name")}, '({CORE})+$', '') AS core FROM n""")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(k).alias("id"), F.lit(t).alias("kind"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    n = parts[0].union(parts[1]).union(parts[2])
    return n.select("id", "kind", normal_name(F.col("name")).alias("normal"), core_name(F.col("name")).alias("core"))


IDENT = r"[A-Z]{2,6}-[0-9]{1,6}"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{IDENT}')) AS identifiers, len(regexp_extract_all(text, '[0-9]+')) AS numbers, list_sort(list_distinct(regexp_extract_all(text, '[0-9]{{1,3}}(?:,[0-9]{{3}})+'))) AS grouped FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and number forms found in each text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(IDENT)).alias("identifiers"), F.regexp_count(t, F.lit("[0-9]+")).alias("numbers"), F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+"), F.lit(0)))).alias("grouped"))


PERIOD = r"(?i)(^|[^a-z0-9])(fy ?[0-9]{2,4}|q[1-4]|h[12]|(19|20)[0-9]{2})([^a-z0-9]|$)"
FOLLOW = r"(?i)^(and|what about|how about|why|also|then)( |$)"
COMPUTE = r"(?i)(sum|total|average|percent|ratio|difference|how (many|much))"


@query(f"""SELECT conv_id, turn, regexp_matches(text, '{PERIOD}') AS has_period, (regexp_matches(text, '{FOLLOW}') AND len(string_split(trim(text), ' ')) <= 8) AS follow_up,
CASE WHEN regexp_matches(text, '{COMPUTE}') THEN 'INVESTIGATION' WHEN length(trim(text)) < 8 THEN 'CLARIFY' ELSE 'FAST' END AS route FROM conversations WHERE role = 'user'""")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic routing signals of every user turn, in fixed precedence."""
    c, t = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("text")
    route = F.when(t.rlike(COMPUTE), "INVESTIGATION").when(F.length(F.trim(t)) < 8, "CLARIFY").otherwise("FAST")
    return c.select("conv_id", "turn", t.rlike(PERIOD).alias("has_period"), (t.rlike(FOLLOW) & (F.size(F.split(F.trim(t), " ")) <= 8)).alias("follow_up"), route.alias("route"))


@query("""WITH h AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER w AS back, sum(length(text)) OVER w AS used FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, n FROM h WHERE back <= 6 AND used <= 2000""")
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recent turns within a turn and a character budget; the oldest go first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    h = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", F.length("text").alias("n"))
    return h.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum("n").over(w)).where("back <= 6 AND used <= 2000").select("conv_id", "turn", "n")


@query("""WITH c AS (SELECT conv_id, turn, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, sum(CAST(ceil(length(text) / 3.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
SELECT conv_id, turn, tokens FROM c WHERE rank = 1 OR used <= 400""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that fit a token budget in order; the first always stays."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 3.0).alias("tokens"))
    return c.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w)).where("rank = 1 OR used <= 400").select("conv_id", "turn", "tokens")


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def dedupe_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive repeats inside a conversation: the first stays."""
    w = Window.partitionBy("conv_id", F.lower("text")).orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r = 1").select("conv_id", "turn", "text")


@query("""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, contains(line, '|') AS piped FROM l),
g AS (SELECT *, sum(CASE WHEN piped IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(piped) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k))
SELECT doc_id, run, any_value(piped) AS is_table, min(pos) AS first_line, count(*) AS n_lines FROM g GROUP BY doc_id, run""")
def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of prose and of pipe-table lines, as gaps and islands."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    k = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.contains("line", F.lit("|")).alias("piped"))
    change = F.when(F.lag("piped").over(w).eqNullSafe(F.col("piped")), 0).otherwise(1)
    g = k.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    return g.groupBy("doc_id", "run").agg(F.first("piped").alias("is_table"), F.min("pos").alias("first_line"), F.count("*").alias("n_lines"))


@query(r"""WITH r AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, pos, array_to_string(list_transform(string_split(line, '|'), lambda c: trim(c)), ' | ') AS row, len(string_split(line, '|')) AS cells FROM r WHERE contains(line, '|')""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-table rows with their cells trimmed."""
    r = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.contains("line", F.lit("|")))
    cells = F.split("line", r"\|")
    return r.select("doc_id", "pos", F.array_join(F.transform(cells, lambda c: F.trim(c)), " | ").alias("row"), F.size(cells).alias("cells"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS term FROM t)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM e GROUP BY term HAVING count(DISTINCT doc_id) >= 3""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequency; documents are aggregated first, so only distinct terms are dealt out."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return e.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).where("df >= 3")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)), ''), url) AS title, len(regexp_extract_all(html, '(?i)<a ')) AS links FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.when(title != "", title).otherwise(F.col("url")).alias("title"), F.regexp_count("html", F.lit("(?i)<a ")).alias("links"))


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text blocks of every page with their heading path."""
    return visible_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""WITH d AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id, CAST(list_reduce(list_transform(string_split(h, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % 100) AS INTEGER) AS bucket FROM d""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256 of the id, as a number modulo 100: a split that no other row moves."""
    h = F.split(F.sha2(F.col("doc_id").cast("string"), 256), "")
    bucket = F.aggregate(h, F.lit(0), lambda a, c: (a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % 100)
    return table(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || CAST(l_linenumber AS VARCHAR) AS address, n AS col
FROM (SELECT l_orderkey, l_linenumber, CAST(1 + l_partkey % 702 AS INTEGER) AS n FROM lineitem)""")
def cell_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 addresses from numbers, and the column number read back from them."""
    n = (1 + F.col("l_partkey") % 702).cast("int")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(column_letters(n), F.col("l_linenumber").cast("string")).alias("address"))
    return d.select("l_orderkey", "l_linenumber", "address", column_number(F.regexp_extract("address", "^([A-Z]+)", 1)).alias("col"))
