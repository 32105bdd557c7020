"""Chunks under a token cap, tables cut at row borders, and pages found again in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import table
from ..operators import chunking
from ..registry import query

CAP = 400 * chunking.CHARS
BLANK = r"[ \t\n\r\f]"


def greedy_sql(src: str, key: str) -> str:
    """CTEs (recursive) that number the greedy packs of ``src`` (key, i from 1, size above 0, cap): ``pack`` is ``src`` with a column chunk."""
    return f"""cu AS (SELECT *, sum(size) OVER (PARTITION BY {key} ORDER BY i) AS cum FROM {src}),
nx AS MATERIALIZED (SELECT a.{key}, a.i, b.i AS nxt FROM cu a ASOF JOIN cu b ON a.{key} = b.{key} AND a.cum - a.size + a.cap < b.cum),
be AS (SELECT DISTINCT {key}, CAST(1 AS BIGINT) AS i, 0 AS chunk FROM {src} UNION ALL SELECT be.{key}, nx.nxt, be.chunk + 1 FROM be JOIN nx ON nx.{key} = be.{key} AND nx.i = be.i),
pack AS (SELECT s.*, be.chunk FROM {src} s ASOF JOIN be ON s.{key} = be.{key} AND s.i >= be.i)"""


PIECES_SQL = rf"""list_filter(flatten(list_transform(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda x: CASE WHEN length(x) <= cap THEN [x] ELSE
  flatten(list_transform(string_split(regexp_replace(x, '([.!?]{BLANK})', concat('\1', chr(1)), 'g'), chr(1)), lambda y: CASE WHEN length(y) <= cap THEN [y] ELSE
  flatten(list_transform(string_split(regexp_replace(y, '({BLANK})([^ \t\n\r\f])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda z: CASE WHEN length(z) <= cap THEN [z] ELSE
  list_transform(generate_series(0, (length(z) - 1) // cap), lambda k: substr(z, k * cap + 1, cap)) END)) END)) END)), lambda x: x <> '')"""


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, text, concat(source, ' > ', doc_id, chr(10)) AS head FROM documents WHERE text <> ''), e AS (SELECT *, {CAP} - length(head) AS cap FROM d),
ps AS (SELECT doc_id, head, cap, {PIECES_SQL} AS ps FROM e),
p AS (SELECT doc_id, head, cap, unnest(generate_series(1, len(ps))) AS i, unnest(ps) AS piece FROM ps), src AS (SELECT *, length(piece) AS size FROM p),
{greedy_sql("src", "doc_id")}
SELECT doc_id, chunk AS ordinal, length(concat(any_value(head), string_agg(piece, '' ORDER BY i))) AS n_chars, sha256(concat(any_value(head), string_agg(piece, '' ORDER BY i))) AS content_hash FROM pack GROUP BY doc_id, chunk""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in chunks under a token cap that each begin with where it comes from; lines stay whole where they fit, else sentences, else words."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    head = F.concat("source", F.lit(" > "), F.col("doc_id").cast("string"), F.lit("\n"))
    c = d.select("doc_id", F.posexplode(chunking.prefixed_chunks(head, F.col("text"), CAP)).alias("ordinal", "t"))
    return c.select("doc_id", "ordinal", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("content_hash"))


HEADER, TABLE_CAP = ("order", "line", "part", "quantity", "price"), 320
ROW_SQL = "concat('| ', l_orderkey, ' | ', l_linenumber, ' | ', l_partkey, ' | ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' | ', CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR), ' |', chr(10))"
BLOCK_SQL = f"concat('| {' | '.join(HEADER)} |', chr(10), '|{' --- |' * len(HEADER)}', chr(10))"


@query(f"""WITH RECURSIVE src AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, {ROW_SQL} AS line, length({ROW_SQL}) AS size, {TABLE_CAP} - length({BLOCK_SQL}) AS cap FROM lineitem),
{greedy_sql("src", "l_suppkey")}
SELECT l_suppkey, chunk AS ordinal, count(*) AS n_rows, sha256(concat({BLOCK_SQL}, string_agg(line, '' ORDER BY i))) AS content_hash FROM pack GROUP BY l_suppkey, chunk""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as one pipe table, cut at row borders with the header repeated."""
    x = table(spark, sf_dir, "lineitem")
    cells = F.array(*(c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_extendedprice").cast("decimal(20,2)"))))
    rows = x.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", cells.alias("cells")))).alias("r"))
    made = chunking.table_chunks(F.array(*map(F.lit, HEADER)), F.transform("r", lambda r: r["cells"]), TABLE_CAP)
    c = rows.select("l_suppkey", F.posexplode(made).alias("ordinal", "t"))
    return c.select("l_suppkey", "ordinal", (F.regexp_count("t", F.lit("\n")) - 2).cast("long").alias("n_rows"), F.sha2("t", 256).alias("content_hash"))


SHEET, OPENING = 1500, 40  # characters of a page, and of what is known of its beginning


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, CAST((length(text) - 1) // {SHEET} AS INTEGER) AS last FROM documents WHERE text <> ''),
f AS (SELECT doc_id, -1 AS page, 0 AS upto, CAST(NULL AS BIGINT) AS begins FROM d UNION ALL
  SELECT doc_id, page, CASE WHEN found > 0 THEN upto + found ELSE upto END, CASE WHEN found > 0 THEN upto + found END FROM
  (SELECT f.doc_id, f.page + 1 AS page, f.upto, CASE WHEN length(substr(text, (f.page + 1) * {SHEET} + 1, {OPENING})) >= {chunking.ANCHOR} THEN instr(substr(text, f.upto + 1), substr(text, (f.page + 1) * {SHEET} + 1, {OPENING})) ELSE 0 END AS found FROM f JOIN d ON d.doc_id = f.doc_id AND f.page < d.last))
SELECT doc_id, page, CAST(begins AS INTEGER) AS begins FROM f WHERE page >= 0""")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page of a text begins, found again in order by its opening characters; a page that repeats an earlier opening is not found before it."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    anchors = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SHEET).cast("int")), lambda k: F.substring("text", k * SHEET + 1, F.lit(OPENING)))
    return d.select("doc_id", F.posexplode(chunking.page_starts(F.col("text"), anchors)).alias("page", "begins"))
