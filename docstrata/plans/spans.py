"""Overlaps of pages, regions, rectangles and days with what covers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import table, windows, windows_sql
from ..operators.intervals import overlapping
from ..registry import query

PAGE = 300  # words


@query(f"""WITH {windows_sql()}, c AS (SELECT doc_id, ordinal, start // {PAGE} + 1 AS page_start, (start + len(words) - 1) // {PAGE} + 1 AS page_end FROM win),
p AS (SELECT doc_id, unnest(generate_series(1, (len(w) - 1) // {PAGE} + 1)) AS page FROM win_w WHERE len(w) > 0)
SELECT p.doc_id, page, count(*) AS chunks, min(ordinal) AS first_chunk, max(ordinal) AS last_chunk FROM p JOIN c ON c.doc_id = p.doc_id AND page BETWEEN page_start AND page_end GROUP BY ALL""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks whose pages cover each page of a document."""
    docs = table(spark, sf_dir, "documents")
    page = lambda word: F.floor(word / PAGE) + 1
    c = windows(docs).select("doc_id", "ordinal", page(F.col("start")).alias("page_start"), page(F.col("start") + F.size("words") - 1).alias("page_end"))
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    p = docs.select("doc_id", n.alias("n")).where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), page(F.col("n") - 1))).alias("page")).withColumn("to", F.col("page"))
    met = overlapping(p, c, [("page", "to", "page_start", "page_end")], ["doc_id"])
    return met.groupBy("doc_id", "page").agg(F.count("*").alias("chunks"), F.min("ordinal").alias("first_chunk"), F.max("ordinal").alias("last_chunk"))


CHUNK, STRIDE = 1000, 800  # characters


@query(f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS t FROM d),
r AS (SELECT doc_id, line, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(t) - 1 AS lo FROM l),
c AS (SELECT doc_id, unnest(generate_series(0, (length(text) - 1) // {STRIDE})) AS ordinal, length(text) AS n FROM d),
s AS (SELECT doc_id, ordinal, ordinal * {STRIDE} AS lo, least(ordinal * {STRIDE} + {CHUNK}, n) - 1 AS hi FROM c)
SELECT s.doc_id, ordinal, count(*) AS regions, min(line) AS first_line, max(line) AS last_line, CAST(sum(least(s.hi, r.lo + length(t) - 1) - greatest(s.lo, r.lo) + 1) AS BIGINT) AS chars
FROM s JOIN r ON r.doc_id = s.doc_id AND length(t) > 0 AND r.lo <= s.hi AND r.lo + length(t) - 1 >= s.lo GROUP BY ALL""")
def region_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty lines that each character window of a text holds wholly or in part, and how many of its characters are theirs."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    ends = F.sum(F.length("t") + 1).over(Window.partitionBy("doc_id").orderBy("line"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("r_lo", ends - F.length("t") - 1)
    regions = lines.where("t <> ''").select("doc_id", (F.col("line") + 1).alias("line"), "r_lo", (F.col("r_lo") + F.length("t") - 1).alias("r_hi"))
    n = F.length("text")
    cut = d.select("doc_id", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / STRIDE))).alias("ordinal"))
    cut = cut.select("doc_id", "ordinal", (F.col("ordinal") * STRIDE).alias("lo"), (F.least(F.col("ordinal") * STRIDE + CHUNK, F.col("n")) - 1).alias("hi"))
    met = overlapping(cut, regions, [("lo", "hi", "r_lo", "r_hi")], ["doc_id"])
    held = F.least("hi", "r_hi") - F.greatest("lo", "r_lo") + 1
    return met.groupBy("doc_id", "ordinal").agg(F.count("*").alias("regions"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum(held).alias("chars"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS top, max(l_orderkey) AS bottom, min(l_linenumber) AS left_col, max(l_linenumber) AS right_col FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, l_orderkey, min(l_linenumber) AS c1, max(l_linenumber) AS c2 FROM lineitem GROUP BY ALL)
SELECT r.l_suppkey AS sheet, l_partkey AS area, top, bottom, left_col, right_col, count(*) AS rows_met, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row
FROM r JOIN c ON c.l_suppkey = r.l_suppkey AND top <= l_orderkey AND l_orderkey <= bottom AND left_col <= c2 AND c1 <= right_col GROUP BY ALL""")
def rectangle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row chunks (an order's lines on a supplier's sheet) that meet each rectangle of the sheet (all cells of a part)."""
    x = table(spark, sf_dir, "lineitem")
    bounds = lambda c, lo, hi: (F.min(c).cast("long").alias(lo), F.max(c).cast("long").alias(hi))
    areas = x.groupBy("l_suppkey", "l_partkey").agg(*bounds("l_orderkey", "top", "bottom"), *bounds("l_linenumber", "left_col", "right_col"))
    rows = x.groupBy("l_suppkey", "l_orderkey").agg(*bounds("l_linenumber", "c1", "c2")).withColumn("row_end", F.col("l_orderkey"))
    met = overlapping(areas, rows, [("top", "bottom", "l_orderkey", "row_end"), ("left_col", "right_col", "c1", "c2")], ["l_suppkey"])
    keys = [F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("area"), "top", "bottom", F.col("left_col").cast("int").alias("left_col"), F.col("right_col").cast("int").alias("right_col")]
    return met.groupBy(*keys).agg(F.count("*").alias("rows_met"), F.min("l_orderkey").alias("first_row"), F.max("l_orderkey").alias("last_row"))


@query("""WITH u AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events WHERE user_id IS NOT NULL GROUP BY user_id), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT day, count(*) AS users, min(user_id) AS first_user FROM d JOIN u ON day BETWEEN a AND b GROUP BY day""")
def users_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first and last event enclose each day that has events; days and spans meet on no key but the grid."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_date(F.col("ts").cast("date")).cast("long").alias("n"))
    spans = e.where("user_id IS NOT NULL").groupBy("user_id").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    days = e.where("n IS NOT NULL").select("n").distinct().withColumn("to", F.col("n"))
    met = overlapping(days, spans, [("n", "to", "a", "b")])
    return met.groupBy("n").agg(F.count("*").alias("users"), F.min("user_id").alias("first_user")).select(F.date_from_unix_date(F.col("n").cast("int")).alias("day"), "users", "first_user")
