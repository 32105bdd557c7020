"""Questions, excerpts, exact roundings, folders and counts of what can be searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_SQL, STOPWORDS, TOKEN, TOKENS_SQL, stem, tokens
from ..model import KEYWORD_OK, VERSIONS, keyword_eligible, table, versions
from ..registry import query

# How a number with thousands separators looks, with its sign.
GROUPED = r"(?<![\p{L}\p{N}_.,])-?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\p{L}\p{N}_])(?![.,]\d)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def number_forms(text: Column) -> Column:
    """Numbers written with thousands separators, without them; lists such as 1,2,3 are none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(GROUPED), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def match_terms(text: Column) -> Column:
    """The words of a question and of its number forms, without stop words; all words if nothing else is left."""
    own = words(text)
    every = F.concat(own, F.array_except(words(F.array_join(number_forms(text), " ")), own))
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(every, lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


ASKED_SQL = "concat('What is the total of order ', o_orderkey, ' on ', strftime(o_orderdate, '%Y-%m-%d'), ': ', format('{:,.2f}', o_totalprice), ', or by line 1,2,3?')"
RUN_SQL = r"list_transform(list_filter(regexp_extract_all(q, '[\p{L}\p{N}_.,]+'), lambda r: regexp_full_match(r, '\d{1,3}(,\d{3})+(\.\d+)?([.,]([^\d].*)?)?')), lambda r: replace(regexp_extract(r, '^\d{1,3}(,\d{3})+(\.\d+)?'), ',', ''))"
WORD_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(rf"""WITH a AS (SELECT o_orderkey, {ASKED_SQL} AS q FROM orders), f AS (SELECT *, {RUN_SQL} AS forms, {WORD_SQL.format("q")} AS own FROM a),
e AS (SELECT o_orderkey, forms, list_concat(own, list_filter({WORD_SQL.format("array_to_string(forms, ' ')")}, lambda w: NOT list_contains(own, w))) AS ws FROM f)
SELECT o_orderkey, array_to_string(forms, ' ') AS forms, array_to_string(list_transform(list_filter(ws, lambda w: NOT list_contains({STOP_SQL}, w)), lambda w: concat('"', w, '"')), ' OR ') AS match FROM e""")
def number_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name amounts as people write them, as lexical match expressions that also find the stored form."""
    o = table(spark, sf_dir, "orders")
    asked = F.concat(F.lit("What is the total of order "), F.col("o_orderkey").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "), F.format_number("o_totalprice", 2), F.lit(", or by line 1,2,3?"))
    quoted = F.transform(match_terms(asked), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return o.select("o_orderkey", F.array_join(number_forms(asked), " ").alias("forms"), F.array_join(quoted, " OR ").alias("match"))


@query(rf"""WITH u AS (SELECT conv_id, turn, {WORD_SQL.format("text")} AS ws FROM conversations WHERE role = 'user'),
k AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({STOP_SQL}, w)) AS kept FROM u)
SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, lambda w: concat('"', w, '"')), ' OR ') AS match FROM k""")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a lexical match expression. (The SQL has no number forms; the given turns hold no grouped numbers.)"""
    u = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return u.select("conv_id", "turn", F.array_join(F.transform(match_terms(F.col("text")), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ").alias("match"))


CUT, FOLDED = 600, 400


@query(rf"""WITH h AS (SELECT doc_id, text, left(text, {CUT}) AS head FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, length(head) - length(regexp_extract(head, '[^ \n]*\z')) AS upto FROM h)
SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), {FOLDED}) AS excerpt, length(text) > {CUT} AS cut,
  CASE WHEN length(text) <= {CUT} THEN text ELSE regexp_replace(CASE WHEN upto - 1 > {CUT * 4 // 5} THEN left(head, upto - 1) ELSE head END, '[ \t\n\r\f]+\z', '') END AS body FROM b""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folded excerpt to compare by, and the text cut to a limit: at white space if some stands in the last fifth, else hard."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    head, long = F.substring("text", 1, CUT), F.length("text") > CUT
    upto = F.length(head) - F.length(F.regexp_extract(head, r"[^ \n]*\z", 0))
    body = F.regexp_replace(F.when(upto - 1 > CUT * 4 // 5, F.left(head, upto - 1)).otherwise(head), r"[ \t\n\r\f]+\z", "")
    folded = F.substring(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), 1, FOLDED)
    return d.select("doc_id", folded.alias("excerpt"), long.alias("cut"), F.when(long, body).otherwise(F.col("text")).alias("body"))


TABLE_LINE, LIST_LINE = r"(?m)^[ \t]*\|.*\|[ \t]*$", r"(?m)^[ \t]*(?:[-*•]|\d{1,3}[.)])[ \t]"


@query(rf"""SELECT doc_id, round(1.0::DOUBLE + CASE WHEN len(regexp_extract_all(text, '{TABLE_LINE}')) >= 2 THEN 4 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '{LIST_LINE}')) >= 2 THEN 2 ELSE 0 END
  + least(len(regexp_extract_all(text, '\p{{Nd}}'))::DOUBLE / greatest(length(text), 1) * 20, 3), 6) AS weight FROM documents WHERE text IS NOT NULL""")
def chunk_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights: tables, lists and texts dense in digits weigh more."""
    two = lambda pattern, w: F.when(F.regexp_count("text", F.lit(pattern)) >= 2, w).otherwise(0.0)
    digits = F.regexp_count("text", F.lit(r"\p{Nd}")).cast("double") / F.greatest(F.length("text"), F.lit(1)) * 20
    w = F.lit(1.0) + two(TABLE_LINE, 4.0) + two(LIST_LINE, 2.0) + F.least(digits, F.lit(3.0))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.round(w, 6).alias("weight"))


@query(r"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(6,2))) AS DECIMAL(20,4)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN CAST(round(v, 0) AS VARCHAR) WHEN 1 THEN CAST(round(v, 1) AS VARCHAR) WHEN 2 THEN CAST(round(v, 2) AS VARCHAR) WHEN 3 THEN CAST(round(v, 3) AS VARCHAR)
ELSE regexp_replace(CAST(v AS VARCHAR), '\.?0+$', '') END AS shown FROM v""")
def quantised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact products rounded half up to the places asked for, as text; without places, trailing zeros go."""
    v = (F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(6,2)"))).cast("decimal(20,4)")
    places = F.col("l_linenumber") % 5
    shown = F.regexp_replace(v.cast("string"), r"\.?0+$", "")
    for k in range(4):
        shown = F.when(places == k, F.round(v, k).cast("string")).otherwise(shown)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query(r"""WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages),
f AS (SELECT array_to_string(parts[1:k], '/') AS folder FROM (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS k FROM p))
SELECT folder, count(*) AS pages FROM f GROUP BY folder""")
def folder_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inside every folder, at any depth. Containment is by whole path components, and a page's own name is no folder."""
    parts = F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/")
    p = table(spark, sf_dir, "pages").select(parts.alias("parts")).where(F.size("parts") > 1)
    f = p.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k")).select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"))
    return f.groupBy("folder").agg(F.count("*").alias("pages"))


@query(f"""WITH {VERSIONS} SELECT sha256(text) AS content, count(DISTINCT source_id) AS sources, count(*) AS files, min(doc_id) AS first_doc FROM ver WHERE {KEYWORD_OK} AND text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_id) > 1""")
def source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that several servable sources hold. Sources are counted before contents, so a copied text's rows meet as one row a source."""
    v = keyword_eligible(versions(spark, sf_dir)).where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("content"), "source_id", "doc_id")
    one = v.groupBy("content", "source_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"))
    return one.groupBy("content").agg(F.count("source_id").alias("sources"), F.sum("n").alias("files"), F.min("d").alias("first_doc")).where("sources > 1")


SIZE, STEP = 200, 160


@query(rf"""WITH {VERSIONS}, n AS (SELECT source_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM ver WHERE {KEYWORD_OK}),
c AS (SELECT source_id, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE greatest(n - {SIZE - STEP} - 1, 0) // {STEP} + 1 END AS c FROM n)
SELECT source_id, count(*) AS files, count(*) FILTER (c > 0) AS searchable, CAST(sum(c) AS BIGINT) AS chunks FROM c GROUP BY ROLLUP (source_id)""")
def searchable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, files with chunks and chunks of every servable source and of all; chunks are counted from the number of words, not made."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0))
    c = F.when(n == 0, 0).otherwise(F.floor(F.greatest(n - (SIZE - STEP) - 1, F.lit(0)) / STEP) + 1)
    v = keyword_eligible(versions(spark, sf_dir)).select("source_id", c.cast("long").alias("c"))
    return v.rollup("source_id").agg(F.count("*").alias("files"), F.count_if(F.col("c") > 0).alias("searchable"), F.sum("c").alias("chunks"))


ROOM = 300


@query(f"""WITH l AS (SELECT doc_id, list_prepend([0, 0]::BIGINT[], list_transform(string_split(text, chr(10)), lambda x: [length(x), 0]::BIGINT[])) AS ls FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(ls, lambda a, x: CASE WHEN a[1] + x[1] + CASE WHEN a[2] > 0 THEN 2 ELSE 0 END > {ROOM} THEN a ELSE [a[1] + x[1] + CASE WHEN a[2] > 0 THEN 2 ELSE 0 END, a[2] + 1]::BIGINT[] END) AS s FROM l)
SELECT doc_id, s[1] AS used, s[2] AS kept FROM r""")
def context_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit into a budget of characters with their separators: one that overflows is left out, later shorter ones still go in."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))

    def add(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + F.when(acc["kept"] > 0, 2).otherwise(0)
        return F.when(used > ROOM, acc).otherwise(F.struct(used.cast("long").alias("used"), (acc["kept"] + 1).alias("kept")))

    s = F.aggregate(F.split("text", "\n"), start, add)
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", s.alias("s")).select("doc_id", "s.used", "s.kept")


@query(f"""WITH t AS (SELECT unnest(list_distinct(list_transform({TOKENS_SQL.format("text")}, lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END))) AS stem FROM documents)
SELECT stem, count(*) AS documents FROM t GROUP BY stem""")
def stem_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents a term occurs, with a plural s taken off words of more than three letters."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.transform(tokens(F.col("text")), stem))).alias("stem"))
    return d.groupBy("stem").agg(F.count("*").alias("documents"))
