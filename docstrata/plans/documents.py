"""Sections, document cues, citations and graph-shaped joins over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import VECTOR_OK, VERSIONS, table, vector_eligible, versions
from ..operators.documents import DURATION, FISCAL, ISO, NUMBERS, SPELT, TYPES, citation_ids, doc_type, duration, fiscal_year, iso_dates
from ..operators.sections import sections
from ..registry import query


@query(r"""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,3} +.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section, min(pos) AS first_line, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_sha256 FROM s GROUP BY doc_id, section""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(table(spark, sf_dir, "documents")).select("doc_id", "section", "first_line", F.sha2("text", 256).alias("text_sha256"))


HIDDEN = r"(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
HEAD = 1800  # characters of a page that its type is read from: the title, then what is visible
CASES = " ".join(f"WHEN regexp_matches(head, '{cue}') THEN '{name}'" for name, cue in TYPES)


@query(rf"""WITH t AS (SELECT page_id, left(trim(regexp_replace(concat(regexp_extract(html, '{TITLE}', 1), ' ', regexp_replace(html, '{HIDDEN}', ' ', 'g')), '[ \t\n\r\f]+', ' ', 'g')), {HEAD}) AS head FROM pages)
SELECT page_id, CASE {CASES} ELSE 'other' END AS doc_type FROM t""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document type from the title and the first visible characters of each page, by ordered cues."""
    seen = F.concat(F.regexp_extract("html", TITLE, 1), F.lit(" "), F.regexp_replace("html", HIDDEN, " "))
    head = F.left(F.trim(F.regexp_replace(seen, r"[ \t\n\r\f]+", " ")), F.lit(HEAD))
    return table(spark, sf_dir, "pages").select("page_id", doc_type(head).alias("doc_type"))


WORDS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in NUMBERS.items()) + "}"


@query(f"""WITH m AS (SELECT doc_id, regexp_extract(text, '{DURATION}', ['a', 'b', 'c', 'u']) AS d, regexp_extract(text, '{FISCAL}', ['a', 'b']) AS f,
list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(text, '{ISO}', 1), lambda x: try_cast(x AS DATE)),
  list_transform(regexp_extract_all(text, '{SPELT}', 1), lambda x: CAST(try_strptime(x, '%d %B %Y') AS DATE))), lambda x: x IS NOT NULL)) AS dates FROM documents),
n AS (SELECT *, coalesce(nullif(d.a, ''), nullif(d.b, ''), {WORDS_SQL}[replace(lower(d.c), ' ', '-')]) AS n FROM m)
SELECT doc_id, n || ' ' || lower(d.u) || CASE WHEN n = '1' THEN '' ELSE 's' END AS duration,
CASE WHEN f.a <> '' THEN 'FY' || CASE WHEN length(f.a) = 2 THEN '20' ELSE '' END || f.a || CASE WHEN f.b <> '' THEN '-' || f.b ELSE '' END END AS fiscal_year,
CAST(len(dates) AS INTEGER) AS n_dates, list_min(dates) AS first_date FROM n""")
def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First duration and fiscal-year label of each text, and its valid dates; one pass over each row, no shuffle."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", duration(t).alias("duration"), fiscal_year(t).alias("fiscal_year"), iso_dates(t).alias("dates"))
    return d.select("doc_id", "duration", "fiscal_year", F.size("dates").alias("n_dates"), F.array_min("dates").alias("first_date"))


@query(f"""WITH {VERSIONS}, lab AS (SELECT doc_id, source_id, substr(sha256(text), 1, 12) AS id FROM ver), pair AS (SELECT a.doc_id, a.id AS id1, b.id AS id2 FROM lab a LEFT JOIN lab b ON b.doc_id = a.doc_id + 1),
ok AS (SELECT DISTINCT substr(sha256(text), 1, 12) AS id FROM ver WHERE {VECTOR_OK}), c AS (SELECT doc_id, unnest(list_distinct(list_filter([id1, id2], lambda x: x IS NOT NULL))) AS id FROM pair)
SELECT c.doc_id, count(*) AS cited, count(ok.id) AS valid, count(*) - count(ok.id) AS unknown FROM c LEFT JOIN ok ON ok.id = c.id GROUP BY c.doc_id""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a version and the next one, checked against what may be served."""
    v = versions(spark, sf_dir)
    label = v.select("doc_id", F.format_string("[%s #%s]", F.col("source_id"), F.left(F.sha2("text", 256), F.lit(12))).alias("label"))
    after = label.select((F.col("doc_id") - 1).alias("doc_id"), F.col("label").alias("other"))
    answers = label.join(after, "doc_id", "left").select("doc_id", F.concat_ws(" and ", "label", "other").alias("answer"))
    cited = answers.select("doc_id", F.explode(citation_ids(F.col("answer"))).alias("id"))
    known = vector_eligible(v).select(F.left(F.sha2("text", 256), F.lit(12)).alias("id")).distinct().withColumn("ok", F.lit(1))
    g = cited.join(known, "id", "left").groupBy("doc_id").agg(F.count("*").alias("cited"), F.count("ok").alias("valid"))
    return g.select("doc_id", "cited", "valid", (F.col("cited") - F.col("valid")).alias("unknown"))


@query("""SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3""")
def holds_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: orders with a line of every flag. Flags become bits, so nothing distinct is dealt out."""
    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 4).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(bit).alias("b")).where("b = 7").select("l_orderkey")


@query("""WITH e AS (SELECT n.n_name AS entity, 'customer' AS role, count(c.c_custkey) AS mentions FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
UNION ALL SELECT n.n_name, 'supplier', count(s.s_suppkey) FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name)
SELECT entity, r.r_name AS parent, role, mentions, (mentions = 0) AS orphan FROM e JOIN nation n ON n.n_name = e.entity JOIN region r ON r.r_regionkey = n.n_regionkey""")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their parent, role and number of edges; entities without an edge are orphans. Edges are counted before they meet the small node tables."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = None
    for role, key in (("customer", "c_nationkey"), ("supplier", "s_nationkey")):
        m = table(spark, sf_dir, role).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias("m"))
        e = n.join(m, "n_nationkey", "left").select("n_name", "n_regionkey", F.lit(role).alias("role"), F.coalesce("m", F.lit(0)).alias("mentions"))
        out = e if out is None else out.union(e)
    return out.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("parent"), "role", "mentions", (F.col("mentions") == 0).alias("orphan"))
