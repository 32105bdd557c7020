"""Names of customers, suppliers and parts in questions, and holders merged by the names they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_SQL, SUFFIXES
from ..model import table
from ..operators.names import WORDS, entities, keys_of, named
from ..registry import query
from .text import CORE, NAME_SQL

SUFFIX_SQL = "[" + ", ".join(f"'{w}'" for w in SUFFIXES) + "]"
USABLE = f"length({{0}}) >= 3 AND len(list_filter(string_split({{0}}, ' '), lambda w: NOT list_contains({STOP_SQL}, w) AND NOT list_contains({SUFFIX_SQL}, w))) > 0 AND (contains({{0}}, ' ') OR length({{0}}) >= 4)"


def keys_sql(name: str) -> str:
    normal = NAME_SQL.format(name)
    return f"list_filter(list_distinct([{normal}, regexp_replace({normal}, '({CORE})+$', '')]), lambda k: {USABLE.format('k')})"


VARIANTS = f"""names AS (SELECT c_name AS name, concat('customer ', c_custkey) AS entity FROM customer UNION ALL SELECT s_name, concat('supplier ', s_suppkey) FROM supplier UNION ALL SELECT DISTINCT p_name, concat('part ', p_name) FROM part),
variants AS (SELECT DISTINCT unnest({keys_sql("name")}) AS key, entity FROM names)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t, n, k: table(spark, sf_dir, t).select(F.col(n).alias("name"), F.concat(F.lit(f"{t} "), F.col(k).cast("string")).alias("entity"))
    every = name("customer", "c_name", "c_custkey").union(name("supplier", "s_name", "s_suppkey")).union(name("part", "p_name", "p_name").distinct())
    return every.select(F.explode(keys_of(F.col("name"))).alias("key"), "entity").distinct()


QUESTION_SQL = "concat('Did ', c_name, ' get the ', upper(left(p_name, 1)), substr(p_name, 2), ' or a ', split_part(p_name, ' ', 1), ' one from ', s_name, ' & Co. of ', o_orderpriority, '?')"


@query(rf"""WITH {VARIANTS}, q AS (SELECT o_orderkey AS id, {QUESTION_SQL} AS text FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1 JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT DISTINCT id, regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’&.\-]*') AS raw FROM q),
f AS (SELECT id, flatten(list_transform(raw, lambda r: list_transform(list_filter(string_split({NAME_SQL.format("r")}, ' '), lambda w: w <> ''), lambda w: {{'w': w, 'up': regexp_matches(r, '^\p{{Lu}}')}}))) AS ws FROM r),
i AS (SELECT id, ws, unnest(generate_series(0, len(ws) - 1)) AS start FROM f), k AS (SELECT id, ws, start, unnest(generate_series(start + 1, least(start + {WORDS}, len(ws)))) AS stop FROM i),
w AS (SELECT id, start, stop, array_to_string(list_transform(ws[start + 1:stop], lambda x: x.w), ' ') AS key, ws[start + 1].up AS capital FROM k),
h AS (SELECT * FROM w SEMI JOIN variants USING (key) WHERE {USABLE.format("key")} AND (stop - start > 1 OR capital))
SELECT h.id AS o_orderkey, entity, h.key, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM h JOIN variants USING (key)
WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.id = h.id AND o.start <= h.start AND o.stop >= h.stop AND o.stop - o.start > h.stop - h.start)""")
def names_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers, suppliers and parts the questions about orders name, the longest names only."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").where("l_linenumber = 1").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    item = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000))
    text = F.concat(F.lit("Did "), "c_name", F.lit(" get the "), item, F.lit(" or a "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" one from "), "s_name", F.lit(" & Co. of "), "o_orderpriority", F.lit("?"))
    asked = rows.select(F.col("o_orderkey").alias("id"), text.alias("text")).distinct()
    found = named(asked, variants(spark, sf_dir))
    return found.select(F.col("id").alias("o_orderkey"), "entity", "key", "start", "stop")


HOLDERS = """holders AS (SELECT c_name AS holder, c_name AS name FROM customer UNION ALL SELECT c_name, concat('The ', c_mktsegment, ' Account ', CAST(floor(c_acctbal) AS BIGINT), ', Inc.') FROM customer
  UNION ALL SELECT s_name, concat(s_name, ' Ltd') FROM supplier UNION ALL SELECT s_name, concat('FURNITURE & account ', CAST(floor(s_acctbal) AS BIGINT)) FROM supplier UNION ALL SELECT s_name, concat('Machinery account ', CAST(floor(s_acctbal) AS BIGINT), ' Limited') FROM supplier)"""


@query(f"""WITH RECURSIVE {HOLDERS}, each AS (SELECT DISTINCT holder, unnest({keys_sql("name")}) AS key FROM holders),
e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM each a JOIN each b USING (holder)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS key, concat('ent_', left(sha256(min(b)), 24)) AS entity FROM r GROUP BY a""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers under the names of their accounts: one entity for all that share a name, through any number of steps."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    balance = lambda b: F.floor(b).cast("long").cast("string")
    named_by = lambda df, holder, *name: df.select(F.col(holder).alias("holder"), F.concat(*name).alias("name"))
    every = named_by(c, "c_name", F.col("c_name"))
    every = every.union(named_by(c, "c_name", F.lit("The "), F.col("c_mktsegment"), F.lit(" Account "), balance("c_acctbal"), F.lit(", Inc.")))
    every = every.union(named_by(s, "s_name", F.col("s_name"), F.lit(" Ltd")))
    every = every.union(named_by(s, "s_name", F.lit("FURNITURE & account "), balance("s_acctbal"))).union(named_by(s, "s_name", F.lit("Machinery account "), balance("s_acctbal"), F.lit(" Limited")))
    return entities(every)
