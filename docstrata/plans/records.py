"""Dates in sentences, exclusive times of spans, and amendments linked to what they amend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import table
from ..operators.dates import MONTHS, PATTERNS, dates_in
from ..operators.references import COMMON, resolved, title_tokens
from ..operators.timing import exclusive
from ..registry import query

MONTH_SQL = "coalesce(nullif(list_position([" + ", ".join(f"'{m[:3]}'" for m in MONTHS) + "], lower(left({0}, 3))), 0), TRY_CAST({0} AS INTEGER))"
WRITTEN = ("strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%-d')", "strftime(o_orderdate, '%B %Y')", "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%-m/%-d/%Y')")
SENTENCE_SQL = f"concat('Order ', o_orderkey, ' of ', {WRITTEN[0]}; due on the ', {WRITTEN[1]}, 'th day of ', {WRITTEN[2]}, ' (', {WRITTEN[3]}, ' or ', {WRITTEN[4]}, '), not 2021-02-30, 13/40/2020 or 1 ', {WRITTEN[2]}, ' 5, 1999.')".replace("; due", ", '; due")


def found_sql(k: int, groups: tuple[int, int, int]) -> str:
    p = PATTERNS[k].replace("'", "''")
    y, m, d = (f"regexp_extract(m, '{p}', {g})" for g in groups)
    return f"""SELECT o_orderkey, start, start + length(m) AS stop, TRY_CAST(concat({y}, '-', lpad(CAST({MONTH_SQL.format(m)} AS VARCHAR), 2, '0'), '-', lpad({d}, 2, '0')) AS DATE) AS iso FROM
  (SELECT o_orderkey, m, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM
    (SELECT o_orderkey, ms, b, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m FROM (SELECT o_orderkey, regexp_extract_all(s, '{p}') AS ms, string_split_regex(s, '{p}') AS b FROM sen)))"""


@query(f"""WITH RECURSIVE sen AS (SELECT o_orderkey, {SENTENCE_SQL} AS s FROM orders), f AS ({" UNION ALL ".join(found_sql(k, g) for k, g in enumerate(((3, 1, 2), (3, 2, 1), (1, 2, 3), (3, 1, 2))))}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY start, stop DESC) AS i FROM f WHERE iso IS NOT NULL),
k AS (SELECT o_orderkey, 1 AS i, stop AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.o_orderkey, CAST(o.i AS INTEGER), CASE WHEN o.start >= k.last THEN o.stop ELSE k.last END, o.start >= k.last FROM k JOIN o ON o.o_orderkey = k.o_orderkey AND o.i = k.i + 1)
SELECT o_orderkey, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(iso AS VARCHAR) AS iso FROM o JOIN k USING (o_orderkey, i) WHERE kept""")
def dates_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of sentences that write one in four ways, with their places; impossible days and matches inside others are none."""
    o = table(spark, sf_dir, "orders")
    as_ = lambda f: F.date_format("o_orderdate", f)
    parts = ["Order ", F.col("o_orderkey").cast("string"), " of ", as_("MMMM d, yyyy"), "; due on the ", as_("d"), "th day of ", as_("MMMM yyyy"), " (", as_("yyyy-MM-dd"), " or ", as_("M/d/yyyy"), "), not 2021-02-30, 13/40/2020 or 1 ", as_("MMMM yyyy"), " 5, 1999."]
    s = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return o.select("o_orderkey", F.explode(dates_in(s)).alias("d")).select("o_orderkey", "d.start", "d.stop", "d.iso")


DEPTHS = ("view", "click", "signup", "purchase", "error")  # from outermost to innermost
DEPTH_SQL = "list_position([" + ", ".join(f"'{d}'" for d in DEPTHS) + "], event_type)"


@query(f"""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS name, {DEPTH_SQL} AS depth, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value >= 0),
t AS (SELECT DISTINCT user_id, day, unnest([a, b]) AS t FROM s), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id, day ORDER BY t) AS u FROM t),
x AS (SELECT g.user_id, g.day, g.t, g.u, coalesce(max_by(s.name, s.depth), 'overhead') AS phase FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.day = g.day AND s.a <= g.t AND s.b >= g.u WHERE u IS NOT NULL GROUP BY ALL)
SELECT user_id, day, phase, CAST(sum(u - t) AS BIGINT) AS micros FROM x GROUP BY user_id, day, phase""")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each kind of event was the innermost one open, by user and day; an event is open for as many minutes as its value."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value >= 0")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    depth = F.array_position(F.array(*map(F.lit, DEPTHS)), F.col("event_type"))
    s = e.select("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("name"), depth.alias("depth"), start.alias("start"), (start + F.floor(F.col("value") * 60_000_000)).alias("stop"))
    return exclusive(s, ["user_id", "day"]).select("user_id", "day", F.col("name").alias("phase"), F.col("time").alias("micros"))


COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]"
TOKENS_OF = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda t: NOT list_contains({COMMON_SQL}, t)))"


@query(f"""WITH d AS (SELECT o_orderkey AS doc, {TOKENS_OF.format("concat(p_name, ' ', p_brand, ' Supply Agreement')")} AS have, CAST(o_orderdate AS DATE) AS day, [c_name, s_name] AS parties, c_name, s_name, p_name, p_brand
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1),
r AS (SELECT doc AS ref, {TOKENS_OF.format("CASE WHEN doc % 3 = 0 THEN 'the Agreement' WHEN doc % 3 = 1 THEN concat('The ', p_name, ' Supply Agreement') ELSE concat(p_name, ' ', p_brand, ' Contract') END")} AS want, CASE WHEN doc % 3 < 2 THEN day END AS day, CASE WHEN doc % 2 = 0 THEN [c_name] ELSE [s_name] END AS parties FROM d),
dd AS (SELECT doc, have, day, unnest(parties) AS party FROM d), rr AS (SELECT ref, want, day, unnest(parties) AS party FROM r),
c AS (SELECT DISTINCT ref, doc FROM rr JOIN dd ON rr.party = dd.party AND len(list_filter(want, lambda w: NOT list_contains(have, w))) = 0 AND ((rr.day IS NOT NULL AND rr.day = dd.day) OR (rr.day IS NULL AND len(want) > 0)))
SELECT ref, min(doc) AS doc FROM c GROUP BY ref HAVING count(*) = 1""")
def amendment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments that name what they amend by title, day or both, linked where one document alone fits. (Contracts are the orders' first lines, and each is amended once.)"""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").where("l_linenumber = 1").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.select(F.col("o_orderkey").alias("doc"), F.col("o_orderdate").cast("date").alias("day"), "c_name", "s_name", "p_name", "p_brand")
    docs = rows.select("doc", "day", title_tokens(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" Supply Agreement"))).alias("have"), F.array("c_name", "s_name").alias("parties"))
    kind = F.col("doc") % 3
    title = F.when(kind == 0, "the Agreement").when(kind == 1, F.concat(F.lit("The "), "p_name", F.lit(" Supply Agreement"))).otherwise(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" Contract")))
    refs = rows.select(F.col("doc").alias("ref"), F.when(kind < 2, F.col("day")).alias("day"), title_tokens(title).alias("want"), F.array(F.when(F.col("doc") % 2 == 0, F.col("c_name")).otherwise(F.col("s_name"))).alias("parties"))
    return resolved(refs, docs)
