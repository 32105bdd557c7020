"""Exact-decimal arithmetic over order lines read as spreadsheet cells, with unit refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import table
from ..operators import workbook
from ..registry import query

MONEY = "decimal(20,6)"


def money(c: str) -> Column:
    return F.col(c).cast("decimal(20,2)").cast(MONEY)


M = "CAST(CAST({0} AS DECIMAL(20,2)) AS DECIMAL(20,6))"


@query(f"""SELECT l_returnflag AS sheet, l_linenumber AS row_no, CAST(sum({M.format("l_extendedprice")}) AS DOUBLE) AS total, round(CAST(sum({M.format("l_extendedprice")}) AS DOUBLE) / count(l_extendedprice), 4) AS mean,
CAST(min({M.format("l_extendedprice")}) AS DOUBLE) AS low, CAST(max({M.format("l_extendedprice")}) AS DOUBLE) AS high, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL""")
def cells_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum, average, min, max and count of numeric cells; blanks are skipped, never zero."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.col("l_linenumber").alias("row_no"), money("l_extendedprice").alias("v"))
    g = x.groupBy("sheet", "row_no").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    d = lambda c: F.col(c).cast("double")
    return g.select("sheet", "row_no", d("s").alias("total"), F.round(d("s") / F.col("n"), 4).alias("mean"), d("lo").alias("low"), d("hi").alias("high"), "n")


@query(f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum({M.format("o_totalprice")}) AS v FROM orders GROUP BY 1),
p AS (SELECT month, v, lag(v) OVER (ORDER BY month) AS b FROM m)
SELECT strftime(month, '%Y-%m') AS month, CAST(v - b AS DOUBLE) AS difference, round(CAST(v AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0), 6) AS ratio, round((CAST(v AS DOUBLE) - CAST(b AS DOUBLE)) / nullif(CAST(b AS DOUBLE), 0) * 100, 6) AS pct_change FROM p""")
def period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, ratio and percentage change against the month before; a zero base gives none. Months are few after aggregation, so one window task orders them."""
    m = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("month"), money("o_totalprice").alias("v")).groupBy("month").agg(F.sum("v").alias("v"))
    p = m.withColumn("b", F.lag("v").over(Window.orderBy("month")))
    v, b = F.col("v").cast("double"), F.nullif(F.col("b").cast("double"), F.lit(0.0))
    return p.select(F.date_format("month", "yyyy-MM").alias("month"), (F.col("v") - F.col("b")).cast("double").alias("difference"), F.round(v / b, 6).alias("ratio"), F.round((v - b) / b * 100, 6).alias("pct_change"))


@query(f"""WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS units, min(l_returnflag) AS unit, sum({M.format("l_quantity")}) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN units > 1 THEN 'mixed units' END AS refusal, CASE WHEN units = 1 THEN unit END AS unit, CASE WHEN units = 1 THEN CAST(v AS DOUBLE) END AS total FROM g""")
def unit_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders whose lines share one unit (here the return flag); mixed units are refused."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"), F.sum(money("l_quantity")).alias("v"))
    one = F.col("lo") == F.col("hi")
    return g.select("l_orderkey", F.when(~one, "mixed units").alias("refusal"), F.when(one, F.col("lo")).alias("unit"), F.when(one, F.col("v").cast("double")).alias("total"))


@query("""SELECT o_orderkey AS sheet, count(l.l_orderkey) AS cells, count(*) FILTER (l.l_discount = 0) AS zeros, count(l.l_discount) AS numeric_cells, coalesce(max(l.l_linenumber), 0) AS used_rows, (count(l.l_orderkey) > 6) AS clipped
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o_orderkey""")
def range_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a range read covers of each sheet: used rows, numeric cells, zeros apart from blanks, and whether a cap would clip it."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"), F.count_if(F.col("l_discount") == 0).alias("z"), F.count("l_discount").alias("d"), F.max("l_linenumber").alias("m"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return o.select(F.col("o_orderkey").alias("sheet"), zero("c").alias("cells"), zero("z").alias("zeros"), zero("d").alias("numeric_cells"), zero("m").alias("used_rows"), (zero("c") > 6).alias("clipped"))


@query("""SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, date_diff('day', min(l_shipdate), max(l_shipdate)) AS span_days, CASE WHEN date_diff('day', min(l_shipdate), max(l_shipdate)) <= 14 THEN 'recent' ELSE 'older' END AS recency FROM lineitem GROUP BY l_orderkey""")
def recency_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    days = F.date_diff(F.col("last_ship").cast("date"), F.col("first_ship").cast("date"))
    return g.select("l_orderkey", "first_ship", "last_ship", days.alias("span_days"), F.when(days <= 14, "recent").otherwise("older").alias("recency"))


# Plans over each supplier's lines as a sheet: quantities in column B, prices in C, from row 2 on. (step, operation, places, areas)
PLANS = (
    ((1, "sum", 2, ("C2:C41",)), (2, "average", 2, ("$C$41:$C$2",))),
    ((1, "pct_change", 2, ("C2", "C3")), (2, "ratio", 4, ("C2", "B2")), (3, "count", 2, ("B2:B10",))),
    ((1, "sum", None, ("B2:C6",)), (2, "max", 0, ("C2:C41",))),
)
PRICE_HEADERS = ("Price (USD thousands)", "Price", "Price (USD or EUR)")
CONTEXT = ("All amounts in euros", "Unaudited")


def _decimal_sql(x: str, places: int) -> str:
    ten = 10**places
    return f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, abs({x}) // {ten}" + (f", '.', lpad(CAST(abs({x}) % {ten} AS VARCHAR), {places}, '0'))" if places else ")")


def _half_up_sql(num: str, den: str) -> str:
    return f"(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))))"


@query(f"""WITH i AS (SELECT l_suppkey AS s, CAST(CAST(l_quantity AS DECIMAL(20,2)) * 100 AS HUGEINT) AS q, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS HUGEINT) AS p,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i FROM lineitem),
l AS (SELECT s, list(q ORDER BY i) AS q, list(p ORDER BY i) AS p, CASE s % 2 WHEN 0 THEN 'EUR' ELSE 'not stated' END AS uq FROM i GROUP BY s),
u AS (SELECT *, CASE s % 3 WHEN 0 THEN 'USD thousands' WHEN 1 THEN uq ELSE 'ambiguous' END AS up, list_sum(p[1:40]) AS total, len(p[1:40]) AS n, p[1] AS a, p[2] AS b, q[1] AS d FROM l),
x AS (SELECT s * 3 AS plan, 1 AS step, 'sum' AS op, {_decimal_sql("total", 2)} AS result, up AS units, n AS inputs, CASE WHEN up = 'ambiguous' THEN 'ambiguous units' END AS refusal FROM u
  UNION ALL SELECT s * 3, 2, 'average', {_decimal_sql(_half_up_sql("total", "n"), 2)}, up, n, CASE WHEN up = 'ambiguous' THEN 'ambiguous units' END FROM u
  UNION ALL SELECT s * 3 + 1, 1, 'pct_change', {_decimal_sql(_half_up_sql("((b - a) * 10000)", "a"), 2)}, 'percent', 2, CASE WHEN up = 'ambiguous' THEN 'ambiguous units' END FROM u
  UNION ALL SELECT s * 3 + 1, 2, 'ratio', {_decimal_sql(_half_up_sql("(a * 10000)", "d"), 4)}, 'unitless', 2, CASE WHEN up = 'ambiguous' THEN 'ambiguous units' WHEN s % 3 = 0 AND s % 2 = 0 THEN 'mixed units' END FROM u
  UNION ALL SELECT s * 3 + 1, 3, 'count', CAST(len(q[1:9]) AS VARCHAR), 'count', len(q[1:9]), NULL FROM u
  UNION ALL SELECT s * 3 + 2, 1, 'sum', regexp_replace({_decimal_sql("(list_sum(q[1:5]) + list_sum(p[1:5]))", 2)}, '\\.?0+$', ''), uq, len(q[1:5]) + len(p[1:5]), CASE WHEN up = 'ambiguous' THEN 'ambiguous units' WHEN up <> uq THEN 'mixed units' END FROM u
  UNION ALL SELECT s * 3 + 2, 2, 'max', {_decimal_sql(_half_up_sql("list_max(p[1:40])", "100"), 0)}, up, n, CASE WHEN up = 'ambiguous' THEN 'ambiguous units' END FROM u),
g AS (SELECT plan, count(refusal) = 0 AS ok FROM x GROUP BY plan)
SELECT plan, step, op, CASE WHEN ok THEN result END AS result, CASE WHEN refusal IS NULL THEN units END AS units, CAST(inputs AS INTEGER) AS inputs, refusal, ok FROM x JOIN g USING (plan)""")
def calculation_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plans over each supplier's sheet, with units from headers and context; a plan with a refused step has no results."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    row = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) + 1
    header, context = F.col("l_suppkey") % 3, F.col("l_suppkey") % 2
    title = F.when(header == 0, PRICE_HEADERS[0]).when(header == 1, PRICE_HEADERS[1]).otherwise(PRICE_HEADERS[2])
    sheet = workbook.context_unit(F.array(F.when(context == 0, CONTEXT[0]).otherwise(CONTEXT[1])))
    number = lambda c: F.col(c).cast("decimal(20,2)").cast("decimal(20,6)").alias("number")
    books = x.select(F.col("l_suppkey").alias("book")).distinct()
    unit = lambda h: workbook.cell_unit(h, F.lit(False), sheet)
    units = x.select("l_suppkey").distinct().select("l_suppkey", unit(F.lit("Quantity")).alias("u2"), unit(title).alias("u3"))  # of a sheet's columns, not of each cell
    cell = lambda col, c: F.struct(F.lit(col).alias("col"), number(c), F.col(f"u{col}").alias("unit"))
    none = lambda kind: F.lit(None).cast(kind)
    each = x.withColumn("row", row).join(units, "l_suppkey").select(F.col("l_suppkey").alias("book"), F.lit("lines").alias("sheet"), "row", F.explode(F.array(cell(2, "l_quantity"), cell(3, "l_extendedprice"))).alias("c"))
    cells = each.select("book", "sheet", "row", "c.col", "c.number", none("string").alias("text"), none("string").alias("error"), F.lit(False).alias("missing"), "c.unit")
    step = lambda v, s: F.struct(F.lit(v).alias("v"), F.lit(s[0]).alias("step"), F.lit(s[1]).alias("op"), F.lit(s[2]).cast("int").alias("round_to"), F.array(*map(F.lit, s[3])).alias("areas"))
    steps = books.select("book", F.explode(F.array(*(step(v, s) for v, plan in enumerate(PLANS) for s in plan))).alias("s")).select("book", (F.col("book") * 3 + F.col("s.v")).alias("plan"), "s.step", "s.op", "s.round_to", "s.areas")
    refs = steps.select("plan", "step", "book", F.lit("lines").alias("sheet"), F.posexplode("areas").alias("ref", "area"))
    return workbook.calculated(steps.select("plan", "step", "op", "round_to"), refs, cells)
