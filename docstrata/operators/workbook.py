"""Calculation plans over workbook cells: areas, units from text, eight operations in exact decimals, refusals as values, all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_number
from .chunking import let

# Words for currencies and scales, the grid's limits, operations, and the budget of a step.
CURRENCIES = {"INR": "inr rs rupee rupees ₹", "USD": "usd dollar dollars $", "EUR": "eur euro euros €", "GBP": "gbp pound pounds £"}
SCALES = {"thousands": "thousand thousands", "millions": "million millions", "billions": "billion billions", "lakhs": "lakh lakhs", "crores": "crore crores"}
MAX_ROW, MAX_COLUMN = 1_048_576, 16_384
OPERATIONS = ("sum", "average", "min", "max", "count", "difference", "ratio", "pct_change")
TWO = ("difference", "ratio", "pct_change")
MAX_INPUTS, PLACES = 200, 10
AREA = r"^\s*\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?\s*$"
NOT_STATED, AMBIGUOUS, PERCENT = "not stated", "ambiguous: ", "percent"


# --- units ----------------------------------------------------------------------


def stated(text: Column) -> Column:
    """(currencies, scales) that a text states, each sorted and once."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+|[₹$€£]"), F.lit(0))

    def among(table: dict[str, str]) -> Column:
        known = F.create_map(*(F.lit(x) for name, ws in table.items() for w in ws.split() for x in (w, name)))
        return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda x: x.isNotNull())))

    return F.struct(among(CURRENCIES).alias("currencies"), among(SCALES).alias("scales"))


def unit_text(currencies: Column, scales: Column) -> Column:
    """The unit in words; more than one currency or scale is ambiguous, none is not stated."""
    both = F.concat(currencies, scales)
    many = (F.size(currencies) > 1) | (F.size(scales) > 1)
    return F.when(many, F.concat(F.lit(AMBIGUOUS), F.array_join(both, ", "))).when(F.size(both) == 0, NOT_STATED).otherwise(F.array_join(both, " "))


def context_unit(lines: Column) -> Column:
    """The unit that a sheet's context lines (an array) state together."""
    return let(stated(F.array_join(lines, " ")), lambda s: unit_text(s["currencies"], s["scales"]))


def cell_unit(header: Column, percent: Column, sheet: Column) -> Column:
    """A cell's unit: percent by format or header; else what stands in parentheses in the header, filled up from the sheet's; else the sheet's."""
    inner = stated(F.array_join(F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1)), " "))
    alone = sheet.startswith(AMBIGUOUS) | (sheet == NOT_STATED)

    def of(x: Column) -> Column:
        or_sheet = lambda part: F.when(alone | (F.size(x["own"][part]) > 0), x["own"][part]).otherwise(x["around"][part])
        says = (F.size(x["own"]["currencies"]) > 0) | (F.size(x["own"]["scales"]) > 0)
        return F.when(says, let(F.struct(or_sheet("currencies").alias("c"), or_sheet("scales").alias("s")), lambda u: unit_text(u["c"], u["s"]))).otherwise(sheet)

    percent = percent | F.coalesce(F.contains(header, F.lit("%")), F.lit(False))
    return F.when(percent, PERCENT).otherwise(let(F.struct(inner.alias("own"), stated(sheet).alias("around")), of))


def display_scale(number_format: Column) -> Column:
    """The scale that commas after the last digit of a number format hide: one for thousands, two for millions, three for billions; else null."""
    commas = F.length(F.regexp_extract(F.split(number_format, ";")[0], r"[0#?](,+)(?![0#?,])", 1))
    return F.when(commas == 1, "thousands").when(commas == 2, "millions").when(commas == 3, "billions")


# --- areas ----------------------------------------------------------------------


def area(text: Column) -> Column:
    """(top, left, bottom, right) of a cell or rectangle in A1 notation, either way round; null for anything else, and outside the grid."""
    part = lambda k: F.nullif(F.regexp_extract(text, AREA, k), F.lit(""))
    corners = F.struct(column_number(F.upper(part(1))).alias("c1"), part(2).cast("long").alias("r1"), column_number(F.upper(part(3))).alias("c2"), part(4).cast("long").alias("r2"))

    def box(x: Column) -> Column:
        c2, r2 = F.coalesce(x["c2"], x["c1"]), F.coalesce(x["r2"], x["r1"])
        return F.struct(F.least(x["r1"], r2).alias("top"), F.least(x["c1"], c2).cast("long").alias("left"), F.greatest(x["r1"], r2).alias("bottom"), F.greatest(x["c1"], c2).cast("long").alias("right"))

    return let(let(corners, box), lambda b: F.when((b["top"] >= 1) & (b["bottom"] <= MAX_ROW) & (b["right"] <= MAX_COLUMN), b))


# --- plans ----------------------------------------------------------------------


def rounded(value: Column, places: Column) -> Column:
    """Half up to the places asked for, as text; without places ten, and no zeros at the end."""
    out = F.regexp_replace(F.round(value, PLACES).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    for k in range(PLACES + 1):
        out = F.when(places == k, F.round(value, k).cast(f"decimal(38,{k})").cast("string")).otherwise(out)
    return out


def calculated(steps: DataFrame, refs: DataFrame, cells: DataFrame) -> DataFrame:
    """plan, step, op, result, units, inputs, refusal, ok for every step: of a plan with a refusal no step has a result.

    steps: plan, step, op, round_to (0 to 10, or null). refs: plan, step, ref,
    book, sheet, area (A1). cells: book, sheet, row, col, number decimal(20,6),
    text, error, missing (a formula without a cached value), unit.

    Steps that ask for more than the budget are refused before any cell is
    read, so the areas of a step have few places, and each meets its cells by
    an equality join. The first reason in the order below is the refusal.
    """
    asked = refs.withColumn("a", area(F.col("area"))).withColumn("n", (F.col("a.bottom") - F.col("a.top") + 1) * (F.col("a.right") - F.col("a.left") + 1))
    shape = asked.groupBy("plan", "step").agg(F.count("*").alias("refs"), F.count_if(F.col("a").isNull()).alias("bad"), F.sum("n").alias("cells"), F.max("n").alias("widest"))
    s = steps.join(shape, ["plan", "step"], "left")
    two = F.col("op").isin(*TWO)
    before = (
        F.when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "unknown operation")
        .when(F.col("round_to").isNotNull() & ~F.col("round_to").between(0, PLACES), "rounding out of range")
        .when(F.col("refs").isNull(), "no refs")
        .when(two & (F.col("refs") != 2), "two refs needed")
        .when(F.col("bad") > 0, "not an area")
        .when(two & (F.col("widest") > 1), "single cells needed")
        .when(F.col("cells") > MAX_INPUTS, "too many cells")
    )
    s = s.withColumn("before", before)
    readable = asked.join(s.where("before IS NULL").select("plan", "step"), ["plan", "step"], "left_semi")
    boxes = readable.select("plan", "step", "ref", "book", "sheet", "n", F.col("a.top").alias("top"), F.col("a.bottom").alias("bottom"), F.col("a.left").alias("left"), F.col("a.right").alias("right"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    placed = cells.select("book", "sheet", whole("row"), whole("col"), "number", "text", "error", "missing", "unit")
    # Cells outside all areas of their sheet go before they are dealt out by place.
    hull = boxes.groupBy("book", "sheet").agg(F.min("top").alias("_t"), F.max("bottom").alias("_b"), F.min("left").alias("_l"), F.max("right").alias("_r"))
    near = placed.join(hull, ["book", "sheet"]).where(F.col("row").between(F.col("_t"), F.col("_b")) & F.col("col").between(F.col("_l"), F.col("_r"))).drop("_t", "_b", "_l", "_r")
    spots = boxes.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right"))).drop("top", "bottom", "left", "right")
    # A single cell that no row describes is blank as well, so every ref of one cell stands at least once.
    every = spots.join(near.withColumn("_met", F.lit(True)), ["book", "sheet", "row", "col"], "left").where(F.col("_met") | (F.col("n") == 1))
    blank = F.col("number").isNull() & F.coalesce(F.col("text") == "", F.col("text").isNull())
    fault = F.when(F.coalesce("missing", F.lit(False)), "no cached value").when(F.col("error").isNotNull(), "error value").when(blank & (F.col("n") == 1), "blank cell").when(~blank & F.col("number").isNull(), "not a number")
    place = F.struct("ref", "row", "col")
    used = F.when(F.col("number").isNotNull() & fault.isNull(), F.struct("ref", "row", "col", "number", "unit"))
    got = every.groupBy("plan", "step").agg(F.min(F.when(fault.isNotNull(), F.struct(place.alias("p"), fault.alias("why")))).alias("fault"), F.array_sort(F.collect_list(used)).alias("v"))
    s = s.join(got, ["plan", "step"], "left").withColumn("v", F.coalesce("v", F.array().cast(got.schema["v"].dataType)))

    units = F.array_sort(F.array_distinct(F.transform("v", lambda x: F.coalesce(x["unit"], F.lit(NOT_STATED)))))
    s = s.withColumn("us", units).withColumn("a", F.get("v", F.lit(0))["number"]).withColumn("b", F.get("v", F.lit(1))["number"]).withColumn("k", F.size("v"))
    stated_units = F.filter("us", lambda u: u != NOT_STATED)
    own = ~F.col("op").isin("count")
    why = (
        F.when(F.col("before").isNotNull(), F.col("before"))
        .when(F.col("fault").isNotNull(), F.col("fault.why"))
        .when(own & (F.col("k") == 0), "no numeric cells")
        .when(own & F.exists("us", lambda u: u.startswith(AMBIGUOUS)), "ambiguous units")
        .when(F.col("op").isin("sum", "average", "min", "max", "difference") & (F.size("us") > 1), "mixed units")
        .when(F.col("op").isin("ratio", "pct_change") & (F.size(stated_units) > 1), "mixed units")
        .when((F.col("op") == "ratio") & (F.col("b") == 0), "zero denominator")
        .when((F.col("op") == "pct_change") & (F.col("a") == 0), "zero start")
    )
    numbers = F.transform("v", lambda x: x["number"])
    total = F.aggregate(numbers, F.lit(0).cast("decimal(28,6)"), lambda acc, x: (acc + x).cast("decimal(28,6)"))
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    op = lambda name: F.col("op") == name
    safe = lambda x: F.nullif(x, F.lit(0).cast("decimal(20,6)"))
    value = F.lit(None).cast("decimal(38,16)")
    for name, made in (("sum", total), ("average", total / F.nullif(k, F.lit(0)).cast("decimal(10,0)")), ("min", F.array_min(numbers)), ("max", F.array_max(numbers)), ("difference", a - b), ("ratio", a / safe(b)), ("pct_change", ((b - a) * 100).cast("decimal(24,6)") / safe(a))):
        value = F.when(op(name), made.try_cast("decimal(38,16)")).otherwise(value)
    unit = F.when(op("count"), "count").when(op("ratio"), "unitless").when(op("pct_change"), PERCENT).otherwise(F.get("us", F.lit(0)))
    s = s.withColumn("refusal", why).withColumn("value", F.when(F.col("refusal").isNull(), value))
    text = F.when(op("count"), F.col("k").cast("string")).otherwise(rounded(F.col("value"), F.col("round_to")))
    out = s.select("plan", "step", "op", "refusal", F.when(F.col("refusal").isNull(), text).alias("text"), F.when(F.col("refusal").isNull(), unit).alias("units"), F.col("k").alias("inputs"))
    gate = out.groupBy("plan").agg((F.count("refusal") == 0).alias("ok"))
    return out.join(gate, "plan").select("plan", "step", "op", F.when(F.col("ok"), F.col("text")).alias("result"), "units", "inputs", "refusal", "ok")
