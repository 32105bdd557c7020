"""Units, areas and calculation plans against plain Python decimals."""

import decimal
import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.operators import workbook as w

D = decimal.Decimal


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("lines", "want"), [(["Amounts in INR thousands"], "INR thousands"), (["Rs. crore"], "INR crores"), (["US dollars", "and EUR"], "ambiguous: EUR, USD"), (["million or billion"], "ambiguous: billions, millions"), (["no unit"], "not stated"), ([], "not stated"), (["£ 5"], "GBP")])
def test_context_unit(spark, lines, want):
    assert one(spark, w.context_unit(F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>"))) == want


@pytest.mark.parametrize(
    ("header", "percent", "sheet", "want"),
    [("Growth %", False, "USD", "percent"), ("Total", True, "USD", "percent"), ("Total (INR)", False, "USD thousands", "INR thousands"), ("Total (millions)", False, "USD thousands", "USD millions"), ("Total (INR)", False, "not stated", "INR"), ("Total (USD) (EUR)", False, "not stated", "ambiguous: EUR, USD"), ("Total (net)", False, "USD", "USD"), (None, False, "ambiguous: EUR, USD", "ambiguous: EUR, USD"), ("A (EUR)", False, "ambiguous: EUR, USD", "EUR")],
)
def test_cell_unit(spark, header, percent, sheet, want):
    assert one(spark, w.cell_unit(F.lit(header).cast("string"), F.lit(percent), F.lit(sheet))) == want


@pytest.mark.parametrize(("text", "want"), [("B7", (7, 2, 7, 2)), ("$C$9:a1", (1, 1, 9, 3)), (" XFD1048576 ", (1048576, 16384, 1048576, 16384)), ("XFE1", None), ("A0", None), ("A1048577", None), ("A:A", None), ("3:3", None), ("A1,B2", None), ("", None), (None, None)])
def test_area(spark, text, want):
    got = one(spark, w.area(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("fmt", "want"), [("#,##0", None), ("#,##0,", "thousands"), ('0.0,,"M"', "millions"), ("0,,,", "billions"), ("0.00;-0,", None)])
def test_display_scale(spark, fmt, want):
    assert one(spark, w.display_scale(F.lit(fmt))) == want


def address(row, col):
    return f"{chr(64 + col)}{row}"


def plain(op, refs, places, cells):
    """(result, refusal) of one step, by the order of checks that the operator states."""
    values, units = [], []
    boxes = []
    for text in refs:
        m = re.fullmatch(r"([A-Z])(\d+)(?::([A-Z])(\d+))?", text)
        if not m:
            boxes.append(None)
            continue
        c1, r1 = ord(m[1]) - 64, int(m[2])
        c2, r2 = (ord(m[3]) - 64, int(m[4])) if m[3] else (c1, r1)
        boxes.append([(r, c) for r in range(min(r1, r2), max(r1, r2) + 1) for c in range(min(c1, c2), max(c1, c2) + 1)])
    if op not in w.OPERATIONS:
        return None, "unknown operation"
    if places is not None and not 0 <= places <= 10:
        return None, "rounding out of range"
    if not refs:
        return None, "no refs"
    if op in w.TWO and len(refs) != 2:
        return None, "two refs needed"
    if None in boxes:
        return None, "not an area"
    if op in w.TWO and any(len(b) > 1 for b in boxes):
        return None, "single cells needed"
    if sum(map(len, boxes)) > 200:
        return None, "too many cells"
    for box in boxes:
        for at in box:
            number, text, error, missing, unit = cells.get(at, (None, None, None, False, None))
            if missing:
                return None, "no cached value"
            if error:
                return None, "error value"
            if number is None and not text:
                if len(box) == 1:
                    return None, "blank cell"
                continue
            if number is None:
                return None, "not a number"
            values.append(number)
            units.append(unit or "not stated")
    if op == "count":
        return str(len(values)), None
    if not values:
        return None, "no numeric cells"
    if any(u.startswith("ambiguous") for u in units):
        return None, "ambiguous units"
    if op in ("ratio", "pct_change"):
        if len(set(units) - {"not stated"}) > 1:
            return None, "mixed units"
    elif len(set(units)) > 1:
        return None, "mixed units"
    a, b = (values + [None])[:2]
    if op == "ratio" and b == 0:
        return None, "zero denominator"
    if op == "pct_change" and a == 0:
        return None, "zero start"
    with decimal.localcontext() as c:
        c.prec = 60
        x = {"sum": lambda: sum(values), "average": lambda: sum(values) / len(values), "min": lambda: min(values), "max": lambda: max(values), "difference": lambda: a - b, "ratio": lambda: a / b, "pct_change": lambda: (b - a) * 100 / a}[op]()
        q = x.quantize(D(1).scaleb(-(10 if places is None else places)), rounding=decimal.ROUND_HALF_UP)
    out = format(q, "f")
    return (out if places is not None else re.sub(r"\.?0+$", "", out)), None


def test_plans(spark):
    r = random.Random(7)
    books, cell_rows = {}, []
    for book in range(4):
        cells = {}
        for row in range(1, 25):
            for col in range(1, 6):
                kind = r.random()
                unit = ["USD", "USD", "USD", "not stated", "ambiguous: EUR, USD"][col - 1] if book % 2 else "USD"
                if kind < 0.06:
                    cells[row, col] = (None, "n/a", None, False, unit)
                elif kind < 0.09:
                    cells[row, col] = (None, None, "#REF!", False, unit)
                elif kind < 0.12:
                    cells[row, col] = (None, None, None, True, unit)
                elif kind < 0.3:
                    cells[row, col] = (D(r.choice([0, 1, -3, 7])), None, None, False, unit)
                elif kind < 0.9:
                    cells[row, col] = (D(r.randrange(-10**7, 10**7)) / 1000, None, None, False, unit)
                elif kind < 0.95:
                    cells[row, col] = (None, "", None, False, unit)
        books[book] = cells
        cell_rows += [(book, "S", row, col, *v) for (row, col), v in cells.items()]
    steps, refs, want = [], [], {}
    for plan in range(150):
        for step in range(r.choice([1, 2, 3])):
            book, op = plan % 4, r.choice([*w.OPERATIONS, *w.OPERATIONS, "median"])
            places = r.choice([0, 2, 2, 4, 10, None, None, 11 if r.random() < 0.1 else 3])
            n = 2 if op in w.TWO and r.random() < 0.9 else r.choice([0, 1, 2, 3])
            texts = []
            for _ in range(n):
                a = address(r.randrange(1, 27), r.randrange(1, 7))
                wide = r.random() < (0.1 if op in w.TWO else 0.6)
                texts.append("A:A" if r.random() < 0.02 else f"{a}:{address(r.randrange(1, 60 if r.random() < 0.1 else 8), r.randrange(1, 4))}" if wide else a)
            steps.append((plan, step, op, places))
            refs += [(plan, step, i, book, "S", t) for i, t in enumerate(texts)]
            want[plan, step] = plain(op, texts, places, books[book])
    got = w.calculated(
        spark.createDataFrame(steps, "plan long, step int, op string, round_to int"),
        spark.createDataFrame(refs, "plan long, step int, ref int, book long, sheet string, area string"),
        spark.createDataFrame(cell_rows, "book long, sheet string, row int, col int, number decimal(20,6), text string, error string, missing boolean, unit string"),
    ).collect()
    assert len(got) == len(steps)
    ok = {p: all(want[q, s][1] is None for q, s in want if q == p) for p in range(150)}
    for x in got:
        result, refusal = want[x["plan"], x["step"]]
        assert (x["refusal"], x["ok"]) == (refusal, ok[x["plan"]]), (x, want[x["plan"], x["step"]])
        assert x["result"] == (result if ok[x["plan"]] else None), (x, result)
    assert len({v[1] for v in want.values()}) > 8


def test_a_large_sheet_stands_once(spark):
    """A sheet of more rows than keys without grids have: its cells stand in no grids, and none is counted before the plans run."""
    cells = spark.range(1, 6001).selectExpr("1L AS book", "'S' AS sheet", "int(id) AS row", "2 AS col", "CAST(id AS decimal(20,6)) AS number", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS error", "false AS missing", "'USD' AS unit")
    steps = spark.createDataFrame([(1, 1, "sum", 0), (1, 2, "max", 0), (1, 3, "sum", 0), (2, 1, "sum", 0)], "plan long, step int, op string, round_to int")
    refs = spark.createDataFrame([(1, 1, 0, 1, "S", "B5001:B5003"), (1, 2, 0, 1, "S", "B2:B5"), (1, 2, 1, 1, "S", "A3:B4"), (1, 3, 0, 1, "S", "B6000:B6050"), (2, 1, 0, 1, "S", "C9")], "plan long, step int, ref int, book long, sheet string, area string")
    spark.sparkContext.setJobGroup("large sheet", "")
    try:
        out = w.calculated(steps, refs, cells)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("large sheet")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = sorted((x["plan"], x["step"], x["result"], x["inputs"], x["refusal"]) for x in out.collect())
    assert got == [(1, 1, "15006", 3, None), (1, 2, "5", 6, None), (1, 3, "6000", 1, None), (2, 1, None, 0, "blank cell")]
