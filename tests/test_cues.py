"""Cues and dates: each text is searched once for a pattern, and what is found stays as it was."""

from pyspark.sql import functions as F

from docstrata.operators.dates import dates_in
from docstrata.operators.documents import duration, fiscal_year


def test_one_search(spark):
    """Parts of a duration or a fiscal year are read from the match, not by searching the text again for each."""
    d = spark.createDataFrame([("x",)], "text string")
    plan = d.select(duration(F.col("text")).alias("d"), fiscal_year(F.col("text")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(text") == 2


def test_size_of_dates(spark):
    """A month's name is looked up in one place, not in a chain that repeats its pattern for each month."""
    d = spark.createDataFrame([("x",)], "text string")
    assert d.select(dates_in(F.col("text")).alias("d"))._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 4 * 3


def test_values(spark):
    rows = ["kept ninety (60) days, not 5 years", "x5 days", "Twenty-One weeks", "twenty one-month", "1 day", "7 dayss, two years", "FY25-26", "aFY25 fy 2031", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = {r["i"]: (r["d"], r["f"]) for r in d.select("i", duration(F.col("text")).alias("d"), fiscal_year(F.col("text")).alias("f")).collect()}
    assert [got[i][0] for i in range(6)] == ["60 days", None, "21 weeks", "21 months", "1 day", "2 years"]
    assert [got[i][1] for i in range(6, 10)] == ["FY2025-26", "FY2031", None, None]
    t = "Sept 3rd, 2020; 29 Feb 2021; 29th day of February, 2020; 2020-1-5 or 0000-01-01, 12/31/1999 and 31/12/1999"
    found = [x["iso"] for x in spark.createDataFrame([(t,)], "t string").select(dates_in(F.col("t")).alias("d")).first()["d"]]
    assert found == ["2020-09-03", "2020-02-29", "2020-01-05", "1999-12-31"]
