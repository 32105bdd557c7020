import pytest
from pyspark.sql import functions as F

from docstrata.operators.documents import citation_ids, doc_type, duration, fiscal_year, iso_dates
from docstrata.operators.sections import sections


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_sections(spark):
    text = "intro\n# A\na1\n## B\n```\n# not\n```\n# C\n### D\nd"
    got = [tuple(r) for r in sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()]
    assert got == [(1, 0, "", 0, "intro"), (1, 1, "A", 1, "# A\na1"), (1, 2, "A > B", 3, "## B\n```\n# not\n```"), (1, 3, "C", 7, "# C"), (1, 4, "C > D", 8, "### D\nd")]


@pytest.mark.parametrize(("text", "want"), [("within sixty (60) days of", "60 days"), ("a term of 1 year", "1 year"), ("thirty days", "30 days"), ("soon", None), ("within 30 days, at most sixty (60) months", "30 days"), ("several days, then Two Weeks", "2 weeks"), ("forty-five days", "45 days"), ("twenty days", "20 days"), ("a 30-day notice", "30 days"), ("Ninety nine-day term", "99 days"), ("eleven months", "11 months"), ("seventy years", "70 years")])
def test_duration(spark, text, want):
    assert one(spark, duration(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("in FY25-26 we", "FY2025-26"), ("FY 2024", "FY2024"), ("2024", None)])
def test_fiscal_year(spark, text, want):
    assert one(spark, fiscal_year(F.lit(text))) == want


def test_dates_and_types(spark):
    got = one(spark, iso_dates(F.lit("on 2024-02-30, 2024-03-05 and 5 March 2024 or 1 May 2023")))
    assert [str(d) for d in got] == ["2024-03-05", "2023-05-01"]
    assert one(spark, doc_type(F.lit("Amendment No. 1 to the Agreement"))) == "amendment"
    assert one(spark, citation_ids(F.lit("x [a #0123456789ab] y [b #0123456789ab] [c #zz]"))) == ["0123456789ab"]
