"""Number forms, match terms and log factorials on literals."""

import math

import pytest
from pyspark.sql import functions as F

from docstrata.plans.evaluation import log_factorial
from docstrata.plans.reading import match_terms, number_forms


@pytest.mark.parametrize(
    ("text", "forms"),
    [("paid 1,234.56 and 6,545,000.", ["1234.56", "6545000"]), ("1,2,3", []), ("1,234,5", []), ("12,34", []), ("x1,234 1,234x 1,234.5.6", []), ("1,234; 1,234", ["1234"]), ("", []), ("(999,999)", ["999999"])],
)
def test_number_forms(spark, text, forms):
    assert spark.range(1).select(number_forms(F.lit(text))).first()[0] == forms


@pytest.mark.parametrize(
    ("text", "terms"),
    [("What is the J-01 plan?", ["j", "01", "plan"]), ("what is the", ["what", "is", "the"]), ("", []), ("total 1,234", ["total", "1", "234", "1234"]), ("cat cat", ["cat", "cat"])],
)
def test_match_terms(spark, text, terms):
    assert spark.range(1).select(match_terms(F.lit(text))).first()[0] == terms


def test_log_factorial(spark):
    for n, got in spark.createDataFrame([(n,) for n in (0, 1, 2, 7, 50, 100_000, 10**8)], "n long").select("n", log_factorial(F.col("n"))).collect():
        assert got == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-11)
