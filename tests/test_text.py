import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("  a\t\xa0\x1c", "a"), ("", ""), (None, None), ("　x y\n", "x y")])
def test_strip(spark, text, want):
    assert one(spark, text, X.strip) == want


D = datetime.date


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-03-15", D(2024, 3, 15)),
        ("signed 15/03/2024", D(2024, 3, 15)),
        ("03/15/2024", D(2024, 3, 15)),
        ("05/03/2024", None),
        ("05.03.2024", D(2024, 3, 5)),
        ("04/04/2024", D(2024, 4, 4)),
        ("03/15/24", None),
        ("March 5th, 2024", D(2024, 3, 5)),
        ("1st day of June, 2023", D(2023, 6, 1)),
        ("2024-02-30", None),
        ("no date", None),
        ("On 5 May 2020 and 2021-01-01", D(2020, 5, 5)),
        (None, None),
    ],
)
def test_normal_date(spark, text, want):
    assert one(spark, text, X.normal_date) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("$1,234.56", "1234.56"),
        ("EUR 1.234,56", "1234.56"),
        ("-$5", "-5"),
        ("USD 2 million", "2000000"),
        ("10 apples for $3", "3"),
        ("1 or 2", None),
        ("1.234", "1.234"),
        ("", None),
        ("£1'000", "1000"),
    ],
)
def test_amount(spark, text, want):
    got = one(spark, text, X.amount)
    assert got == (None if want is None else decimal.Decimal(want))


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-06-30", D(2024, 6, 30)),
        ("June 30, 2024", D(2024, 6, 30)),
        ("within 30 days", D(2024, 3, 1)),
        ("60 days after the Effective Date", D(2024, 3, 31)),
        ("30 days after termination", None),
        ("10 business days", None),
        ("within 1 month", D(2024, 2, 29)),
        ("2 weeks", D(2024, 2, 14)),
        ("thirty (30) days", D(2024, 3, 1)),
        ("ten (10) days", None),
        ("upon demand", None),
        (" ", None),
    ],
)
def test_deadline(spark, text, want):
    got = one(spark, text, lambda c: X.deadline_date(c, F.lit(D(2024, 1, 31))))
    assert got == want


def test_two_decimals(spark):
    values = [0.585, 0.575, 0.125, 0.375, 0.0, 1.0, 0.999, 0.005, 0.015]
    rows = spark.createDataFrame([(v,) for v in values], "c double").select("c", X.two_decimals(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in rows} == {v: f"{v:.2f}" for v in values}


def test_jurisdictions(spark):
    got = {s: one(spark, s, lambda c: X.jurisdiction_label(X.jurisdiction(c))) for s in ("us-ca", "US-Federal", "EU", "DE")}
    assert got == {"us-ca": "US-CA", "US-Federal": "US-Federal", "EU": "INT", "DE": "DE"}
    assert one(spark, None, X.jurisdiction) is None


def test_safe_cell_and_ical(spark):
    assert one(spark, "=1+1", X.safe_cell) == "'=1+1" and one(spark, None, X.safe_cell) == ""
    assert one(spark, "a;b,c\\d\r\ne", X.ical_text) == r"a\;b\,c\\d\ne"
