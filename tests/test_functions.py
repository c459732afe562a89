"""Edge semantics of the column helpers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import labels as L


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_fiscal_period(spark):
    assert one(spark, L.fiscal_period(F.lit("FY2025"), F.lit(5))) == "FY2025-05"
    assert one(spark, L.fiscal_period(F.lit("FY2025"), F.lit(10))) == "FY2025-10"
    assert one(spark, L.fiscal_period(F.lit(None).cast("string"), F.lit(9))) == "-09"


def test_quarter(spark):
    assert [one(spark, L.fiscal_quarter_label(F.lit(p))) for p in (1, 4, 9, 12, 13)] == ["Q1", "Q2", "Q3", "Q4", None]


def test_account_type(spark):
    assert one(spark, L.account_type_name(F.lit("X"))) == "Unknown Account Type"
    assert one(spark, L.account_type_order(F.lit("X"))) is None
    assert one(spark, L.account_type_order(F.lit("E"))) == 4


def test_aging_edges(spark):
    as_of = "2000-06-15 10:30:00"
    d = dt.date(2000, 6, 15)

    def bucket(days_back):
        return one(spark, L.aging_bucket(F.lit(d - dt.timedelta(days=days_back)), as_of))
    assert bucket(0) == "1-30 days past due"          # due today: as_of has a time part
    assert bucket(30) == "31-60 days past due"
    assert bucket(90) == "90+ days past due"
    assert bucket(-1) == "Current"
    assert one(spark, L.aging_bucket(F.lit(None).cast("date"), as_of)) == "Current"


def test_zero_pad_keeps_tail(spark):
    assert one(spark, L.zero_pad_right(F.lit(42))) == "0000000042"
    assert one(spark, L.zero_pad_right(F.lit("123456789012"))) == "3456789012"


def test_round_to_scale(spark):
    x = F.lit(Decimal("2.345")).cast("decimal(18,3)")
    assert one(spark, L.round_to_scale(x, F.lit(2))) == Decimal("2.35")
    assert one(spark, L.round_to_scale(x, F.lit(0))) == Decimal("2.00")


def test_blank_or_in(spark):
    assert one(spark, L.blank_or_in(F.lit(None).cast("string"), ["A"])) is True
    assert one(spark, L.blank_or_in(F.lit(""), ["A"])) is True
    assert one(spark, L.blank_or_in(F.lit("A"), ["A"])) is True
    assert one(spark, L.blank_or_in(F.lit("B"), ["A"])) is False


def test_signed_amount_forms(spark):
    d, c = F.lit(Decimal("10.00")), F.lit(Decimal("3.00"))
    assert one(spark, L.signed_amount(F.lit("R"), d, c)) == Decimal("-7.00")
    assert one(spark, L.signed_amount(F.lit("A"), d, c)) == Decimal("7.00")
    assert one(spark, L.signed_amount(F.lit("A"), d, c, ("R",), ("E",))) == Decimal("0.00")
