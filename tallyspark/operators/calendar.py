"""Fiscal calendar (D3) and trailing-window filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import fiscal_period, fiscal_quarter_label


def fiscal_calendar(fiscal_month: DataFrame, fiscal_quarter: DataFrame, fiscal_year: DataFrame) -> DataFrame:
    """One row per fiscal month with quarter/year attributes and neighbour keys.

    ``next_month_key`` / ``prev_month_key`` are the months starting the day
    after this month's end / ending the day before this month's start
    (the reference's ``DATEADD(day, ±1, …)`` joins), computed once here so
    fact tables join them by key.  The calendar is a few hundred rows per
    decade, so every join here and against it is a broadcast.
    """
    fm = fiscal_month.alias("fm")
    fy = F.broadcast(fiscal_year.select(
        "fiscal_year_key", F.col("name").alias("fiscal_year_name"),
        F.col("begin_date").alias("fiscal_year_begin_date"), F.col("end_date").alias("fiscal_year_end_date")))
    fq = F.broadcast(fiscal_quarter.select(
        "fiscal_quarter_key", F.col("begin_date").alias("fiscal_quarter_begin_date"),
        F.col("end_date").alias("fiscal_quarter_end_date")))
    nxt = F.broadcast(fiscal_month.select(
        F.col("fiscal_month_key").alias("next_month_key"),
        F.col("period_number").alias("next_period_number"),
        F.col("fiscal_year_key").alias("next_fiscal_year_key"),
        F.date_sub("begin_date", 1).alias("_nb")))
    prv = F.broadcast(fiscal_month.select(
        F.col("fiscal_month_key").alias("prev_month_key"),
        F.col("fiscal_year_key").alias("prev_fiscal_year_key"),
        F.date_add("end_date", 1).alias("_pe")))
    return (
        fm.join(fy, "fiscal_year_key")
        .join(fq, "fiscal_quarter_key")
        .join(nxt, F.col("fm.end_date") == F.col("_nb"), "left")
        .join(prv, F.col("fm.begin_date") == F.col("_pe"), "left")
        .select(
            "fm.fiscal_month_key", "fm.fiscal_year_key", "fm.fiscal_quarter_key", "fm.period_number",
            "fm.begin_date", "fm.end_date", "fiscal_year_name",
            fiscal_period("fiscal_year_name", "fm.period_number").alias("fiscal_period"),
            fiscal_quarter_label("fm.period_number").alias("fiscal_quarter"),
            "fiscal_quarter_begin_date", "fiscal_quarter_end_date",
            "fiscal_year_begin_date", "fiscal_year_end_date",
            "next_month_key", "next_period_number", "next_fiscal_year_key",
            "prev_month_key", "prev_fiscal_year_key",
        )
    )


def month_start(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("timestamp_ntz"), "MM")


def trailing_months(col, as_of: str, n: int) -> Column:
    """``col >= first day of (as_of's month) - n months`` (month aligned)."""
    c = F.col(col) if isinstance(col, str) else col
    return c >= F.add_months(month_start(as_of), -n)


def trailing_years(col, as_of: str, n: int) -> Column:
    """``col >= as_of - n years`` with the time of day kept (not month aligned)."""
    c = F.col(col) if isinstance(col, str) else col
    ts = F.lit(as_of).cast("timestamp_ntz")
    return c.cast("timestamp_ntz") >= ts - F.expr(f"INTERVAL {n} YEARS")
