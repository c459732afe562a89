"""Budget / actual reports (D30, D31, D32): the fact joined to its dimensions.

The fact (D15) is aggregated before any dimension is attached, so the
dimension joins see one row per (account, org, month, name, currency) rather
than per GL line.  Only what a report projects is built: the org dimension
contributes nothing but its key to these reports, so it is reduced to a key
existence check instead of flattening four trees that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import fiscal_calendar
from .dims import account_dim
from .ledger import budget_actual_fact


def _org_keys(lg) -> DataFrame:
    return lg.customer.filter(F.col("customer_key").isNotNull()).select(
        F.col("customer_key").alias("organization_key"))


def _fin_levels(lg) -> DataFrame:
    """Account key, type and financial levels 1 to 6: all that the reports show of an account."""
    return account_dim(lg, columns=["account_key", "acct_type", *[f"acct_fin_lv{k}_{s}" for k in range(1, 7) for s in ("code", "name")]])


def aop_report(lg, viewer: int, as_of: str) -> DataFrame:
    """Budget view (missing side = 0), 36 months, 20 report columns."""
    fact = budget_actual_fact(lg, viewer, as_of, 36, "zero")
    acct = _fin_levels(lg).select(F.col("account_key").alias("dim_account_key"), "acct_type",
                                  *[f"acct_fin_lv{k}_{s}" for k in range(2, 7) for s in ("code", "name")])
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year).select(
        F.col("fiscal_month_key").alias("calendar_fiscal_month_key"))
    orgs = _org_keys(lg)
    df = (fact.drop("acct_type")
          .join(acct, fact.account_key == acct.dim_account_key)
          .join(F.broadcast(cal), fact.fiscal_month_key == cal.calendar_fiscal_month_key)
          .join(orgs, "organization_key"))
    return df.select(
        "budget", "fiscal_period",
        *[f"acct_fin_lv{k}_{s}" for k in range(2, 7) for s in ("code", "name")],
        "acct_type", "organization_key", "fiscal_month_key", "act_budname", "dim_account_key",
        F.col("organization_key").alias("customer_key"), "calendar_fiscal_month_key", "fin_org_code",
    )


def income_statement(lg, viewer: int, as_of: str) -> DataFrame:
    """Income statement (missing side NULL), positional columns c0..c20."""
    fact = budget_actual_fact(lg, viewer, as_of, 36, "null")
    acct = _fin_levels(lg).select(F.col("account_key").alias("dim_account_key"),
                                  F.col("acct_type").alias("dim_acct_type"),
                                  *[f"acct_fin_lv{k}_{s}" for k in range(2, 7) for s in ("code", "name")])
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year).select(
        F.col("fiscal_month_key").alias("cal_key"))
    df = (fact.join(acct, fact.account_key == acct.dim_account_key)
          .join(F.broadcast(cal), fact.fiscal_month_key == cal.cal_key)
          .join(_org_keys(lg), "organization_key"))
    out = df.select(
        "fiscal_period", *[f"acct_fin_lv{k}_{s}" for k in range(2, 7) for s in ("code", "name")],
        "dim_acct_type", "actual", "account_key", "organization_key", "fiscal_month_key", "act_budname",
        "dim_account_key", F.col("organization_key").alias("_ck"), "cal_key", "fin_org_code",
    )
    return out.toDF(*[f"c{i}" for i in range(21)])


def aop_vs_actual(lg, viewer: int, as_of: str, year_from: str, year_to: str,
                  names=("AOP", "Actual")) -> DataFrame:
    """AOP vs Actual over 48 months for a fiscal-year range, c0..c15, sorted."""
    fact = budget_actual_fact(lg, viewer, as_of, 48, "null")
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year).select(
        F.col("fiscal_month_key").alias("cal_key"), "fiscal_year_name", "fiscal_quarter",
        F.col("end_date").alias("month_end"))
    acct = _fin_levels(lg).select(F.col("account_key").alias("dim_account_key"),
                                  *[f"acct_fin_lv{k}_code" for k in (1, 4, 5, 6)])
    df = (fact.join(acct, fact.account_key == acct.dim_account_key)
          .join(F.broadcast(cal), fact.fiscal_month_key == cal.cal_key))
    df = df.filter(
        (F.col("fiscal_year_name").between(year_from, year_to) | F.col("month_end").isNull())
        & F.col("act_budname").isin(*names))
    out = df.select(
        "act_budname", "fiscal_year_name", "fiscal_quarter", "month_end", "acct_fin_lv5_code", "actual", "budget",
        "acct_fin_lv4_code", "acct_fin_lv6_code", "acct_fin_lv1_code", "net_amount", "account_key",
        "organization_key", "fiscal_month_key", "dim_account_key", "cal_key",
    ).toDF(*[f"c{i}" for i in range(16)])
    return out.orderBy(F.col("c4").asc_nulls_first(), F.col("c3").desc_nulls_last())
