"""Ledger facts: GL detail (D24), KPI totals (D26/D27), budget vs actual.

Operators take a ledger source ``lg`` (any object exposing the ledger tables
as DataFrame attributes, e.g. :class:`tallyspark.sources.fixtures.Ledger`).

Plan shape: the general ledger and budget detail are the only large inputs.
Dimensions (accounts, calendar, currencies, orgs) are joined as plain equi
joins; Spark broadcasts them when their measured size is under the broadcast
threshold (statically from file statistics, or at runtime through AQE) and
falls back to a shuffle join otherwise, so a growing dimension never gets
forced into executor memory.  Only the calendar and currency tables, whose
size is fixed by construction, carry explicit broadcast hints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (
    MONEY,
    TOTAL,
    account_type_name,
    account_type_order,
    fiscal_period,
    gl_doc_type,
    gl_doc_type_description,
    signed_amount,
)
from .access import filter_finance_access
from .calendar import trailing_months, trailing_years
from .joins import held


def _orgs(lg, prefix: str, key: str = "customer_key") -> DataFrame:
    return lg.customer.select(
        F.col(key).alias(f"{prefix}_key"),
        F.col("customer_code").alias(f"{prefix}_code"),
        F.col("customer_name").alias(f"{prefix}_name"),
    )


def _months(lg) -> DataFrame:
    fy = F.broadcast(lg.fiscal_year.select("fiscal_year_key", F.col("name").alias("fiscal_year_name")))
    return F.broadcast(
        lg.fiscal_month.join(fy, "fiscal_year_key").select(
            "fiscal_month_key", "fiscal_year_key", "period_number", "begin_date", "end_date",
            fiscal_period("fiscal_year_name", "period_number").alias("fiscal_period"),
        )
    )


def _currency(lg, alias: str) -> DataFrame:
    return F.broadcast(lg.currency_code.select(
        F.col("currency_code_key").alias(f"{alias}_key"),
        F.col("iso_currency_code").alias(f"{alias}_code"),
    ))


def in_months(gl: DataFrame, months: DataFrame, how: str = "inner") -> DataFrame:
    """GL rows of some months (``how``: inner or left_semi).

    Of a ledger stored by fiscal year only the years from the first to the last
    of these months are read: their bounds are scalar subqueries over the
    calendar, which Spark evaluates before it lists the partitions.
    """
    if "fiscal_year_key" in gl.columns:
        first, last = (months.agg(f("fiscal_year_key")).scalar() for f in (F.min, F.max))
        gl = gl.filter(F.col("fiscal_year_key").between(first, last)).drop("fiscal_year_key")
    return gl.join(months.drop("fiscal_year_key"), "fiscal_month_key", how)


def finance_filter(lg, df: DataFrame, org_col: str, viewer: int) -> DataFrame:
    return filter_finance_access(df, org_col, viewer, lg.member, lg.org_access_person,
                                 lg.access_customer_view, lg.customer)


# --------------------------------------------------------------------------- D24
def orgs_with_entity(lg, orgs: DataFrame, key: str) -> DataFrame:
    """Code and name of ``orgs`` and of their legal entities by ``key``: one lookup for a fact."""
    org = orgs.select(F.col("customer_key").alias(key), F.col("customer_code").alias("fin_org_code"),
                      F.col("customer_name").alias("fin_org_name"), F.col("legal_entity_key").alias("_le_key"))
    return org.join(_orgs(lg, "le_org"), F.col("_le_key") == F.col("le_org_key"), "left").drop("_le_key", "le_org_key")


def gl_detail(lg, as_of: str, years: int = 3, orgs: DataFrame | None = None) -> DataFrame:
    """GL transaction detail with its 12 lookups (D24), months from ``as_of - years``.

    Lookups of a lookup (legal entity, a project's organizations) are joined
    to it and not to the ledger's rows, which move only for a lookup table too
    large to be sent around (``held``).  ``orgs`` (rows of the organizations)
    leaves only ledger rows of these.
    """
    gl = lg.general_ledger
    near = held(lg.customer)
    a = lg.account.select("account_key", "account_code", F.col("description").alias("acct_description"),
                          F.col("type").alias("acct_type_code"))
    org = near(orgs_with_entity(lg, lg.customer if orgs is None else orgs, "organization_key"))
    months = _months(lg).filter(trailing_years("begin_date", as_of, years))
    proj = lg.project.select("project_key", F.col("project_code").alias("proj_code"),
                             F.col("customer_key").alias("_porg_key"),
                             F.col("owning_customer_key").alias("_pown_key"))
    proj = held(lg.project)(proj.join(_orgs(lg, "proj_org"), F.col("_porg_key") == F.col("proj_org_key"), "left")
                            .join(_orgs(lg, "proj_own"), F.col("_pown_key") == F.col("proj_own_key"), "left"))
    pers = lg.person.select("person_key", F.col("first_name").alias("person_first_name"),
                            F.col("last_name").alias("person_last_name"),
                            F.col("middle_initial").alias("person_middle_initial"))
    df = (
        in_months(gl, months.select("fiscal_month_key", "fiscal_year_key", "fiscal_period"))
        .join(a, "account_key")
        .join(org, "organization_key")
        .join(near(_orgs(lg, "cust")), gl.customer_key == F.col("cust_key"), "left")
        .join(proj, "project_key", "left")
        .join(held(lg.person)(pers), "person_key", "left")
        .join(_currency(lg, "txn_ccy"), F.col("transaction_currency") == F.col("txn_ccy_key"))
        .join(_currency(lg, "loc_ccy"), F.col("local_currency") == F.col("loc_ccy_key"))
    )
    null_money = F.lit(None).cast(MONEY)
    return df.select(
        "general_ledger_key", "account_key", gl.customer_key.alias("customer_key"), "organization_key",
        "project_key", "person_key", "fiscal_month_key", "account_code", "acct_description",
        account_type_name("acct_type_code").alias("acct_type"),
        account_type_order("acct_type_code").alias("acct_type_order"),
        "credit_amount", F.col("cust_code").alias("customer_vendor_code"),
        F.col("cust_name").alias("customer_vendor_name"), "debit_amount",
        F.col("description").alias("gl_description"), F.col("document_number").alias("doc_number"),
        F.col("general_ledger_key").alias("doc_key"),
        gl_doc_type("feature").alias("doc_type"), gl_doc_type_description("feature").alias("doc_type_description"),
        "fin_org_code", "fin_org_name", "fiscal_period", "post_date", "quantity", "transaction_date",
        "le_org_code", "le_org_name", "person_first_name", "person_last_name", "person_middle_initial",
        "proj_code", "proj_org_code", "proj_org_name",
        F.col("proj_own_code").alias("proj_owning_org_code"), F.col("proj_own_name").alias("proj_owning_org_name"),
        "reference",
        null_money.alias("beginning_balance"), null_money.alias("ending_balance"),
        F.col("txn_ccy_code").alias("transaction_currency_code"), F.col("loc_ccy_code").alias("local_currency_code"),
        null_money.alias("local_beginning_balance"), "local_credit_amount", "local_debit_amount",
        null_money.alias("local_ending_balance"),
    )


# ------------------------------------------------------------------ D26 / D27
def ledger_totals(lg, viewer: int, as_of: str, org_codes, account_descriptions,
                  period: str | None = None, years: int = 3) -> DataFrame:
    """Direct-cost / revenue KPI (D26, D27): one row of SUM debit, SUM credit, MAX key.

    The reference unions computed balance rows into the detail before
    summing, but those rows carry NULL debit, credit and key, so they cannot
    change the three aggregates; only the GL detail path is planned.  Codes
    and descriptions are mapped to keys on the (small) dimensions first, so
    the fact is filtered by key with semi joins before anything else.
    """
    gl = lg.general_ledger.select("general_ledger_key", "account_key", "organization_key",
                                  "fiscal_month_key", "debit_amount", "credit_amount",
                                  "transaction_currency", "local_currency",
                                  *[c for c in lg.general_ledger.columns if c == "fiscal_year_key"])
    orgs = lg.customer.filter(F.col("customer_code").isin(*org_codes)).select("customer_key")
    accts = lg.account.filter(F.col("description").isin(*account_descriptions)).select("account_key")
    months = _months(lg).filter(trailing_years("begin_date", as_of, years))
    if period is not None:
        months = months.filter(F.col("fiscal_period") == period)
    ccy = lg.currency_code.select("currency_code_key")
    df = (
        gl.filter(F.col("organization_key").isin(orgs) & F.col("account_key").isin(accts))
        .transform(lambda d: in_months(d, months.select("fiscal_month_key", "fiscal_year_key"), "left_semi"))
        # org must exist (inner join in the detail); legal entity is a left join
        .join(lg.customer.select(F.col("customer_key").alias("organization_key")), "organization_key", "left_semi")
        .join(F.broadcast(ccy), F.col("transaction_currency") == F.col("currency_code_key"), "left_semi")
        .join(F.broadcast(ccy), F.col("local_currency") == F.col("currency_code_key"), "left_semi")
    )
    df = finance_filter(lg, df, "organization_key", viewer)
    return df.agg(
        F.sum("debit_amount").cast(TOTAL).alias("debit_amount"),
        F.sum("credit_amount").cast(TOTAL).alias("credit_amount"),
        F.max("general_ledger_key").alias("general_ledger_key"),
    )


# ---------------------------------------------------------------- D13 - D15
FACT_KEYS = ["account_key", "organization_key", "fiscal_month_key", "act_budname", "local_currency_code"]
FACT_SUMS = ["actual", "budget", "net_amount", "local_actual", "local_net_amount"]


def gl_actuals(lg, as_of: str, months_back: int = 36, missing: str = "zero") -> DataFrame:
    """Actual branch (D13): revenue and expense GL rows signed by normal balance."""
    a = lg.account.filter(F.col("type").isin("R", "E")).select("account_key", F.col("type").alias("_t"))
    months = _months(lg).filter(trailing_months("begin_date", as_of, months_back)).select("fiscal_month_key", "fiscal_year_key")
    org = lg.customer.select(F.col("customer_key").alias("organization_key"))
    other = F.lit(0).cast(MONEY) if missing == "zero" else F.lit(None).cast(MONEY)
    return (
        in_months(lg.general_ledger, months).join(a, "account_key").join(org, "organization_key")
        .join(_currency(lg, "lc"), F.col("local_currency") == F.col("lc_key"))
        .select(
            "account_key", "organization_key", "fiscal_month_key",
            F.lit("Actual").alias("act_budname"), F.col("lc_code").alias("local_currency_code"),
            signed_amount("_t", "debit_amount", "credit_amount").alias("actual"),
            other.alias("budget"),
            (F.col("credit_amount") - F.col("debit_amount")).alias("net_amount"),
            signed_amount("_t", "local_debit_amount", "local_credit_amount").alias("local_actual"),
            (F.col("local_credit_amount") - F.col("local_debit_amount")).alias("local_net_amount"),
        )
    )


def budget_lines(lg, as_of: str, months_back: int = 36, missing: str = "zero") -> DataFrame:
    """Budget branch (D14): budget detail of type-'I' budgets, net signed by type."""
    bo = lg.budget_organization.select("budget_organization_key", "budget_key", "customer_key")
    b = lg.budget.filter(F.col("type") == "I").select("budget_key", "budget_name_key")
    bn = lg.budget_name.select("budget_name_key", "budget_name")
    org = lg.customer.select("customer_key", F.col("legal_entity_key").alias("_le"))
    le = lg.customer.select(F.col("customer_key").alias("_le"), F.col("currency_code_key").alias("_lccy"))
    a = lg.account.select("account_key", F.col("type").alias("_t"))
    months = _months(lg).filter(trailing_months("begin_date", as_of, months_back)).select("fiscal_month_key")
    other = F.lit(0).cast(MONEY) if missing == "zero" else F.lit(None).cast(MONEY)
    amt = F.col("amount").cast(MONEY)
    net = F.when(F.col("_t") == "R", amt).otherwise(amt * F.lit(-1))
    return (
        lg.budget_detail.join(a, "account_key").join(bo, "budget_organization_key")
        .join(b, "budget_key").join(bn, "budget_name_key").join(org, "customer_key")
        .join(months, "fiscal_month_key")
        .join(le, "_le", "left")
        .join(_currency(lg, "lc"), F.col("_lccy") == F.col("lc_key"), "left")
        .select(
            "account_key", F.col("customer_key").alias("organization_key"), "fiscal_month_key",
            F.col("budget_name").alias("act_budname"), F.col("lc_code").alias("local_currency_code"),
            other.alias("actual"), amt.alias("budget"), net.alias("net_amount"),
            other.alias("local_actual"), net.alias("local_net_amount"),
        )
    )


def budget_actual_fact(lg, viewer: int, as_of: str, months_back: int = 36, missing: str = "zero") -> DataFrame:
    """Budget-vs-actual fact (D15), grouped to the reference's 15 columns.

    The 15 grouping columns are functions of (account, org, month, budget
    name, local currency) apart from the names, so the plan aggregates on
    those five keys first (partial aggregation before one shuffle of narrow
    rows) and attaches the labels afterwards, instead of shuffling the
    strings of every fact row.  ``missing`` = 'zero' (budget view) or 'null'
    (income statement / AOP-vs-actual) for the side a branch lacks.
    """
    u = gl_actuals(lg, as_of, months_back, missing).unionByName(budget_lines(lg, as_of, months_back, missing))
    u = finance_filter(lg, u, "organization_key", viewer)
    agg = u.groupBy(*FACT_KEYS).agg(*[F.sum(c).cast(TOTAL).alias(c) for c in FACT_SUMS])
    a = lg.account.select("account_key", "account_code", "description",
                          account_type_order("type").alias("acct_type_order"),
                          account_type_name("type").alias("acct_type"))
    org = lg.customer.select(F.col("customer_key").alias("organization_key"),
                             F.col("customer_code").alias("fin_org_code"),
                             F.col("customer_name").alias("fin_org_name"),
                             F.col("transact_elimination_flag").alias("elimination_flag"),
                             F.col("legal_entity_key").alias("_le"))
    le = lg.customer.select(F.col("customer_key").alias("_le"), F.col("customer_code").alias("le_org_code"),
                            F.col("customer_name").alias("le_org_name"))
    cal = _months(lg).select("fiscal_month_key", "fiscal_period")
    return (
        agg.join(a, "account_key").join(org, "organization_key").join(le, "_le", "left")
        .join(cal, "fiscal_month_key")
        .select("account_key", "organization_key", "fiscal_month_key", "account_code", "description",
                "acct_type_order", "acct_type", "fin_org_code", "fin_org_name", "fiscal_period",
                "le_org_code", "le_org_name", "act_budname", *FACT_SUMS, "elimination_flag",
                "local_currency_code")
    )
