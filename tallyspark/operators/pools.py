"""Cost pools: YTD amounts (D43), YTD -> period decumulation (D44), rates (D45), report.

Each calc row lists every rate-posting pool of its group; source and basis
amounts are summed per pool calc before joining (partial aggregation).  The
"previous" amounts come from the calcs of the *previous month of the same
fiscal year*, found by key on the calendar (``prev_month_key`` restricted to
the same year) and joined on (group, month) -- several calcs in a month fan
out exactly as the reference's join does, which a ``lag`` could not express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import blank_or_in
from .calendar import fiscal_calendar

ACTUAL = "actual"
BUDGET = "budget"


def _calc_amounts(lg) -> DataFrame:
    src = lg.cost_pool_source_calc.groupBy("cost_pool_calc_key").agg(F.sum("amount").alias("pool_amt"))
    bas = lg.cost_pool_basis_calc.groupBy("cost_pool_calc_key").agg(F.sum("amount").alias("base_amt"))
    return (lg.cost_pool_calc.select("cost_pool_calc_key", "cost_pool_group_calc_key", "cost_pool_key", "rate")
            .join(src, "cost_pool_calc_key", "left").join(bas, "cost_pool_calc_key", "left"))


def _calcs(lg, kind: str) -> DataFrame:
    """Non-voided group calcs: actual = no budget link (anti join), budget = has one (semi join)."""
    c = lg.cost_pool_group_calc.filter(F.col("voided_timestamp").isNull() & F.col("voided_by").isNull())
    links = lg.cost_pool_group_calc_budget.select("cost_pool_group_calc_key")
    return c.join(links, "cost_pool_group_calc_key", "left_anti" if kind == ACTUAL else "left_semi")


def rate(pool: Column, base: Column) -> Column:
    """round(100 * pool / base, 6) with a zero base giving 0 (D45); DOUBLE arithmetic."""
    p, b = pool.cast("double"), base.cast("double")
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(F.lit(100.0) * p / b), 6)


def pool_ytd(lg, kind: str = ACTUAL) -> DataFrame:
    """D43 + D44 + D45: YTD and period pool/base amounts and rates per calc and pool."""
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year).select(
        "fiscal_month_key", "fiscal_period",
        F.when(F.col("prev_fiscal_year_key") == F.col("fiscal_year_key"), F.col("prev_month_key"))
        .alias("_prev_month"))
    cpg = lg.cost_pool_group.join(
        lg.currency_code.select("currency_code_key", F.col("iso_currency_code").alias("cost_pool_group_currency_code")),
        "currency_code_key")
    le = lg.customer.select(F.col("customer_key").alias("legal_entity_key"),
                            F.col("customer_code").alias("legal_entity_code"),
                            F.col("customer_name").alias("legal_entity_name"))
    cp = lg.cost_pool.filter(F.col("post_rate_to_cost_struct") == "Y").select(
        "cost_pool_key", "cost_pool_group_key", F.col("cost_pool_name").alias("cost_pool"), "display_sequence")
    calcs = _calcs(lg, kind).select("cost_pool_group_calc_key", "cost_pool_group_key",
                                    F.col("post_fiscal_month_key").alias("fiscal_month_key"))
    amounts = _calc_amounts(lg)
    df = (cpg.join(lg.cost_pool_group_mle, "cost_pool_group_key").join(le, "legal_entity_key")
          .join(calcs, "cost_pool_group_key").join(F.broadcast(cal), "fiscal_month_key")
          .join(cp, "cost_pool_group_key")
          .join(amounts, ["cost_pool_group_calc_key", "cost_pool_key"], "left"))
    if kind == BUDGET:
        names = (lg.cost_pool_group_calc_budget.join(lg.budget, "budget_key")
                 .select("cost_pool_group_calc_key", "budget_name_key").distinct()
                 .join(lg.budget_name, "budget_name_key")
                 .select("cost_pool_group_calc_key", F.col("budget_name").alias("actual_or_budget")))
        df = df.join(names, "cost_pool_group_calc_key")
    else:
        df = df.withColumn("actual_or_budget", F.lit("Actual"))
    prev_calcs = calcs.select(F.col("cost_pool_group_calc_key").alias("_pcalc"), "cost_pool_group_key",
                              F.col("fiscal_month_key").alias("_prev_month"))
    prev_amounts = amounts.select(F.col("cost_pool_group_calc_key").alias("_pcalc"), "cost_pool_key",
                                  F.col("pool_amt").alias("prev_pool_amount"),
                                  F.col("base_amt").alias("prev_base_amount"))
    df = (df.join(prev_calcs, ["cost_pool_group_key", "_prev_month"], "left")
          .join(prev_amounts, ["_pcalc", "cost_pool_key"], "left"))
    pool, base = F.col("pool_amt"), F.col("base_amt")
    ppool, pbase = F.col("prev_pool_amount"), F.col("prev_base_amount")
    curr_rate = F.when(ppool.isNull() & pbase.isNull(), rate(pool, base)).otherwise(rate(pool - ppool, base - pbase))
    return df.select(
        "fiscal_month_key", "legal_entity_key", "cost_pool_group_key", "cost_pool_key", "legal_entity_code",
        "legal_entity_name", "cost_pool_group_name", "cost_pool", "actual_or_budget", "fiscal_period",
        "display_sequence", pool.alias("ytd_pool_amount"), base.alias("ytd_base_amount"),
        F.col("rate").alias("ytd_rate"), "prev_pool_amount", "prev_base_amount",
        F.when(ppool.isNull(), pool).otherwise(pool - ppool).alias("curr_pool_amount"),
        F.when(pbase.isNull(), base).otherwise(base - pbase).alias("curr_base_amount"),
        curr_rate.alias("curr_rate"), "cost_pool_group_currency_code",
    )


def cost_pool_report(lg, period_from: str, period_to: str, group: str, names=("Actual",),
                     exclude=()) -> DataFrame:
    """Actual and budget pool rows for a fiscal-period label range, c0..c17, sorted."""
    x = pool_ytd(lg, ACTUAL).unionByName(pool_ytd(lg, BUDGET))
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year).select(
        F.col("fiscal_month_key").alias("cal_key"), F.col("period_number").alias("cal_month"),
        F.col("end_date").alias("cal_month_end"), F.col("fiscal_year_end_date").alias("cal_year_end"),
        F.col("fiscal_period").alias("cal_period"))
    df = x.join(F.broadcast(cal), x.fiscal_month_key == cal.cal_key)
    df = df.filter(
        F.col("cal_period").between(period_from, period_to)
        & (F.col("cost_pool_group_name") == group)
        & blank_or_in("actual_or_budget", list(names))
        & (~F.col("cost_pool").isin(*exclude) | F.col("cost_pool").isNull() if exclude else F.lit(True)))
    out = df.select(
        "cost_pool_group_name", "cost_pool", "actual_or_budget", "cal_month", "fiscal_period",
        "curr_pool_amount", "ytd_pool_amount", "curr_base_amount", "ytd_base_amount", "cal_month_end",
        "cal_year_end", "cal_key", "fiscal_month_key", "legal_entity_key", "cost_pool_group_key",
        "cost_pool_key", "display_sequence", "cal_period",
    ).toDF(*[f"c{i}" for i in range(18)])
    return out.orderBy(F.col("c0").asc(), F.col("c16").asc(), F.col("c1").asc(), F.col("c9").desc())
