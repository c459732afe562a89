"""Leave accruals: posted balances (D39), entries (D40), usage (D40u), rate in effect (D41),
report (D42) with the approval-chain filter (D33) and rate masking (D16).

* D39 is one ``groupBy`` with partial aggregation: SUM of hours, and the
  latest poster by ``max_by`` over (timestamp, poster key) -- the reference's
  ROW_NUMBER has no tie-breaker, the poster key is added as one.
* D41 replaces three correlated scalar subqueries (one per column) with one
  overlap join per person, then one ``groupBy`` per distinct (person, period)
  -- computed once and joined back by key.  A person with many rates and many
  periods meets only those that lie close to each other.
* Usage rows find their accrual period by an interval lookup within the plan;
  the person-plan match is an equi join on (project, person) with the date
  range and the task wildcard (J14) as residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import concat_nn, fiscal_period
from .access import has_any_role, mask
from .intervals import interval_lookup, overlap_join

# Accrual source codes and their transaction types.
TRANSACTION_TYPES = {"I": "Initial", "A": "Adjustment", "P": "Posted", "U": "Unposted", "C": "Carry-Over",
                     "T": "Transfer"}
RATE_VIEW_ROLES = (1, 10, 11, 21)
ACCRUAL_ADMIN_ROLES = (1, 21)
ORG_ROLES = (2, 7, 11)

ACCRUAL_KEYS = ["person_accrual_plan_key", "source_ind", "accrual_period_key", "person_key"]


def accrued_hours(person_accrual: DataFrame) -> DataFrame:
    """Posted accruals summed per (plan, source, period, person) with the latest poster."""
    return person_accrual.filter(F.col("posted_timestamp").isNotNull()).groupBy(*ACCRUAL_KEYS).agg(
        F.sum("accrued_hours").alias("accrued_hours"),
        F.max("posted_timestamp").alias("posted_date"),
        F.max_by("posted_by_key", F.struct("posted_timestamp", "posted_by_key")).alias("posted_by_key"),
    )


def rate_for_period(person_rate: DataFrame, periods: DataFrame, person="person_key",
                    begin="period_begin", end="period_end") -> DataFrame:
    """Per (person, period), max rate / begin / end over rates overlapping the period.

    Overlap = rate begins in the period, or ends in it, or strictly spans it.
    The three maxima are independent and may come from different rate rows.
    """
    p = periods.select(person, begin, end).distinct()
    r = person_rate.select(F.col("person_key").alias(person), F.col("begin_date").alias("_rb"),
                           F.col("end_date").alias("_re"), "cost_rate")
    pb, pe = F.col(begin), F.col(end)
    # a rate with one bound counts where that lies; one that ends before it begins counts at both ends
    span = lambda df, b, e, name: df.withColumns({f"{name}0": F.least(b, e), f"{name}1": F.greatest(b, e)})
    overlap = (F.col("_rb").between(pb, pe) | F.col("_re").between(pb, pe)
               | ((F.col("_rb") < pb) & (F.col("_re") > pe)))
    p, r = span(p, begin, end, "_p"), span(r, "_rb", "_re", "_r")
    met = overlap_join(p, r, [person], ("_p0", "_p1"), ("_r0", "_r1"))
    return (met.filter(overlap).groupBy(person, begin, end)
            .agg(F.max("cost_rate").alias("person_cost_rate"), F.max("_rb").alias("person_cost_rate_begin_date"),
                 F.max("_re").alias("person_cost_rate_end_date")))


def _months(lg) -> DataFrame:
    # left join to the year: the label is built after the month lookup, so a
    # missing month still gives the reference's NULL-tolerant label "-"
    fy = lg.fiscal_year.select("fiscal_year_key", F.col("name").alias("_fy"))
    return lg.fiscal_month.join(F.broadcast(fy), "fiscal_year_key", "left").select(
        "fiscal_month_key", "begin_date", "end_date", "_fy", "period_number")


def _decorate(lg, df: DataFrame) -> DataFrame:
    """Lookups shared by entries and usage: person, org, week, project, task, fiscal periods."""
    per = lg.person.select("person_key", F.col("person_key").alias("_per_key"), "last_name", "first_name",
                           "username", "active", "hire_date", F.col("customer_key").alias("_porg"),
                           "business_week_key", "currency_code_key")
    porg = lg.customer.select(F.col("customer_key").alias("_porg"), F.col("customer_key").alias("_porg_key"),
                              F.col("customer_name").alias("person_org"))
    bw = lg.business_week.select("business_week_key", F.col("hours").alias("person_business_week_hours"))
    prj = lg.project.select("project_key", F.col("project_code").alias("accrual_plan_project_code"),
                            F.col("title").alias("accrual_plan_project_name"), "project_type_key")
    pt = lg.project_type.select("project_type_key", F.col("project_type").alias("accrual_plan_project_type"))
    task = lg.task.select("task_key", F.col("task_name").alias("accrual_plan_task_name"))
    months = _months(lg)
    fm_b = months.select(F.col("fiscal_month_key").alias("_fm_b"), F.col("_fy").alias("_fy_b"),
                         F.col("period_number").alias("_pn_b"), "begin_date", "end_date")
    fm_e = months.select(F.col("_fy").alias("_fy_e"), F.col("period_number").alias("_pn_e"), "begin_date", "end_date")
    df = (df.join(per, "person_key", "left").join(porg, "_porg", "left").join(bw, "business_week_key", "left")
          .join(task, "task_key", "left").join(prj, "project_key", "left"))
    df = (df.join(pt, "project_type_key", "left")
          .transform(lambda d: interval_lookup(d, "pap_begin", fm_b, ["_fm_b", "_fy_b", "_pn_b"], "left"))
          .transform(lambda d: interval_lookup(d, "pap_end", fm_e, ["_fy_e", "_pn_e"], "left")))
    return (df.withColumn("begin_fiscal_period", fiscal_period("_fy_b", "_pn_b"))
            .withColumn("ending_fiscal_period", fiscal_period("_fy_e", "_pn_e")))


COLUMNS = [
    "accrual_plan_key", "person_key", "project_key", "task_key", "accrual_period_key", "fiscal_month_key",
    "customer_key", "accrual_plan_name", "accrual_plan_description", "accrual_plan_period_type",
    "accrual_plan_begin_date", "accrual_plan_carryover_type", "accrual_plan_active", "accrual_plan_rate_method",
    "person_last_name", "person_org", "person_user_name", "person_first_name", "person_active",
    "person_cost_rate", "person_cost_rate_begin_date", "person_cost_rate_end_date", "person_business_week_hours",
    "person_hire_date", "transaction_type", "hours", "accrual_plan_project_code", "accrual_plan_project_name",
    "accrual_plan_task_name", "accrual_plan_project_type", "person_accrual_plan_begin_date",
    "person_accrual_plan_end_date", "leave_of_absence_begin_date", "leave_of_absence_end_date",
    "accrual_period_begin_date", "accrual_period_end_date", "begin_fiscal_period", "ending_fiscal_period",
    "post_date", "posted_by_first_name", "posted_by_last_name", "posted_by_username", "work_date",
    "currency_code_key",
]


def _finish(lg, df: DataFrame, transaction_type: Column, hours: Column, post_date: Column, work_date: Column):
    rates = rate_for_period(lg.person_rate, df.select(F.col("_per_key").alias("person_key"),
                                                      F.col("period_begin"), F.col("period_end")))
    df = df.join(rates.withColumnRenamed("person_key", "_per_key"), ["_per_key", "period_begin", "period_end"], "left")
    return df.select(
        "accrual_plan_key", F.col("_per_key").alias("person_key"), "project_key", "task_key", "accrual_period_key",
        F.col("_fm_b").alias("fiscal_month_key"), F.col("_porg_key").alias("customer_key"),
        F.col("accrual_plan").alias("accrual_plan_name"), F.col("ap_description").alias("accrual_plan_description"),
        F.col("period_type").alias("accrual_plan_period_type"), F.col("ap_begin").alias("accrual_plan_begin_date"),
        F.col("carryover_ind").alias("accrual_plan_carryover_type"), F.col("ap_active").alias("accrual_plan_active"),
        F.col("rate_method").alias("accrual_plan_rate_method"), F.col("last_name").alias("person_last_name"),
        "person_org", F.col("username").alias("person_user_name"), F.col("first_name").alias("person_first_name"),
        F.col("active").alias("person_active"), "person_cost_rate", "person_cost_rate_begin_date",
        "person_cost_rate_end_date", "person_business_week_hours", F.col("hire_date").alias("person_hire_date"),
        transaction_type.alias("transaction_type"), hours.alias("hours"), "accrual_plan_project_code",
        "accrual_plan_project_name", "accrual_plan_task_name", "accrual_plan_project_type",
        F.col("pap_begin").alias("person_accrual_plan_begin_date"), F.col("pap_end").alias("person_accrual_plan_end_date"),
        F.col("loa_start_date").alias("leave_of_absence_begin_date"),
        F.col("loa_end_date").alias("leave_of_absence_end_date"),
        F.col("period_begin").alias("accrual_period_begin_date"), F.col("period_end").alias("accrual_period_end_date"),
        "begin_fiscal_period", "ending_fiscal_period", post_date.alias("post_date"),
        F.col("pb_first").alias("posted_by_first_name"), F.col("pb_last").alias("posted_by_last_name"),
        F.col("pb_user").alias("posted_by_username"), work_date.alias("work_date"), "currency_code_key",
    )


def _plans(lg) -> DataFrame:
    return lg.accrual_plan.select("accrual_plan_key", "accrual_plan", F.col("description").alias("ap_description"),
                                  "period_type", F.col("begin_date").alias("ap_begin"), "carryover_ind",
                                  F.col("active").alias("ap_active"), "rate_method")


def _paps(lg) -> DataFrame:
    return lg.person_accrual_plan.select("person_accrual_plan_key", "accrual_plan_key", "person_key", "project_key",
                                         "task_key", F.col("begin_date").alias("pap_begin"),
                                         F.col("end_date").alias("pap_end"), "loa_start_date", "loa_end_date")


def _periods(lg) -> DataFrame:
    return lg.accrual_period.select("accrual_period_key", "accrual_plan_key", F.col("begin_date").alias("period_begin"),
                                    F.col("end_date").alias("period_end"))


def _posters(lg, key: str) -> DataFrame:
    return lg.person.select(F.col("person_key").alias(key), F.col("first_name").alias("pb_first"),
                            F.col("last_name").alias("pb_last"), F.col("username").alias("pb_user"))


def accrual_entries(lg) -> DataFrame:
    """Posted accrual hours per person plan and period with all lookups."""
    ah = accrued_hours(lg.person_accrual)
    df = (ah.join(_paps(lg), ["person_accrual_plan_key", "person_key"])
          .join(_periods(lg), ["accrual_period_key", "accrual_plan_key"])
          .join(_plans(lg), "accrual_plan_key")
          .join(_posters(lg, "posted_by_key"), "posted_by_key", "left"))
    df = _decorate(lg, df)
    decode = None
    for k, v in TRANSACTION_TYPES.items():
        decode = F.when(F.col("source_ind") == k, v) if decode is None else decode.when(F.col("source_ind") == k, v)
    return _finish(lg, df, decode, F.round("accrued_hours", 3), F.col("posted_date"),
                   F.lit(None).cast("date"))


def accrual_usage(lg) -> DataFrame:
    """D40u: leave used, from timesheet lines inside a person plan's dates and an accrual period."""
    ptd = lg.person_time_data.select("time_data_key", "person_time_key", F.col("project_key"),
                                     F.col("task_key").alias("_line_task"), "work_date", "quantity",
                                     "post_history_key")
    lines = ptd.join(lg.person_time.select("person_time_key", "person_key"), "person_time_key")
    pap = _paps(lg)
    cond = ((lines.project_key == pap.project_key) & (lines.person_key == pap.person_key)
            & lines.work_date.between(pap.pap_begin, pap.pap_end)
            & (pap.task_key.isNull() | (lines._line_task == pap.task_key)))
    df = lines.join(pap, cond).drop(lines.project_key).drop(lines.person_key)
    periods = _periods(lg).withColumns({"_begins": F.col("period_begin"), "_ends": F.col("period_end")})
    df = (df.join(_plans(lg), "accrual_plan_key")
          .transform(lambda d: interval_lookup(d, "work_date", periods, ["accrual_period_key", "period_begin", "period_end"],
                                               begin="_begins", end="_ends", on=["accrual_plan_key"]))
          .join(lg.person.select("person_key"), "person_key")            # inner: person must exist
          .join(lg.project.select("project_key"), "project_key")        # inner: project must exist
          .join(lg.post_history.select("post_history_key", "posted_by_key", "post_timestamp"),
                "post_history_key", "left")
          .join(_posters(lg, "posted_by_key"), "posted_by_key", "left"))
    df = _decorate(lg, df)
    return _finish(lg, df, F.lit("Used"), -F.col("quantity"), F.col("post_timestamp"), F.col("work_date"))


def accrual_approval_grants(lg, viewer: int):
    """D33 grants: (flag column, visible person keys, visible org keys)."""
    m, oap, alt = lg.member, lg.org_access_person, lg.alternate
    chain, sub = lg.approval_chain, lg.approval_group_submitter.filter(F.col("approval_type").isin(1, 2))
    direct = chain.filter(F.col("person_key") == F.lit(viewer)).select("chain_key")
    via_alt = (alt.filter((F.col("alternate_key") == F.lit(viewer)) & (F.col("role_key") == 2))
               .join(chain, "person_key").select("chain_key"))
    persons = sub.join(direct.unionByName(via_alt), "chain_key").select("person_key")
    org_oap = oap.filter((F.col("access_type") == 0) & F.col("role_key").isin(*ORG_ROLES))
    own = org_oap.filter(F.col("person_key") == F.lit(viewer))
    alt_of = org_oap.join(alt.filter(F.col("alternate_key") == F.lit(viewer)).select("person_key", "role_key"),
                          ["person_key", "role_key"])
    flag = (has_any_role(m, viewer, ACCRUAL_ADMIN_ROLES)
            | own.filter(F.col("global_access") == "Y").exists()
            | alt_of.filter(F.col("global_access") == "Y").exists())
    orgs = (lg.org_access_hierarchy.join(own.select("org_access_person_key")
                                         .unionByName(alt_of.select("org_access_person_key")),
                                         "org_access_person_key").select("customer_key"))
    return flag, persons, orgs


def filter_accrual_access(lg, df: DataFrame, person_col: str, org_col: str, viewer: int) -> DataFrame:
    flag, persons, orgs = accrual_approval_grants(lg, viewer)
    return df.filter(flag | F.col(person_col).isin(persons) | F.col(org_col).isin(orgs))


REPORT_COLUMNS = [
    "accrual_plan_name", "person_user_name", "person_hire_date", "person_last_name", "person_first_name",
    "person_cost_rate_begin_date", "person_cost_rate_end_date", "person_cost_rate", "accrual_period_end_date",
    "person_accrual_plan_end_date", "hours", "transaction_type", "accrual_plan_key", "person_key", "project_key",
    "task_key", "accrual_period_key", "accrual_period_begin_date", "person_active", "person_org",
]


def accrual_report(lg, viewer: int, begin_until: str, end_until: str, active=("Y",)) -> DataFrame:
    """Entries and usage, masked rates, approval-chain filter, date/active filter, c0..c19 sorted."""
    t = accrual_entries(lg).unionByName(accrual_usage(lg))
    cc = lg.currency_code.select(F.col("currency_code_key"), F.col("iso_currency_code").alias("_ccy"))
    t = t.join(F.broadcast(cc), "currency_code_key")  # inner: persons without a currency drop out
    can_see = has_any_role(lg.member, viewer, RATE_VIEW_ROLES)
    t = t.select(*[mask(F.col(c), can_see).alias(c) if c.startswith("person_cost_rate") else F.col(c)
                   for c in COLUMNS], mask(F.col("_ccy"), can_see).alias("cost_rate_currency"))
    t = filter_accrual_access(lg, t, "person_key", "customer_key", viewer)
    t = t.filter(
        ((F.col("accrual_period_begin_date") <= F.lit(begin_until).cast("timestamp_ntz"))
         | (F.col("accrual_period_end_date") <= F.lit(end_until).cast("timestamp_ntz")))
        & F.col("person_active").isin(*active))
    out = t.select(*REPORT_COLUMNS, concat_nn("person_last_name", F.lit(","), F.lit(" "), "person_first_name")
                   .alias("_name"))
    return (out.orderBy(F.col("accrual_plan_name").asc(), F.col("person_user_name").asc(), F.col("_name").asc(),
                        F.col("person_cost_rate_end_date").desc(), F.col("accrual_period_end_date").desc())
            .drop("_name").toDF(*[f"c{i}" for i in range(len(REPORT_COLUMNS))]))
