"""Registered accrual queries (D39-D42, D33, D16) with their DuckDB SQL.

The SQL brings posted accruals and leave used into one table of movements
(person plan, period, hours, poster) and attaches names, rates and fiscal
periods to it once.  Whom a viewer may see is a set of persons and a set of
organizations.
"""

from __future__ import annotations

from ..operators import accruals as AC
from ..params import DEFAULT as P
from .registry import register
from .ledger_queries import MONTHS
from .sqltext import decode_sql, with_fixtures

FIX = ["accrual_plan", "accrual_period", "person_accrual_plan", "person_accrual", "person_rate", "person",
       "customer", "business_week", "task", "project", "project_type", "fiscal_month", "fiscal_year",
       "person_time", "person_time_data", "post_history", "currency_code", "member", "org_access_person",
       "approval_chain", "approval_group_submitter", "alternate", "org_access_hierarchy"]

BEGIN_UNTIL, END_UNTIL = "2024-01-10 23:59:59.997", "2024-01-20 23:59:59.997"

CTES = f"""
posted AS (
  SELECT person_accrual_plan_key, source_ind, accrual_period_key, person_key, sum(accrued_hours) AS accrued_hours,
         max(posted_timestamp) AS posted_date, arg_max(posted_by_key, (posted_timestamp, posted_by_key)) AS posted_by_key
  FROM person_accrual WHERE posted_timestamp IS NOT NULL GROUP BY ALL),
-- the months of the plans' begin and end dates; none gives an empty label
named_days AS (
  SELECT day, first(m.fiscal_month_key) AS month_key, coalesce(first(m.label), '-') AS label
  FROM (SELECT begin_date AS day FROM person_accrual_plan UNION SELECT end_date FROM person_accrual_plan)
       LEFT JOIN {MONTHS} m ON day BETWEEN m.begin_date AND m.end_date
  GROUP BY day),
enrolled AS (
  SELECT person_accrual_plan_key, accrual_plan_key, p.person_key, period.accrual_period_key,
         period.begin_date AS period_begin, period.end_date AS period_end
  FROM person_accrual_plan p JOIN accrual_plan USING (accrual_plan_key) JOIN accrual_period period USING (accrual_plan_key)),
rates AS (
  SELECT e.person_key, e.period_begin, e.period_end, max(r.cost_rate) AS person_cost_rate,
         max(r.begin_date) AS person_cost_rate_begin_date, max(r.end_date) AS person_cost_rate_end_date
  FROM (SELECT DISTINCT person_key, period_begin, period_end FROM enrolled) e
       JOIN person_rate r ON r.person_key = e.person_key AND r.begin_date <= e.period_end AND coalesce(r.end_date, r.begin_date) >= e.period_begin
  GROUP BY ALL),
moves AS (
  SELECT 'entry' AS kind, e.*, {decode_sql('source_ind', AC.TRANSACTION_TYPES)} AS transaction_type, round(accrued_hours, 3) AS hours,
         posted_date AS post_date, posted_by_key, CAST(NULL AS DATE) AS work_date
  FROM posted JOIN enrolled e USING (person_accrual_plan_key, accrual_period_key, person_key)
  UNION ALL
  SELECT 'usage', e.*, 'Used', -line.quantity, h.post_timestamp, h.posted_by_key, line.work_date
  FROM person_time_data line JOIN person_time sheet USING (person_time_key)
       JOIN person_accrual_plan own ON (own.project_key, own.person_key) = (line.project_key, sheet.person_key)
            AND line.work_date BETWEEN own.begin_date AND own.end_date AND coalesce(line.task_key = own.task_key, own.task_key IS NULL)
       JOIN enrolled e ON e.person_accrual_plan_key = own.person_accrual_plan_key AND line.work_date BETWEEN e.period_begin AND e.period_end
       SEMI JOIN person known ON known.person_key = sheet.person_key
       SEMI JOIN project run ON run.project_key = line.project_key
       LEFT JOIN post_history h USING (post_history_key)),
accruals AS (
  SELECT v.kind, plan.accrual_plan_key, who.person_key, own.project_key, own.task_key, v.accrual_period_key,
         first_day.month_key AS fiscal_month_key, org.customer_key,
         plan.accrual_plan AS accrual_plan_name, plan.description AS accrual_plan_description, plan.period_type AS accrual_plan_period_type,
         plan.begin_date AS accrual_plan_begin_date, plan.carryover_ind AS accrual_plan_carryover_type, plan.active AS accrual_plan_active,
         plan.rate_method AS accrual_plan_rate_method,
         who.last_name AS person_last_name, who.first_name AS person_first_name, who.username AS person_user_name, who.active AS person_active,
         who.hire_date AS person_hire_date, who.currency_code_key, org.customer_name AS person_org, week.hours AS person_business_week_hours,
         r.person_cost_rate, r.person_cost_rate_begin_date, r.person_cost_rate_end_date, v.transaction_type, v.hours,
         run.project_code AS accrual_plan_project_code, run.title AS accrual_plan_project_name, task.task_name AS accrual_plan_task_name,
         project_type.project_type AS accrual_plan_project_type,
         own.begin_date AS person_accrual_plan_begin_date, own.end_date AS person_accrual_plan_end_date,
         own.loa_start_date AS leave_of_absence_begin_date, own.loa_end_date AS leave_of_absence_end_date,
         v.period_begin AS accrual_period_begin_date, v.period_end AS accrual_period_end_date,
         coalesce(first_day.label, '-') AS begin_fiscal_period, coalesce(last_day.label, '-') AS ending_fiscal_period,
         v.post_date, poster.first_name AS posted_by_first_name, poster.last_name AS posted_by_last_name,
         poster.username AS posted_by_username, v.work_date
  FROM moves v JOIN person_accrual_plan own USING (person_accrual_plan_key) JOIN accrual_plan plan ON plan.accrual_plan_key = v.accrual_plan_key
       LEFT JOIN person who ON who.person_key = v.person_key
       LEFT JOIN customer org ON org.customer_key = who.customer_key
       LEFT JOIN business_week week ON week.business_week_key = who.business_week_key
       LEFT JOIN rates r ON (r.person_key, r.period_begin, r.period_end) = (who.person_key, v.period_begin, v.period_end)
       LEFT JOIN project run ON run.project_key = own.project_key
       LEFT JOIN project_type ON project_type.project_type_key = run.project_type_key
       LEFT JOIN task ON task.task_key = own.task_key
       LEFT JOIN named_days first_day ON first_day.day = own.begin_date
       LEFT JOIN named_days last_day ON last_day.day = own.end_date
       LEFT JOIN person poster ON poster.person_key = v.posted_by_key)"""


def accruals_sql(kind: str) -> str:
    return with_fixtures(FIX, f"SELECT * EXCLUDE (kind) FROM accruals WHERE kind = '{kind}'", CTES)


register("d39_accrued_hours", lambda lg: AC.accrued_hours(lg.person_accrual), with_fixtures(FIX, "SELECT * FROM posted", CTES))
register("d40_accrual_entries", lambda lg: AC.accrual_entries(lg), accruals_sql("entry"))
register("d40u_accrual_usage", lambda lg: AC.accrual_usage(lg), accruals_sql("usage"))


def numbers(values) -> str:
    return ", ".join(map(str, values))


def access_ctes(viewer: int) -> str:
    """``seen_persons`` and ``seen_orgs`` of a viewer, and the one-row ``sees`` (everything, cost rates)."""
    return f"""
stands_in_for AS (SELECT person_key, role_key FROM alternate WHERE alternate_key = {viewer}),
chains AS (
  SELECT chain_key FROM approval_chain
  WHERE person_key = {viewer} OR person_key IN (SELECT person_key FROM stands_in_for WHERE role_key = 2)),
seen_persons AS (SELECT person_key FROM approval_group_submitter WHERE approval_type IN (1, 2) AND chain_key IN (FROM chains)),
grants AS (
  SELECT org_access_person_key, global_access FROM org_access_person
  WHERE access_type = 0 AND role_key IN ({numbers(AC.ORG_ROLES)})
    AND (person_key = {viewer} OR (person_key, role_key) IN (SELECT (person_key, role_key) FROM stands_in_for))),
seen_orgs AS (SELECT customer_key FROM org_access_hierarchy SEMI JOIN grants USING (org_access_person_key)),
roles AS (SELECT role_key FROM member WHERE person_key = {viewer}),
sees AS (
  SELECT (SELECT count(*) FROM roles WHERE role_key IN ({numbers(AC.ACCRUAL_ADMIN_ROLES)}))
         + (SELECT count(*) FROM grants WHERE global_access = 'Y') > 0 AS everything,
         (SELECT count(*) FROM roles WHERE role_key IN ({numbers(AC.RATE_VIEW_ROLES)})) > 0 AS rates_too)"""


def report_sql(viewer: int, d1: str, d2: str) -> str:
    shown = ", ".join(f"{f'CASE WHEN sees.rates_too THEN {c} END' if c.startswith('person_cost_rate') else c} AS c{i}"
                      for i, c in enumerate(AC.REPORT_COLUMNS))
    return with_fixtures(FIX, f"""
SELECT {shown}
FROM accruals SEMI JOIN currency_code USING (currency_code_key), sees
WHERE person_active = 'Y' AND (accrual_period_begin_date <= TIMESTAMP '{d1}' OR accrual_period_end_date <= TIMESTAMP '{d2}')
  AND (sees.everything OR person_key IN (FROM seen_persons) OR customer_key IN (FROM seen_orgs))""", f"{CTES},{access_ctes(viewer)}")


register("d42_accrual_report", lambda lg: AC.accrual_report(lg, P.viewer, BEGIN_UNTIL, END_UNTIL),
         report_sql(P.viewer, BEGIN_UNTIL, END_UNTIL))


def _pairs(lg):
    from pyspark.sql import functions as F
    p = lg.person_accrual_plan.select("accrual_plan_key", "person_key")
    a = lg.accrual_period.select("accrual_plan_key", F.col("begin_date").alias("period_begin"),
                                 F.col("end_date").alias("period_end"))
    return p.join(a, "accrual_plan_key").select("person_key", "period_begin", "period_end")


register("d41_rate_for_period", lambda lg: AC.rate_for_period(lg.person_rate, _pairs(lg)),
         with_fixtures(FIX, "SELECT * FROM rates", CTES))
