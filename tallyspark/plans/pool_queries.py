"""Registered cost-pool queries (D43-D46) with their DuckDB SQL.

The SQL lists the year-to-date amounts of every calculation and rate-posting
pool once (``ytd``); the period's amounts are those less what the same pool
had in the previous month of the year.
"""

from __future__ import annotations

from ..operators import pools as PL
from .registry import register
from .ledger_queries import MONTHS
from .sqltext import in_list, with_fixtures

FIX = ["cost_pool_group", "cost_pool_group_mle", "cost_pool", "cost_pool_group_calc", "cost_pool_group_calc_budget",
       "cost_pool_calc", "cost_pool_source_calc", "cost_pool_basis_calc", "currency_code", "customer",
       "fiscal_month", "fiscal_year", "fiscal_quarter", "budget", "budget_name"]

PERIOD_FROM, PERIOD_TO, GROUP = "FY1998-01", "FY2000-07", "Standard"
# Pools that only carry rates and are left out of the report.
EXCLUDED_POOLS = ("Materials, rates only", "Other costs, rates only", "Subcontracts, rates only", "Travel, rates only")


CTES = f"""
kept AS (
  SELECT cost_pool_group_calc_key AS calc, cost_pool_group_key AS grp, post_fiscal_month_key AS month,
         cost_pool_group_calc_key IN (SELECT cost_pool_group_calc_key FROM cost_pool_group_calc_budget) AS planned
  FROM cost_pool_group_calc WHERE (voided_timestamp, voided_by) IS NOT DISTINCT FROM (NULL, NULL)),
sums AS (
  SELECT cost_pool_calc_key, sum(amount) FILTER (side = 'pool') AS pool, sum(amount) FILTER (side = 'base') AS base
  FROM (SELECT cost_pool_calc_key, amount, 'pool' AS side FROM cost_pool_source_calc
        UNION ALL SELECT cost_pool_calc_key, amount, 'base' FROM cost_pool_basis_calc) GROUP BY ALL),
amounts AS (
  SELECT cost_pool_group_calc_key AS calc, cost_pool_key, rate, pool, base FROM cost_pool_calc LEFT JOIN sums USING (cost_pool_calc_key)),
ytd AS (
  SELECT kept.*, p.cost_pool_key, p.cost_pool_name, p.display_sequence, rate, pool, base
  FROM kept JOIN cost_pool p ON p.cost_pool_group_key = kept.grp LEFT JOIN amounts USING (calc, cost_pool_key)
  WHERE p.post_rate_to_cost_struct = 'Y'),
earlier AS (
  SELECT fiscal_month_key AS month, lag(fiscal_month_key) OVER (PARTITION BY fiscal_year_key ORDER BY begin_date) AS before FROM fiscal_month),
before AS (
  SELECT e.month, kept.grp, kept.planned, kept.calc AS was_calc FROM kept JOIN earlier e ON e.before = kept.month),
scenario AS (
  SELECT calc, 'Actual' AS name FROM kept WHERE NOT planned
  UNION ALL
  SELECT DISTINCT ON (cost_pool_group_calc_key, budget_name_key) cost_pool_group_calc_key, budget_name
  FROM cost_pool_group_calc_budget JOIN budget USING (budget_key) JOIN budget_name USING (budget_name_key)),
entities AS (
  SELECT g.cost_pool_group_key AS grp, g.cost_pool_group_name, ccy.iso_currency_code, le.customer_key, le.customer_code, le.customer_name
  FROM cost_pool_group g JOIN currency_code ccy USING (currency_code_key) JOIN cost_pool_group_mle has USING (cost_pool_group_key)
       JOIN customer le ON le.customer_key = has.legal_entity_key),
pools AS (
  SELECT m.fiscal_month_key, e.customer_key AS legal_entity_key, grp AS cost_pool_group_key, y.cost_pool_key,
         e.customer_code AS legal_entity_code, e.customer_name AS legal_entity_name, e.cost_pool_group_name, y.cost_pool_name AS cost_pool,
         s.name AS actual_or_budget, m.label AS fiscal_period, y.display_sequence,
         y.pool AS ytd_pool_amount, y.base AS ytd_base_amount, y.rate AS ytd_rate, w.pool AS prev_pool_amount, w.base AS prev_base_amount,
         y.pool - coalesce(w.pool, 0) AS curr_pool_amount, y.base - coalesce(w.base, 0) AS curr_base_amount,
         -- a period in which only one of the two was known before has no rate
         CASE WHEN (w.pool IS NULL) = (w.base IS NULL) THEN
           round(coalesce(100.0 * CAST(y.pool - coalesce(w.pool, 0) AS DOUBLE) / nullif(CAST(y.base - coalesce(w.base, 0) AS DOUBLE), 0),
                          CASE WHEN y.base - coalesce(w.base, 0) = 0 THEN 0 END), 6)
              WHEN y.base - w.base = 0 THEN 0.0 END AS curr_rate,
         e.iso_currency_code AS cost_pool_group_currency_code, y.planned
  FROM ytd y JOIN entities e USING (grp) JOIN scenario s USING (calc) JOIN {MONTHS} m ON m.fiscal_month_key = y.month
       LEFT JOIN before b USING (month, grp, planned) LEFT JOIN amounts w ON (w.calc, w.cost_pool_key) = (b.was_calc, y.cost_pool_key))"""


def pools_sql(planned: bool) -> str:
    return with_fixtures(FIX, f"SELECT * EXCLUDE (planned) FROM pools WHERE planned = {planned}", CTES)


register("d43_pool_ytd_actual", lambda lg: PL.pool_ytd(lg, PL.ACTUAL), pools_sql(False))
register("d43b_pool_ytd_budget", lambda lg: PL.pool_ytd(lg, PL.BUDGET), pools_sql(True))


#: The report's columns c0 to c17; the month's own columns come from the calendar.
REPORT = ["x.cost_pool_group_name", "x.cost_pool", "x.actual_or_budget", "m.period_number", "x.fiscal_period", "x.curr_pool_amount",
          "x.ytd_pool_amount", "x.curr_base_amount", "x.ytd_base_amount", "m.end_date", "y.end_date", "m.fiscal_month_key",
          "x.fiscal_month_key", "x.legal_entity_key", "x.cost_pool_group_key", "x.cost_pool_key", "x.display_sequence", "x.fiscal_period"]


def report_sql() -> str:
    columns = ", ".join(f"{e} AS c{i}" for i, e in enumerate(REPORT))
    return with_fixtures(FIX, f"""
SELECT {columns}
FROM pools x JOIN fiscal_month m USING (fiscal_month_key) JOIN fiscal_year y USING (fiscal_year_key)
WHERE x.fiscal_period BETWEEN '{PERIOD_FROM}' AND '{PERIOD_TO}' AND x.cost_pool_group_name = '{GROUP}'
  AND coalesce(nullif(x.actual_or_budget, ''), 'Actual') = 'Actual'
  AND coalesce(x.cost_pool, '') NOT IN ({in_list(EXCLUDED_POOLS)})""", CTES)


register("d46_cost_pool_report",
         lambda lg: PL.cost_pool_report(lg, PERIOD_FROM, PERIOD_TO, GROUP, ("Actual",), EXCLUDED_POOLS),
         report_sql())
