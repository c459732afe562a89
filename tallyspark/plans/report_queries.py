"""Registered report queries (D30-D32) with their DuckDB SQL: a fact beside its dimensions."""

from __future__ import annotations

from ..operators import reports as R
from ..params import DEFAULT as P
from .dim_queries import ACCOUNT_DIM_FIXTURES, ORG_DIM_FIXTURES, account_dim_sql, org_dim_sql
from .ledger_queries import BUDGET_FIXTURES, budget_actual_sql
from .registry import register
from .sqltext import with_fixtures

YEAR_FROM, YEAR_TO = "FY1999", "FY2000"


FIX = sorted(set(BUDGET_FIXTURES + ACCOUNT_DIM_FIXTURES + ORG_DIM_FIXTURES + ["fiscal_quarter"]))

#: The fiscal calendar: months that have a year and a quarter.
CALENDAR = """(
  SELECT fiscal_month_key, m.end_date, y.name AS fiscal_year,
         CASE WHEN period_number BETWEEN 1 AND 12 THEN concat('Q', (period_number + 2) // 3) END AS fiscal_quarter
  FROM fiscal_month m JOIN fiscal_year y USING (fiscal_year_key) SEMI JOIN fiscal_quarter q USING (fiscal_quarter_key))"""


def star_sql(fact: str, columns: dict[str, str], orgs: bool, where: str = "TRUE") -> str:
    """``columns`` (name: expression) of the fact ``f`` with its account ``a``, its month ``cal`` and, if wanted, its organization ``o``."""
    shown = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    org = f"JOIN ({org_dim_sql()}) o ON o.customer_key = f.organization_key" if orgs else ""
    return with_fixtures(FIX, f"""
SELECT {shown}
FROM ({fact}) f JOIN ({account_dim_sql()}) a USING (account_key) JOIN {CALENDAR} cal USING (fiscal_month_key) {org}
WHERE {where}""")


LEVELS = [f"acct_fin_lv{k}_{s}" for k in range(2, 7) for s in ("code", "name")]


def numbered(expressions) -> dict[str, str]:
    return {f"c{i}": e for i, e in enumerate(expressions)}


def aop_report_sql(viewer, as_of):
    facts = ["budget", "fiscal_period", "organization_key", "fiscal_month_key", "act_budname", "fin_org_code"]
    columns = ({c: f"f.{c}" for c in facts} | {c: f"a.{c}" for c in [*LEVELS, "acct_type"]}
               | {"dim_account_key": "a.account_key", "customer_key": "o.customer_key", "calendar_fiscal_month_key": "cal.fiscal_month_key"})
    return star_sql(budget_actual_sql(viewer, as_of, 36, "zero"), columns, orgs=True)


def income_statement_sql(viewer, as_of):
    columns = numbered(["f.fiscal_period", *(f"a.{c}" for c in LEVELS), "a.acct_type", "f.actual", "f.account_key", "f.organization_key",
                        "f.fiscal_month_key", "f.act_budname", "a.account_key", "o.customer_key", "cal.fiscal_month_key", "f.fin_org_code"])
    return star_sql(budget_actual_sql(viewer, as_of, 36, "null"), columns, orgs=True)


def aop_vs_actual_sql(viewer, as_of, y0, y1):
    columns = numbered(["f.act_budname", "cal.fiscal_year", "cal.fiscal_quarter", "cal.end_date", "a.acct_fin_lv5_code", "f.actual",
                        "f.budget", "a.acct_fin_lv4_code", "a.acct_fin_lv6_code", "a.acct_fin_lv1_code", "f.net_amount", "f.account_key",
                        "f.organization_key", "f.fiscal_month_key", "a.account_key", "cal.fiscal_month_key"])
    return star_sql(budget_actual_sql(viewer, as_of, 48, "null"), columns, orgs=False,
                    where=f"f.act_budname IN ('AOP', 'Actual') AND cal.fiscal_year BETWEEN '{y0}' AND '{y1}'")


register("d30_aop_report", lambda lg: R.aop_report(lg, P.viewer, P.as_of), aop_report_sql(P.viewer, P.as_of))
register("d31_income_statement", lambda lg: R.income_statement(lg, P.viewer, P.as_of),
         income_statement_sql(P.viewer, P.as_of))
register("d32_aop_vs_actual", lambda lg: R.aop_vs_actual(lg, P.viewer, P.as_of, YEAR_FROM, YEAR_TO),
         aop_vs_actual_sql(P.viewer, P.as_of, YEAR_FROM, YEAR_TO))
