"""Helpers that write the DuckDB oracle SQL.

The SQL runs over the same fixture bindings as the Spark queries.
"""

from __future__ import annotations

from ..functions.labels import (
    ACCOUNT_TYPE_NAMES,
    ACCOUNT_TYPE_ORDER,
    GL_FEATURES,
    UNKNOWN_ACCOUNT_TYPE,
    UNKNOWN_DOC_TYPE,
)
from ..sources.fixtures import duckdb_prefix


def with_fixtures(fixtures, body: str, ctes: str = "") -> str:
    prefix = duckdb_prefix(fixtures)
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {prefix}{extra}\n{body}"


def ts(as_of: str) -> str:
    return f"TIMESTAMP '{as_of}'"


def trailing_months_sql(col: str, as_of: str, n: int) -> str:
    return f"{col} >= date_trunc('month', {ts(as_of)}) - INTERVAL {n} MONTH"


def trailing_years_sql(col: str, as_of: str, n: int) -> str:
    return f"{col} >= {ts(as_of)} - INTERVAL {n} YEAR"


def decode_sql(col: str, mapping: dict, default: str | None = None) -> str:
    """The value a fixed code list gives for ``col``."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    found = f"map([{', '.join(map(lit, mapping))}], [{', '.join(map(lit, mapping.values()))}])[{col}]"
    return found if default is None else f"coalesce({found}, {lit(default)})"


def acct_type_sql(col: str) -> str:
    return decode_sql(col, ACCOUNT_TYPE_NAMES, UNKNOWN_ACCOUNT_TYPE)


def acct_type_order_sql(col: str) -> str:
    return decode_sql(col, ACCOUNT_TYPE_ORDER)


def doc_type_sql(col: str, part: int) -> str:
    return decode_sql(col, {k: v[part] for k, v in GL_FEATURES.items()}, UNKNOWN_DOC_TYPE)


def fiscal_period_sql(name: str, period: str) -> str:
    """Year name, dash, period of at least two digits; what is missing counts as empty."""
    return f"concat({name}, '-', CASE WHEN {period} < 10 THEN 0 END, {period})"


def finance_access_sql(org_expr: str, viewer: int) -> str:
    """Whether a viewer may see an organization: administrators and holders of a global grant see all, others what
    their grants name, an organization itself or all of a legal entity."""
    return f"""(
  (SELECT count(*) FROM member WHERE person_key = {viewer} AND role_key = 1)
  + (SELECT count(*) FROM org_access_person WHERE person_key = {viewer} AND role_key = 33 AND global_access = 'Y') > 0
  OR {org_expr} IN (
      SELECT c.customer_key
      FROM org_access_person g
      JOIN access_customer_view named USING (org_access_person_key)
      JOIN customer c ON named.customer_key = CASE named.legal_entity_ind WHEN 'N' THEN c.customer_key WHEN 'Y' THEN c.legal_entity_key END
      WHERE (g.person_key, g.role_key, g.access_type) = ({viewer}, 33, 2)))"""


FINANCE_ACCESS_FIXTURES = ["member", "org_access_person", "access_customer_view", "customer"]


def in_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
