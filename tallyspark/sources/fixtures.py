"""Ledger tables bound to the driver's TPC-H-style parquet tables.

The reference reads ~110 tables of a project-accounting schema.  The test
data holds TPC-H-style tables instead, so each ledger table is a *view*
derived from them.  Every binding is a single SQL text that runs unchanged in
Spark (``spark.sql(text, **frames)``) and in DuckDB (as a ``WITH`` prefix of
the oracle queries), so both engines read the same derived rows.

Every binding is a projection/filter/union over one driver table (plus tiny
literal tables such as the 3-row currency list).  None of them joins two large
driver tables, so a binding costs one scan of its source.
"""

from __future__ import annotations

import functools
import hashlib
import posixpath
import threading
from dataclasses import dataclass

from ..session import ensure_checkpoint_dir
from .store import TableStore
from .tables import load

# Money derived from DOUBLE columns is cast to DECIMAL first and multiplied in
# decimals: a double product cast to DECIMAL rounds half cases differently in
# Spark (via the shortest decimal string) and DuckDB (exact binary value).

# Fixed values of the bindings (years of the fiscal calendar, currency list,
# grant assignments).  They define the synthetic ERP, not query parameters.
FISCAL_YEARS = [*range(1995, 2003), 2024]  # the ledger's years and the one of the time entries
CURRENCIES = [(1, "USD", 2), (2, "EUR", 2), (3, "JPY", 0)]


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"(values {body}) t({', '.join(cols)})"


def _lit(v):
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


@dataclass(frozen=True)
class Binding:
    name: str
    deps: tuple[str, ...]
    sql: str  # uses {dep} placeholders for every dependency


def _month_rows():
    return [(y, m, (m - 1) // 3 + 1) for y in FISCAL_YEARS for m in range(1, 13)]


def _quarter_rows():
    return [(y, q) for y in FISCAL_YEARS for q in range(1, 5)]


BINDINGS: dict[str, Binding] = {}


USER_FIELDS = [f"user{i:02d}" for i in range(1, 21)]


def _bind(name, deps, sql):
    BINDINGS[name] = Binding(name, tuple(deps), sql)


# --- calendar ---------------------------------------------------------------
_bind("fiscal_year", [], f"""
select y as fiscal_year_key, concat('FY', cast(y as string)) as name,
       make_date(y, 1, 1) as begin_date, make_date(y, 12, 31) as end_date
from {_values([(y,) for y in FISCAL_YEARS], ['y'])}""")

_bind("fiscal_quarter", [], f"""
select y * 10 + q as fiscal_quarter_key, y as fiscal_year_key,
       make_date(y, 3 * q - 2, 1) as begin_date,
       last_day(make_date(y, 3 * q, 1)) as end_date
from {_values(_quarter_rows(), ['y', 'q'])}""")

_bind("fiscal_month", [], f"""
select y * 100 + m as fiscal_month_key, y as fiscal_year_key,
       y * 10 + q as fiscal_quarter_key, m as period_number,
       make_date(y, m, 1) as begin_date, last_day(make_date(y, m, 1)) as end_date
from {_values(_month_rows(), ['y', 'm', 'q'])}""")

_bind("currency_code", [], f"""
select currency_code_key, iso_currency_code, decimals
from {_values(CURRENCIES, ['currency_code_key', 'iso_currency_code', 'decimals'])}""")

# --- organizations (customer table, role-playing) ---------------------------
_bind("customer", ["region", "nation", "supplier"], """
select 1000 + r_regionkey as customer_key, concat('R', cast(r_regionkey as string)) as customer_code,
       r_name as customer_name, cast(null as bigint) as legal_entity_key,
       cast(1 as bigint) as currency_code_key, cast(1 as bigint) as customer_type_key,
       'N' as transact_elimination_flag, cast(null as bigint) as default_gl_post_org_key
from {region}
union all
select 2000 + n_nationkey, concat('N', cast(n_nationkey as string)), n_name,
       cast(1000 + n_regionkey as bigint), cast(1 + n_nationkey % 3 as bigint), cast(2 as bigint),
       case when n_nationkey % 5 = 0 then 'Y' else 'N' end, cast(null as bigint)
from {nation}
union all
select 10000 + s_suppkey, concat('S', cast(s_suppkey as string)), s_name,
       cast(2000 + s_nationkey as bigint), cast(1 + s_suppkey % 3 as bigint), cast(3 as bigint),
       'N', cast(2000 + s_nationkey as bigint)
from {supplier}""")



def _widen(name: str, key: str, columns: dict[str, str]) -> None:
    """Adds columns derived from the key to a binding; what a query does not read is pruned."""
    b = BINDINGS[name]
    extra = ",\n       ".join(f"{e} as {c}" for c, e in columns.items())
    BINDINGS[name] = Binding(name, b.deps, f"select b.*, {extra}\nfrom ({b.sql}) b")


def _yes_no(names, key: str) -> dict[str, str]:
    return {c: f"case when {key} % {2 + i % 4} = 0 then 'Y' else 'N' end" for i, c in enumerate(names)}


def _texts(names, key: str) -> dict[str, str]:
    return {c: f"case when {key} % {5 + i % 3} <> 0 then concat('{c} ', cast({key} % {3 + i} as string)) end" for i, c in enumerate(names)}


def _money(names, key: str) -> dict[str, str]:
    return {c: f"case when {key} % {4 + i % 3} <> 1 then cast({key} * {3 + i} + {100 * (1 + i)} as decimal(18,2)) end" for i, c in enumerate(names)}


_widen("customer", "customer_key", _yes_no(["vendor_1099", "financial_org", "legal_entity", "active", "entry_allowed"], "customer_key")
       | _texts(["email_1099", "recipient_name_1099", "federal_tax_id", "federal_tax_id_type", "classification", "account_number",
                 "industry", "sic_code", "sector", "customer_size", "stock_symbol"] + USER_FIELDS, "customer_key")
       | {"begin_date": "make_date(1995, cast(1 + customer_key % 12 as int), 1)",
          "end_date": "case when customer_key % 6 = 0 then make_date(2001, cast(1 + customer_key % 12 as int), 28) end"})

_bind("customer_type", [], f"""
select customer_type_key, customer_type
from {_values([(1, 'Region'), (2, 'Legal Entity'), (3, 'Department')], ['customer_type_key', 'customer_type'])}""")

# --- accounts ---------------------------------------------------------------
# 40 posting accounts from part, plus one header account per type (keys 100..103)
# that roots the account trees.
_bind("account", ["part"], """
select distinct p_partkey % 40 as account_key,
       concat('A', cast(p_partkey % 40 as string)) as account_code,
       concat('Account ', cast(p_partkey % 40 as string)) as description,
       case p_partkey % 4 when 0 then 'A' when 1 then 'L' when 2 then 'R' else 'E' end as type
from {part}
union all
select k, concat('H', cast(k - 100 as string)), concat('Header ', t), t
from (values (100, 'A'), (101, 'L'), (102, 'R'), (103, 'E')) h(k, t)""")

_bind("cashflow_account", ["account"], """
select account_key as cashflow_account_key,
       case when account_key % 7 = 0 then cast(null as bigint) else account_key - account_key % 4 end
         as rollup_account_key,
       case account_key % 5 when 0 then 'O' when 1 then 'I' when 2 then 'F' when 3 then 'C' else 'X' end
         as category
from {account} where account_key < 100""")

# --- general ledger -----------------------------------------------------------
_bind("general_ledger", ["lineitem"], """
select l_orderkey * 10 + l_linenumber as general_ledger_key,
       l_partkey % 40 as account_key,
       10000 + l_suppkey as organization_key,
       cast(year(l_shipdate) * 100 + month(l_shipdate) as bigint) as fiscal_month_key,
       case when l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2))
            else cast(0 as decimal(18,2)) end as debit_amount,
       case when l_linestatus = 'O' then cast(0 as decimal(18,2))
            else cast(l_extendedprice as decimal(18,2)) end as credit_amount,
       case when l_linestatus = 'O' then cast(l_extendedprice as decimal(18,2))
            else cast(0 as decimal(18,2)) end as local_debit_amount,
       case when l_linestatus = 'O' then cast(0 as decimal(18,2))
            else cast(l_extendedprice as decimal(18,2)) end as local_credit_amount,
       cast(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as bigint) as transaction_currency,
       cast(1 as bigint) as local_currency,
       l_linenumber as feature,
       cast(l_shipdate as date) as post_date,
       cast(l_shipdate as date) as transaction_date,
       10000 + l_suppkey as customer_key,
       l_partkey % 10 as project_key,
       l_suppkey % 150 as person_key,
       concat('Line ', cast(l_linenumber as string)) as description,
       cast(l_orderkey as string) as document_number,
       concat(l_returnflag, l_linestatus) as reference,
       cast(l_quantity as decimal(18,6)) as quantity
from {lineitem}""")

# --- trees (nested sets) ------------------------------------------------------
# Visit numbers leave ten for each supplier key that exists, so a nation's
# interval holds all its suppliers however many there are.
_SPAN = "(select cast(10 * (max(s_suppkey) + 2) as bigint) from {supplier})"

_bind("org_tree", ["region", "nation", "supplier"], """
select cast(1000 + r_regionkey as bigint) as node_key, 0 as tree_level,
       100 * r_regionkey * SPAN as left_visit, 100 * (r_regionkey + 1) * SPAN - 1 as right_visit
from {region}
union all
select cast(2000 + n_nationkey as bigint), 1, (100 * n_regionkey + n_nationkey + 1) * SPAN,
       (100 * n_regionkey + n_nationkey + 2) * SPAN - 1
from {nation}
union all
select cast(10000 + s_suppkey as bigint), 2, (100 * n_regionkey + n_nationkey + 1) * SPAN + s_suppkey * 10 + 1,
       (100 * n_regionkey + n_nationkey + 1) * SPAN + s_suppkey * 10 + 2
from {supplier} join {nation} on n_nationkey = s_nationkey""".replace("SPAN", _SPAN))

# Financial org tree: nations are roots, regions are missing from it.
_bind("org_fin_tree", ["nation", "supplier"], """
select cast(2000 + n_nationkey as bigint) as node_key, 0 as tree_level,
       n_nationkey * SPAN as left_visit, (n_nationkey + 1) * SPAN - 1 as right_visit
from {nation}
union all
select cast(10000 + s_suppkey as bigint), 1, s_nationkey * SPAN + s_suppkey * 10 + 1, s_nationkey * SPAN + s_suppkey * 10 + 2
from {supplier}""".replace("SPAN", _SPAN))

# Cost-pool org tree: suppliers directly under their region (nations skipped).
_bind("org_cost_pool_tree", ["region", "nation", "supplier"], """
select cast(1000 + r_regionkey as bigint) as node_key, 0 as tree_level,
       r_regionkey * SPAN as left_visit, (r_regionkey + 1) * SPAN - 1 as right_visit
from {region}
union all
select cast(10000 + s_suppkey as bigint), 1, n_regionkey * SPAN + s_suppkey * 10 + 1, n_regionkey * SPAN + s_suppkey * 10 + 2
from {supplier} join {nation} on n_nationkey = s_nationkey""".replace("SPAN", _SPAN))

_bind("org_consolidation_tree", ["org_tree"], "select * from {org_tree}")

# Financial account tree: type headers (level 0), accounts 0..19 (level 1),
# accounts 20..38 under account k-20 (level 2); account 39 is missing.
_bind("acct_fin_tree", ["account"], """
select account_key as node_key, 0 as tree_level,
       cast(account_key - 100 as bigint) * 10000 as left_visit,
       cast(account_key - 100 as bigint) * 10000 + 9999 as right_visit
from {account} where account_key >= 100
union all
select account_key, 1,
       cast(account_key % 4 as bigint) * 10000 + (account_key + 1) * 100,
       cast(account_key % 4 as bigint) * 10000 + (account_key + 1) * 100 + 99
from {account} where account_key < 20
union all
select account_key, 2,
       cast(account_key % 4 as bigint) * 10000 + (account_key - 19) * 100 + 1,
       cast(account_key % 4 as bigint) * 10000 + (account_key - 19) * 100 + 2
from {account} where account_key >= 20 and account_key < 39""")

# Cost-pool account tree: revenue/expense headers, every third account below.
_bind("acct_cost_pool_tree", ["account"], """
select account_key as node_key, 0 as tree_level,
       cast(account_key - 100 as bigint) * 10000 as left_visit,
       cast(account_key - 100 as bigint) * 10000 + 9999 as right_visit
from {account} where account_key in (102, 103)
union all
select account_key, 1,
       cast(account_key % 4 - 2 + 2 as bigint) * 10000 + (account_key + 1) * 100,
       cast(account_key % 4 - 2 + 2 as bigint) * 10000 + (account_key + 1) * 100 + 99
from {account} where account_key < 100 and account_key % 3 = 0 and account_key % 4 in (2, 3)""")

# --- budgets (from orders) ----------------------------------------------------
_bind("budget_name", [], f"""
select budget_name_key, budget_name
from {_values([(1, 'AOP'), (2, 'Forecast Q2'), (3, 'Forecast Q3'), (4, 'Forecast Q4'), (5, 'Stretch')],
              ['budget_name_key', 'budget_name'])}""")

_bind("budget", [], f"""
select budget_key, budget_name_key, case when budget_key % 2 = 0 then 'I' else 'B' end as type
from {_values([(k, (k + 1) // 2) for k in range(1, 11)], ['budget_key', 'budget_name_key'])}""")

_bind("budget_organization", [], f"""
select budget_key * 100 + n as budget_organization_key, budget_key, 2000 + n as customer_key
from {_values([(b, n) for b in range(1, 11) for n in range(25)], ['budget_key', 'n'])}""")

_bind("budget_detail", ["orders"], """
select o_orderkey % 40 as account_key,
       (o_orderkey % 10 + 1) * 100 + o_custkey % 25 as budget_organization_key,
       cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as fiscal_month_key,
       cast(o_totalprice as decimal(18,2)) as amount
from {orders}""")

# --- people, projects ---------------------------------------------------------
_bind("person", ["events"], """
select user_id as person_key, concat('First', cast(user_id as string)) as first_name,
       concat('Last', cast(user_id as string)) as last_name,
       case when user_id % 4 = 0 then cast(null as string) else 'Q' end as middle_initial,
       concat('user', cast(user_id as string)) as username,
       cast(1 + user_id % 3 as bigint) as currency_code_key,
       cast(2000 + user_id % 25 as bigint) as customer_key,
       cast(1 + user_id % 2 as bigint) as business_week_key,
       case when user_id % 9 = 0 then 'N' else 'Y' end as active,
       make_date(2015 + user_id % 8, 1 + user_id % 12, 1) as hire_date,
       concat('user', cast(user_id as string), '@example.com') as email,
       concat('P', cast(1000 + user_id as string)) as person_code,
       case when user_id % 10 = 0 then 'Jr.' end as suffix
from (select distinct user_id from {events}) u""")

_bind("project", ["customer"], """
select c_custkey % 10 as project_key, concat('P', cast(c_custkey % 10 as string)) as project_code,
       concat('Project ', cast(c_custkey % 10 as string)) as title,
       cast(10000 + c_custkey % 10 as bigint) as customer_key,
       cast(2000 + c_custkey % 10 as bigint) as owning_customer_key,
       cast(1 + c_custkey % 3 as bigint) as project_type_key,
       cast(1 + c_custkey % 3 as bigint) as billing_type_key,
       cast(1 + c_custkey % 4 as bigint) as project_status_key,
       cast(c_custkey % 4 as bigint) as contract_key,
       cast(1 + c_custkey % 2 as bigint) as cost_struct_key,
       cast(1 + c_custkey % 3 as bigint) as project_currency,
       cast(1 + c_custkey % 2 as bigint) as project_billing_currency,
       cast(1 + c_custkey % 3 as bigint) as location_key,
       cast(1 + c_custkey % 2 as bigint) as posting_group_key,
       cast(1 + c_custkey % 2 as bigint) as pay_code_key,
       cast(1000 * (1 + c_custkey) as decimal(18,2)) as total_value,
       cast(900 * (1 + c_custkey) as decimal(18,2)) as orig_total_value,
       case when c_custkey % 3 = 0 then cast(null as decimal(18,2)) else cast(800 * (1 + c_custkey) as decimal(18,2)) end
         as funded_value,
       cast(750 * (1 + c_custkey) as decimal(18,2)) as orig_funded_value,
       make_date(2023, 1 + c_custkey, 1) as orig_start_date,
       case when c_custkey % 2 = 0 then make_date(2024, 12, 31) end as orig_end_date,
       make_date(2024, 1 + c_custkey, 28) as rev_end_date,
       concat('Purpose ', cast(c_custkey as string)) as purpose,
       case when c_custkey % 2 = 0 then 'Y' else 'N' end as assignment_flag,
       cast(c_custkey % 7 as bigint) as ic_cost_struct_labor_key,
       case when c_custkey % 3 = 0 then make_date(2024, 1, 25) end as completed_date
from (select distinct c_custkey % 10 as c_custkey from {customer}) c""")

_widen("project", "project_key",
       _yes_no(["expense_assignment_flag", "future_charge", "item_assignment_flag", "time_assignment_flag", "enforce_wbs_dates",
                "er_task_required", "item_task_required", "limit_bill_to_funded", "limit_rev_to_funded", "location_required",
                "task_level_assignment", "exp_sub_po_required", "ts_sub_po_required", "use_labor_category", "proj_require_time_comments",
                "self_assign_plans", "allow_self_plan", "ts_task_required", "tito_required", "advanced_costing_flag"], "project_key")
       | _texts(["project_color", "leave_balance", "account_number", "pct_complete_rule"] + USER_FIELDS, "project_key")
       | _money(["exp_bill_budget", "labor_bill_budget", "exp_bill_est_tot", "labor_bill_est_tot", "exp_bill_etc", "labor_bill_etc",
                 "exp_cost_burden_budget", "exp_cost_budget", "labor_cost_burden_budget", "labor_cost_budget", "exp_cost_est_tot",
                 "labor_cost_est_tot", "exp_cost_etc", "labor_cost_etc", "hours_budget", "hours_est_tot", "hours_etc",
                 "percent_complete", "probability_percent", "total_cost", "orig_total_cost", "total_fee", "orig_total_fee",
                 "funded_cost", "orig_funded_cost", "funded_fee", "orig_funded_fee"], "project_key")
       | {"bill_rate_source": "case project_key % 3 when 0 then 'P' when 1 then 'L' end",
          "cost_rate_source": "case project_key % 4 when 0 then 'P' when 1 then 'L' end",
          "rev_start_date": "make_date(2023, cast(1 + project_key as int), 5)", "created": "make_date(2022, cast(1 + project_key as int), 7)"})

# --- access grants ------------------------------------------------------------
# Viewers: 1 admin (role 1); 2 global finance access; 3 org-scoped; 4 scoped by
# legal entity; 5 no grants; 900001 org- and legal-entity-scoped.
_bind("member", [], f"""
select person_key, role_key
from {_values([(1, 1), (900001, 5), (900001, 10), (900001, 16), (2, 5), (3, 5), (4, 5), (5, 5)], ['person_key', 'role_key'])}""")

_bind("org_access_person", [], f"""
select org_access_person_key, person_key, role_key, access_type, global_access
from {_values([(10, 2, 33, 2, 'Y'), (11, 3, 33, 2, 'N'), (12, 4, 33, 2, 'N'),
               (13, 900001, 33, 2, 'N'), (14, 900001, 33, 1, 'N'), (15, 5, 20, 2, 'N'),
               (16, 900001, 27, 2, 'N'), (17, 900001, 56, 6, 'N'), (18, 900001, 56, 3, 'N'),
               (19, 2, 28, 2, 'Y'), (20, 4, 56, 2, 'Y'), (21, 4, 56, 6, 'Y'),
               (30, 9, 7, 0, 'N'), (31, 900001, 2, 0, 'N'),
               (32, 900001, 14, 1, 'N'), (33, 900001, 14, 4, 'Y'), (34, 900001, 3, 1, 'Y'), (35, 900001, 3, 4, 'N'),
               (36, 900001, 19, 1, 'Y'), (37, 900001, 19, 4, 'Y')],
              ['org_access_person_key', 'person_key', 'role_key', 'access_type', 'global_access'])}""")

_bind("access_customer_view", ["supplier", "nation"], """
select cast(10000 + s_suppkey as bigint) as customer_key, cast(11 as bigint) as org_access_person_key,
       'N' as legal_entity_ind
from {supplier} where s_suppkey % 3 = 0
union all
select cast(10000 + s_suppkey as bigint), cast(13 as bigint), 'N' from {supplier} where s_suppkey % 7 = 1
union all
select cast(10000 + s_suppkey as bigint), cast(14 as bigint), 'N' from {supplier} where s_suppkey % 7 = 2
union all
select cast(2000 + n_nationkey as bigint), cast(12 as bigint), 'Y' from {nation} where n_nationkey % 5 = 0
union all
select cast(2000 + n_nationkey as bigint), cast(13 as bigint), 'Y' from {nation} where n_nationkey % 4 = 1
union all
select cast(2000 + n_nationkey as bigint), cast(16 as bigint), 'Y' from {nation} where n_nationkey % 3 = 0
union all
select cast(2000 + n_nationkey as bigint), cast(18 as bigint), 'Y' from {nation} where n_nationkey % 3 = 1
union all
select cast(10000 + s_suppkey as bigint), cast(17 as bigint), 'N' from {supplier} where s_suppkey % 2 = 0""")


# --- payables (from orders / lineitem / supplier) ----------------------------
_bind("fin_document", ["orders"], """
select o_orderkey as fin_document_key,
       cast(2000 + o_custkey % 25 as bigint) as legal_entity_key,
       case when o_orderkey % 97 = 0 then o_orderkey - 1 end as voided_fin_document_key,
       case when o_orderkey % 101 = 0 then o_orderkey + 1 end as voiding_fin_document_key,
       case when o_orderkey % 5 = 0 then cast(null as string) else concat('Order ', o_orderpriority) end as comments,
       o_custkey % 15 as created_by, o_orderdate as created_timestamp,
       cast(1 + o_custkey % 3 as bigint) as currency,
       concat('Vendor invoice ', cast(o_orderkey as string)) as description,
       cast(o_orderdate as date) as document_date,
       concat('VI', cast(o_orderkey as string)) as document_number,
       0 as document_type,
       (o_custkey + 3) % 15 as last_updated_by, o_orderdate as last_updated_timestamp,
       case when o_orderkey % 9 = 0 then cast(null as bigint) else cast(1 + o_orderkey % 3 as bigint) end as local_currency,
       cast(o_orderdate as date) + cast(o_orderkey % 20 as int) as post_date,
       case when o_orderstatus = 'P' then cast(null as bigint) else (o_custkey + 7) % 15 end as posted_by,
       case when o_orderstatus = 'P' then null else o_orderdate + interval 2 day end
         as posted_timestamp,
       concat('REF', cast(o_orderkey % 1000 as string)) as reference,
       case o_orderstatus when 'F' then 'Posted' when 'O' then 'Open' else 'Pending' end as status,
       (o_custkey + 5) % 15 as submitted_by, o_orderdate + interval 1 day as submitted_timestamp
from {orders}""")

_bind("vendor_invoice", ["orders"], """
select o_orderkey as fin_document_key, o_orderkey % 40 as account_key,
       cast(2000 + o_custkey % 25 as bigint) as organization_key,
       cast(1 + o_orderkey % 4 as bigint) as payment_term_key,
       case when o_orderkey % 7 = 0 then o_orderkey end as po_key,
       cast(10000 + o_custkey % 10 as bigint) as vendor_org_key,
       cast(cast(o_totalprice as decimal(18,2)) * cast(0.02 as decimal(4,2)) as decimal(18,2)) as discount_amount,
       cast(cast(o_orderdate as date) + interval 30 day as date) as due_date,
       case when o_orderkey % 17 = 0 then 'Disputed' end as hold_reason,
       cast(o_totalprice as decimal(18,2)) as invoice_amount,
       cast(o_orderdate as date) as invoice_date,
       cast(cast(o_totalprice as decimal(18,2)) * cast(0.02 as decimal(4,2)) as decimal(18,2)) as local_discount_amount,
       cast(o_totalprice as decimal(18,2)) as local_invoice_amount,
       case when o_orderkey % 17 = 0 then 'Y' else 'N' end as payment_on_hold
from {orders}""")

_bind("vendor_invoice_activity", ["lineitem"], """
select l_orderkey as fin_document_key,
       case when l_linenumber = 7 then cast(null as decimal(18,2))
            else cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(18,2)) end as applied,
       cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2)) as discount,
       cast(l_extendedprice as decimal(18,2)) as invoice_amount,
       cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(18,2)) as local_applied,
       cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2)) as local_discount,
       cast(l_extendedprice as decimal(18,2)) as local_invoice_amount
from {lineitem}""")

_bind("fin_document_recurring", ["orders"], """
select o_orderkey as fin_document_key, o_orderkey - 13 as orig_fin_document_key,
       12 as max_occurrences, cast(1 + o_orderkey % 12 as int) as sequence
from {orders} where o_orderkey % 13 = 0""")

_bind("purchase_order", ["orders"], """
select o_orderkey as po_key,
       case when o_orderkey % 14 = 0 then o_orderkey + 1 else o_orderkey end as orig_po_key,
       concat('PO', cast(o_orderkey as string)) as document_number
from {orders} where o_orderkey % 7 = 0""")

_bind("payment_term", [], f"""
select payment_term_key, description, discount_days
from {_values([(1, 'Net 30', 10), (2, 'Net 45', None), (3, '2/10 Net 30', 10), (4, 'Due on receipt', 0)],
              ['payment_term_key', 'description', 'discount_days'])}""")

_bind("address", ["supplier"], """
select s_suppkey as address_key, concat('City', cast(s_nationkey as string)) as city,
       concat('Country', cast(s_nationkey as string)) as country,
       concat(cast(10000 + s_suppkey as string), '-', cast(s_nationkey as string)) as postal_code,
       case when s_suppkey % 3 = 0 then cast(null as string) else 'ST' end as state_province,
       concat(cast(s_suppkey as string), ' Main St') as street1,
       case when s_suppkey % 2 = 0 then 'Suite 100' end as street2, cast(null as string) as street3
from {supplier}""")

_bind("customer_address", ["supplier"], """
select cast(10000 + s_suppkey as bigint) as customer_key, s_suppkey as address_key,
       case when s_suppkey % 4 = 3 then 'N' else 'Y' end as default_remit_to
from {supplier}""")

_bind("integration", [], f"""
select integration_key, integration_name
from {_values([(1, 'AP export'), (2, 'Bank feed')], ['integration_key', 'integration_name'])}""")

_bind("integration_value", ["orders"], """
select o_orderkey as integration_value_key, cast(1 + o_orderkey % 2 as bigint) as integration_key,
       o_orderkey as internal_key, o_orderkey + 500000000 as external_key, 'VI' as value_type
from {orders} where o_orderkey % 3 = 0
union all
select o_orderkey + 900000000, cast(2 as bigint), -o_orderkey, o_orderkey + 700000000, 'PAY'
from {orders} where o_orderkey % 11 = 0""")


# --- cost pools (calcs aggregated from orders per group and month) -----------
_bind("cost_pool_group", [], f"""
select cost_pool_group_key, currency_code_key, cost_pool_group_name
from {_values([(1, 1, 'Standard'), (2, 2, 'Provisional')],
              ['cost_pool_group_key', 'currency_code_key', 'cost_pool_group_name'])}""")

_bind("cost_pool_group_mle", ["nation"], """
select cast(1 + n_nationkey % 2 as bigint) as cost_pool_group_key, cast(2000 + n_nationkey as bigint) as legal_entity_key
from {nation}""")

# Pools: one per nation; two carry names of the report's exclusion list.
_bind("cost_pool", ["nation"], """
select cast(n_nationkey as bigint) as cost_pool_key, cast(1 + n_nationkey % 2 as bigint) as cost_pool_group_key,
       case n_nationkey when 3 then 'Other costs, rates only'
                        when 6 then 'Travel, rates only'
                        else concat('Pool ', n_name) end as cost_pool_name,
       n_nationkey % 4 as display_sequence,
       case when n_nationkey % 5 = 4 then 'N' else 'Y' end as post_rate_to_cost_struct
from {nation}""")

# One calc per (group, month) with the month's lowest order key; months that are
# multiples of 6 get a second calc (highest key), linked to budgets; November of
# even years is voided.
_bind("cost_pool_group_calc", ["orders"], """
select k as cost_pool_group_calc_key, g as cost_pool_group_key, m as post_fiscal_month_key,
       case when m % 100 = 11 and (m - m % 100) % 200 = 0 then cast(7 as bigint) end as voided_by,
       case when m % 100 = 11 and (m - m % 100) % 200 = 0 then timestamp '2003-01-01 00:00:00' end as voided_timestamp
from (
  select min(o_orderkey) as k, cast(1 + o_custkey % 2 as bigint) as g,
         cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as m
  from {orders} group by cast(1 + o_custkey % 2 as bigint), cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint)
  union all
  select max(o_orderkey), cast(1 + o_custkey % 2 as bigint), cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint)
  from {orders} where month(o_orderdate) % 6 = 0
  group by cast(1 + o_custkey % 2 as bigint), cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint)
) c""")

_bind("cost_pool_group_calc_budget", ["orders"], """
select b.budget_key, c.k as cost_pool_group_calc_key
from (select max(o_orderkey) as k from {orders} where month(o_orderdate) % 6 = 0
      group by cast(1 + o_custkey % 2 as bigint), cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint)) c
join (values (2), (4)) b(budget_key) on c.k % 2 = 0 or b.budget_key = 2""")

_bind("cost_pool_calc", ["cost_pool_group_calc", "cost_pool"], """
select c.cost_pool_group_calc_key * 100 + p.cost_pool_key as cost_pool_calc_key,
       c.cost_pool_group_calc_key, p.cost_pool_key,
       cast((p.cost_pool_key + 1) * 0.125 as decimal(18,6)) as rate
from {cost_pool_group_calc} c join {cost_pool} p on p.cost_pool_group_key = c.cost_pool_group_key
where (c.cost_pool_group_calc_key + p.cost_pool_key) % 7 <> 0""")

# YTD amounts grow with the period number; pool 7 has a zero base (rate guard).
_bind("cost_pool_source_calc", ["cost_pool_calc", "cost_pool_group_calc"], """
select x.cost_pool_calc_key,
       cast((c.post_fiscal_month_key % 100) * (100 + x.cost_pool_key) + s * 10 + x.cost_pool_group_calc_key % 13
            as decimal(18,2)) as amount
from {cost_pool_calc} x
join {cost_pool_group_calc} c on c.cost_pool_group_calc_key = x.cost_pool_group_calc_key
join (values (1), (2)) t(s) on true""")

_bind("cost_pool_basis_calc", ["cost_pool_calc", "cost_pool_group_calc"], """
select x.cost_pool_calc_key,
       case when x.cost_pool_key = 7 then cast(0 as decimal(18,2))
            else cast((c.post_fiscal_month_key % 100) * (1000 + 3 * x.cost_pool_key) + x.cost_pool_group_calc_key % 17
                      as decimal(18,2)) end as amount
from {cost_pool_calc} x
join {cost_pool_group_calc} c on c.cost_pool_group_calc_key = x.cost_pool_group_calc_key""")


# --- time, accruals, approvals (from events: 2024-01-01 .. 2024-01-30) -------
WEEK_OF_TS = ("case when day(ts) <= 7 then 0 when day(ts) <= 14 then 1 when day(ts) <= 21 then 2 "
              "when day(ts) <= 28 then 3 else 4 end")
TASK_OF_EVENT = ("case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 "
                 "when 'purchase' then 4 else 5 end")

_bind("accrual_plan", [], f"""
select accrual_plan_key, accrual_plan, description, period_type, cast(begin_date as date) as begin_date,
       carryover_ind, active, rate_method
from {_values([(1, 'PTO', 'Paid time off', 'W', '2024-01-01', 'Y', 'Y', 'H'),
               (2, 'SICK', 'Sick leave', 'W', '2024-01-01', 'N', 'Y', 'H'),
               (3, 'FLOAT', 'Floating holiday', 'W', '2023-01-01', 'N', 'N', 'F')],
              ['accrual_plan_key', 'accrual_plan', 'description', 'period_type', 'begin_date', 'carryover_ind',
               'active', 'rate_method'])}""")

_bind("accrual_period", [], f"""
select plan * 10 + k as accrual_period_key, plan as accrual_plan_key,
       cast(make_date(2024, 1, 1 + 7 * k) as date) as begin_date,
       case when k = 4 then make_date(2024, 1, 31) else make_date(2024, 1, 7 + 7 * k) end as end_date
from {_values([(p, k) for p in (1, 2, 3) for k in range(5)], ['plan', 'k'])}""")

_bind("person_accrual_plan", ["events"], """
select user_id * 10 + 1 + user_id % 2 as person_accrual_plan_key, cast(1 + user_id % 2 as bigint) as accrual_plan_key,
       user_id as person_key, user_id % 10 as project_key,
       case when user_id % 4 = 0 then cast(null as bigint) else cast(1 + user_id % 5 as bigint) end as task_key,
       make_date(2024, 1, 1) as begin_date,
       case when user_id % 5 = 0 then make_date(2024, 1, 20) else make_date(2024, 1, 31) end as end_date,
       case when user_id % 7 = 0 then make_date(2024, 1, 10) end as loa_start_date,
       case when user_id % 7 = 0 then make_date(2024, 1, 12) end as loa_end_date
from (select distinct user_id from {events}) u
union all
select user_id * 10 + 3, cast(3 as bigint), user_id, user_id % 10, cast(null as bigint),
       make_date(2024, 1, 8), make_date(2024, 1, 31), cast(null as date), cast(null as date)
from (select distinct user_id from {events}) u where user_id % 2 = 0""")

_bind("person_accrual", ["events"], f"""
select user_id * 10 + 1 + user_id % 2 as person_accrual_plan_key,
       (1 + user_id % 2) * 10 + {WEEK_OF_TS} as accrual_period_key,
       user_id as person_key, event_id % 15 as posted_by_key,
       cast((event_id % 80) * 0.25 as decimal(18,6)) as accrued_hours,
       case when event_type = 'error' then null else ts end as posted_timestamp,
       case event_type when 'signup' then 'I' when 'view' then 'A' when 'click' then 'P'
                       when 'purchase' then 'U' else 'C' end as source_ind
from {{events}}""")

_bind("person_rate", ["events"], """
select user_id as person_key, make_date(2023, 6, 1) as begin_date, make_date(2024, 1, 14) as end_date,
       cast(20 + user_id % 7 as decimal(18,6)) as cost_rate
from (select distinct user_id from {events}) u where user_id % 6 <> 5
union all
select user_id, make_date(2024, 1, 15), make_date(2024, 12, 31), cast(25 + user_id % 5 as decimal(18,6))
from (select distinct user_id from {events}) u where user_id % 6 <> 5
union all
select user_id, make_date(2024, 1, 10), make_date(2024, 1, 12), cast(31 + user_id % 3 as decimal(18,6))
from (select distinct user_id from {events}) u where user_id % 8 = 1""")

_bind("business_week", [], f"""
select business_week_key, cast(hours as decimal(18,6)) as hours
from {_values([(1, '40.0'), (2, '37.5')], ['business_week_key', 'hours'])}""")

_bind("task", [], f"""
select task_key, task_name, task_number, billing_type_key, project_type_key,
       cast(completed as date) as completed, cast(rev_end_date as date) as rev_end_date
from {_values([(1, 'Onboarding', 'T1', 1, 1, None, '2024-03-31'), (2, 'Research', 'T2', None, 1, None, None),
               (3, 'Design', 'T3', 2, 2, '2024-01-15', None), (4, 'Delivery', 'T4', 3, 3, None, '2024-06-30'),
               (5, 'Support', 'T5', None, None, None, None)],
              ['task_key', 'task_name', 'task_number', 'billing_type_key', 'project_type_key', 'completed',
               'rev_end_date'])}""")

_bind("project_type", [], f"""
select project_type_key, billable, project_type
from {_values([(1, 'Y', 'Billable'), (2, 'N', 'Overhead'), (3, 'Y', 'Fixed Fee')],
              ['project_type_key', 'billable', 'project_type'])}""")

_bind("person_time", ["events"], f"""
select distinct user_id * 10 + {WEEK_OF_TS} as person_time_key, user_id as person_key,
       case when user_id % 3 = 0 then 'A' else 'S' end as status,
       case when user_id % 5 = 0 then 'P' else 'N' end as adjustment_status
from {{events}}""")

_bind("person_time_data", ["events"], f"""
select event_id as time_data_key, user_id * 10 + {WEEK_OF_TS} as person_time_key,
       user_id % 10 as project_key, cast(1 + (user_id + event_id) % 3 as bigint) as project_type_key,
       cast({TASK_OF_EVENT} as bigint) as task_key, cast(ts as date) as work_date,
       cast((event_id % 9) * 0.5 as decimal(18,6)) as quantity,
       case when event_type = 'error' then cast(null as bigint) else event_id % 50 end as post_history_key,
       event_id % 50 as cost_post_history_key,
       cast(1 + event_id % 4 as bigint) as labor_category_key,
       cast(event_id % 7 as bigint) as cost_struct_labor_key,
       case when event_id % 3 = 0 then event_id % 40 end as invoice_key,
       case when event_id % 11 = 0 then event_id end as vendor_invoice_key,
       cast((event_id % 9) * 0.5 * 42.5 as decimal(18,2)) as cost_amount,
       cast(1 + event_id % 3 as bigint) as cost_currency,
       cast((event_id % 9) * 0.5 * 95 as decimal(18,2)) as bill_amount,
       cast(1 + event_id % 3 as bigint) as bill_currency,
       cast(42.5 as decimal(18,6)) as eff_cost_rate, cast(95 as decimal(18,6)) as eff_bill_rate,
       cast((event_id % 9) * 0.5 * 40 as decimal(18,2)) as ic_cost_amount, cast(1 as bigint) as ic_cost_currency,
       cast(event_id % 3 as decimal(18,2)) as additional_pay, cast(event_id % 2 as int) as adjusted_number,
       case when event_id % 4 = 0 then cast(null as string) else concat('note ', event_type) end as comments,
       cast(ts as date) + 3 as post_date
from {{events}}""")

_bind("post_history", [], f"""
select post_history_key, cast(posted_by_key as bigint) as posted_by_key,
       cast(journal_trans_date as date) as journal_trans_date, cast(post_timestamp as timestamp) as post_timestamp
from {_values([(k, k % 15, f'2024-02-{1 + k % 28:02d}', f'2024-02-{1 + k % 28:02d} {k % 24:02d}:15:00') for k in range(50)],
              ['post_history_key', 'posted_by_key', 'journal_trans_date', 'post_timestamp'])}""")

_bind("approval_chain", [], f"""
select chain_key, person_key
from {_values([(1, 900001), (2, 7), (3, 8)], ['chain_key', 'person_key'])}""")

_bind("approval_group_submitter", ["events"], """
select cast(1 + user_id % 3 as bigint) as chain_key, user_id as person_key, cast(1 + user_id % 4 as int) as approval_type
from (select distinct user_id from {events}) u""")

_bind("alternate", [], f"""
select alternate_key, person_key, role_key
from {_values([(900001, 7, 2), (900001, 9, 7), (12, 8, 2)], ['alternate_key', 'person_key', 'role_key'])}""")

_bind("org_access_hierarchy", ["nation", "supplier"], """
select cast(2000 + n_nationkey as bigint) as customer_key, cast(31 as bigint) as org_access_person_key
from {nation} where n_nationkey % 4 = 2
union all
select cast(2000 + n_nationkey as bigint), cast(30 as bigint) from {nation} where n_nationkey % 4 = 3
union all
select cast(2000 + n_nationkey as bigint), cast(35 as bigint) from {nation} where n_nationkey % 2 = 0
union all
select cast(10000 + s_suppkey as bigint), cast(32 as bigint) from {supplier} where s_suppkey % 3 = 0""")


# --- project postings (journals from events; small lookups by rule) ----------
def _journal(key: str, src_filter: str = "true") -> str:
    """Two journal rows per event (a posting category and, for even ids, cost)."""
    return f"""
select event_id % 40 as account_key, event_id as {key},
       cast((event_id % 50) * 1.5 + 10 as decimal(18,2)) as amount,
       case event_id % 7 when 0 then 5 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 9
                         when 5 then 5 else 1 end as category,
       cast(ts as date) + cast(event_id % 20 as int) as journal_trans_date
from {{events}} where {src_filter}
union all
select event_id % 40, event_id, cast((event_id % 30) * 2.25 as decimal(18,2)),
       case when event_id % 2 = 0 then 6 else 3 end, cast(ts as date) + cast(event_id % 9 as int)
from {{events}} where {src_filter}"""


_bind("journal_time", ["events"], _journal("time_data_key"))
_bind("journal_cost_plus_detail", ["events", "fin_document_detail"],
      _journal("cost_plus_post_detail_key", "event_id % 3 = 0") + """
union all
select account_key, 2000000000 + fin_document_detail_key, cast(line_no % 60 + 5 as decimal(18,2)),
       case line_no % 4 when 0 then 5 when 1 then 1 when 2 then 3 else 9 end,
       transaction_date + cast(line_no % 5 as int)
from {fin_document_detail} where line_no % 6 = 0""")

_bind("invcd_time", ["events"], """
select event_id % 40 as invoice_key, event_id as time_data_key,
       cast((event_id % 4) * 0.5 as decimal(18,6)) as writeoff_quantity
from {events} where event_id % 5 = 0""")

_bind("invoice", [], f"""
select invoice_key, voided_invoice_key, cast(completed_date as date) as completed_date,
       cast(invoice_date as date) as invoice_date, invoice_number
from {_values([(k, k - 1 if k % 7 == 3 else None, None if k % 5 == 4 else f'2024-02-{1 + k % 28:02d}',
                f'2024-01-{1 + k % 28:02d}', f'INV{k:05d}') for k in range(40)],
              ['invoice_key', 'voided_invoice_key', 'completed_date', 'invoice_date', 'invoice_number'])}""")

_bind("cost_plus_post_detail", ["events", "fin_document_detail"], """
select event_id as cost_plus_post_detail_key, event_id as time_data_key,
       case when event_id % 4 = 0 then cast(null as bigint) else cast(1 + event_id % 3 as bigint) end as cost_element_key,
       cast(1 + event_id % 3 as bigint) as fee_method_key,
       event_id % 40 as invoice_key, event_id % 50 as post_history_key,
       cast(null as bigint) as fin_document_det_labor_key, cast(null as bigint) as fin_document_det_expense_key,
       cast(null as bigint) as fin_document_det_item_key,
       case when event_id % 6 = 0 and event_type in ('purchase', 'click') then event_id end as expense_data_allocation_key
from {events} where event_id % 3 = 0
union all
select 2000000000 + fin_document_detail_key, cast(null as bigint),
       case when detail_type = 'L' then cast(1 + (line_no % 7) % 4 as bigint)
            else cast(1 + ((line_no % 5) + 1) % 4 as bigint) end,
       cast(1 + line_no % 3 as bigint), line_no % 40, line_no % 50,
       case when detail_type = 'L' then fin_document_detail_key end,
       case when detail_type = 'E' then fin_document_detail_key end,
       case when detail_type = 'I' then fin_document_detail_key end, cast(null as bigint)
from {fin_document_detail} where line_no % 6 = 0""")

_bind("cost_struct", [], f"""
select cost_struct_key, cost_structure
from {_values([(1, 'CS-Standard'), (2, 'CS-Government')], ['cost_struct_key', 'cost_structure'])}""")

_bind("cost_element", [], f"""
select cost_element_key, code, description, cost_element_type
from {_values([(1, 'LAB', 'Direct labor', 'L'), (2, 'ODC', 'Other direct cost', 'O'),
               (3, 'OH', 'Overhead', 'P'), (4, 'FEE', 'Fee', 'Fee')],
              ['cost_element_key', 'code', 'description', 'cost_element_type'])}""")

_bind("cost_struct_labor", [], f"""
select cost_struct_labor_key, cost_struct_key, cost_element_key
from {_values([(k, 1 + k % 2, 1 + k % 4) for k in range(7)],
              ['cost_struct_labor_key', 'cost_struct_key', 'cost_element_key'])}""")

_bind("cost_struct_odc", [], f"""
select cost_struct_odc_key, cost_struct_key, cost_element_key
from {_values([(k, 2 - k % 2, 1 + (k + 1) % 4) for k in range(5)],
              ['cost_struct_odc_key', 'cost_struct_key', 'cost_element_key'])}""")

_bind("fee_method", [], f"""
select fee_method_key, fee_method
from {_values([(1, 'Fixed Fee'), (2, 'Award Fee'), (3, 'Base Fee')], ['fee_method_key', 'fee_method'])}""")

_bind("labor_category", [], f"""
select labor_category_key, labor_category, description, account_number
from {_values([(1, 'ENG1', 'Engineer I', '5001'), (2, 'ENG2', 'Engineer II', '5002'),
               (3, 'PM', 'Project Manager', '5003'), (4, 'ADM', 'Administrator', None)],
              ['labor_category_key', 'labor_category', 'description', 'account_number'])}""")

_bind("billing_type", [], f"""
select billing_type_key, code
from {_values([(1, 'TM'), (2, 'FP'), (3, 'CP'), (4, 'NB')], ['billing_type_key', 'code'])}""")

_bind("project_status", [], f"""
select project_status_key, status
from {_values([(1, 'Open'), (2, 'Closed'), (3, 'On Hold - Open'), (4, 'Pending')], ['project_status_key', 'status'])}""")

_bind("project_controller", ["events"], """
select user_id % 10 as project_key, user_id as person_key,
       case user_id % 6 when 0 then 3 when 1 then 12 when 2 then 14 when 3 then 17 when 4 then 13 else 20 end
         as role_key,
       -- each project and role has one primary controller, its first user; all others are alternates
       case when f.first_user is not null then 'Y' else 'N' end as primary_ind
from (select distinct user_id from {events}) u
left join (select min(user_id) as first_user from {events} group by user_id % 10, user_id % 6) f on f.first_user = u.user_id
union all
select project_key, cast(900001 as bigint), role_key, primary_ind
from (values (2, 3, 'Y'), (5, 12, 'N'), (7, 20, 'Y')) v(project_key, role_key, primary_ind)""")

_bind("project_open_access_view", ["project"], """
select project_key,
       case when project_key % 3 = 0 then 'Y' else 'N' end as billing_manager_open,
       case when project_key % 4 = 1 then 'Y' else 'N' end as billing_viewer_open,
       'N' as project_document_viewer_open,
       case when project_key % 2 = 0 then 'Y' else 'N' end as project_manager_open,
       'N' as project_po_viewer_open, 'N' as project_pr_viewer_open,
       case when project_key % 3 = 1 then 'Y' else 'N' end as project_viewer_open,
       'N' as resource_assigner_open,
       case when project_key % 5 = 3 then 'Y' else 'N' end as resource_planner_open,
       'N' as resource_requestor_open
from {project} where project_key <> 9""")

_bind("project_fee", ["project"], """
select project_key, cast(1 + project_key % 3 as bigint) as fee_method_key, cast(0.1 as decimal(18,6)) as fee_factor,
       'P' as fee_factor_type, cast(100 * project_key as decimal(18,2)) as fixed_fee_amount
from {project}
union all
select project_key, cast(1 + (project_key + 1) % 3 as bigint), cast(0.05 as decimal(18,6)), 'F',
       cast(50 * project_key as decimal(18,2))
from {project} where project_key % 2 = 0
union all
select project_key, cast(1 + project_key % 3 as bigint), cast(0.02 as decimal(18,6)), 'F', cast(7 as decimal(18,2))
from {project} where project_key % 5 = 0""")

_bind("project_intercompany", ["project"], """
select project_key, cast(2000 + (project_key * 3) % 25 as bigint) as ic_org from {project} where project_key % 3 <> 2
union all
select project_key, cast(2000 + (project_key * 7) % 25 as bigint) from {project} where project_key % 3 = 0
union all
select project_key, cast(99999 as bigint) from {project} where project_key = 4""")

_bind("contract", [], f"""
select contract_key, prime_contract_key, contract_code, contract_title
from {_values([(0, None, 'C-000', 'Master services'), (1, 0, 'C-001', 'Task order 1'),
               (2, 0, 'C-002', 'Task order 2'), (3, 9, 'C-003', 'Orphan order')],
              ['contract_key', 'prime_contract_key', 'contract_code', 'contract_title'])}""")

_bind("location", [], f"""
select location_key, location_name
from {_values([(1, 'HQ'), (2, 'Field'), (3, 'Remote')], ['location_key', 'location_name'])}""")

_bind("pay_code", [], f"""
select pay_code_key, pay_code
from {_values([(1, 'REG'), (2, 'OT')], ['pay_code_key', 'pay_code'])}""")

_bind("posting_group", [], f"""
select posting_group_key, posting_group_name
from {_values([(1, 'Domestic'), (2, 'International')], ['posting_group_key', 'posting_group_name'])}""")


# --- project-level charges (from orders, dated January 2024) ------------------
def _order_journal(key: str, src_filter: str, revenue_cat: int) -> str:
    return f"""
select o_orderkey % 40 as account_key, o_orderkey as {key},
       cast(cast(o_totalprice as decimal(18,2)) * cast(0.1 as decimal(4,2)) as decimal(18,2)) as amount,
       case o_orderkey % 5 when 0 then 5 when 1 then 1 when 2 then 2 when 3 then {revenue_cat} else 9 end as category,
       make_date(2024, 1, cast(1 + o_orderkey % 28 as int)) as journal_trans_date
from {{orders}} where {src_filter}
union all
select o_orderkey % 40, o_orderkey, cast(o_orderkey % 97 as decimal(18,2)), {revenue_cat},
       make_date(2024, 2, cast(1 + o_orderkey % 27 as int))
from {{orders}} where {src_filter} and o_orderkey % 3 = 0"""


_CHARGE_COMMON = """o_orderkey % 10 as project_key, o_orderkey % 40 as invoice_key,
       case when o_orderkey % 9 = 0 then cast(null as bigint) else o_orderkey % 50 end as post_history_key"""

_bind("fixed_price", ["orders"], f"""
select o_orderkey as fixed_price_key, {_CHARGE_COMMON},
       case when o_orderkey % 7 = 0 then cast(null as bigint) else cast(1 + o_orderkey % 5 as bigint) end as task_key,
       case when o_orderkey % 11 = 0 then o_orderkey % 50 end as billable_post_history_key,
       cast(o_totalprice as decimal(18,2)) as amount, make_date(2024, 1, cast(1 + o_orderkey % 28 as int)) as bill_date,
       concat('Milestone ', o_orderpriority) as description,
       case when o_orderkey % 3 = 0 then 'Y' else 'N' end as use_wbs_end_date
from {{orders}} where o_orderkey % 4 = 0""")
_bind("journal_fixed_price", ["orders"], _order_journal("fixed_price_key", "o_orderkey % 4 = 0", 3))

_bind("prebilled_labor", ["orders"], f"""
select o_orderkey as prebilled_labor_key, {_CHARGE_COMMON},
       cast(o_totalprice as decimal(18,2)) as amount, make_date(2024, 1, cast(1 + o_orderkey % 27 as int)) as bill_date,
       concat('Prebill ', o_orderstatus) as description
from {{orders}} where o_orderkey % 4 = 1""")
_bind("journal_prebilled_labor", ["orders"], _order_journal("prebilled_labor_key", "o_orderkey % 4 = 1", 3))

_bind("funding_cap_adjustment", ["orders"], f"""
select o_orderkey as funding_cap_adjustment_key, {_CHARGE_COMMON},
       case when o_orderkey % 5 = 0 then cast(null as bigint) else cast(1 + o_orderkey % 5 as bigint) end as task_key,
       cast(-o_totalprice as decimal(18,2)) as bill_amount
from {{orders}} where o_orderkey % 4 = 2""")
_bind("journal_funding_cap_adjustment", ["orders"],
      _order_journal("funding_cap_adjustment_key", "o_orderkey % 4 = 2", 10))

_bind("fee_cap_adjustment", ["orders"], f"""
select o_orderkey as fee_cap_adjustment_key, {_CHARGE_COMMON},
       cast(1 + o_orderkey % 3 as bigint) as fee_method_key,
       cast(o_totalprice * 0 + (o_orderkey % 200) as decimal(18,2)) as bill_amount
from {{orders}} where o_orderkey % 4 = 3""")
_bind("journal_fee_cap_adjustment", ["orders"], _order_journal("fee_cap_adjustment_key", "o_orderkey % 4 = 3", 25))

_bind("onetime_charge", ["orders"], """
select o_orderkey as onetime_charge_key, o_orderkey % 10 as project_key, o_orderkey % 45 as invoice_key,
       case when o_orderkey % 2 = 0 then cast(null as bigint) else cast(1 + o_orderkey % 5 as bigint) end as task_key,
       cast(o_orderkey % 300 as decimal(18,2)) as amount, concat('Charge ', o_orderpriority) as description
from {orders} where o_orderkey % 5 = 0""")
_bind("journal_onetime_charge", ["orders"], _order_journal("onetime_charge_key", "o_orderkey % 5 = 0 and o_orderkey % 10 <> 5", 3))


# --- financial document detail lines (lineitem, one row per line) ------------
# (l_orderkey, l_linenumber) is not unique in the driver data, so rows that
# share it are numbered in the order of their other columns; the number is
# part of the line's key.  That key ends in the number, 1 for most lines, so the
# tables below take residues of ``line_no``, which meets every class of each.
_bind("fin_document_detail", ["lineitem"], """
select k as fin_document_detail_key, fin_document_key, account_key, organization_key, person_key,
       debit_amount, credit_amount, concat('Detail ', cast(k as string)) as description,
       case rf when 'R' then 'L' when 'A' then 'E' else 'I' end as detail_type,
       concat('R', cast(line_no % 1000 as string)) as reference, transaction_date, line_no
from (select l_orderkey * 11 + l_linenumber as line_no,
             (l_orderkey * 10 + l_linenumber) * 1000
               + row_number() over (partition by l_orderkey, l_linenumber
                                    order by l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, l_quantity) as k,
             l_orderkey as fin_document_key,
             l_partkey % 40 as account_key, cast(10000 + l_suppkey as bigint) as organization_key,
             l_suppkey % 15 as person_key, cast(l_extendedprice as decimal(18,2)) as debit_amount,
             cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(18,2))
               as credit_amount,
             l_returnflag as rf,
             make_date(2024, 1, cast(1 + (l_orderkey * 10 + l_linenumber) % 28 as int)) as transaction_date
      from {lineitem}) d""")

_bind("fin_document_det_proj_labor", ["fin_document_detail"], """
select fin_document_detail_key, cast(1 + line_no % 4 as bigint) as labor_category_key,
       line_no % 10 as project_key,
       case when line_no % 6 = 0 then cast(null as bigint) else cast(1 + line_no % 5 as bigint) end
         as task_key,
       cast(1 + line_no % 3 as bigint) as project_type_key,
       cast(40 + line_no % 30 as decimal(18,6)) as cost_rate,
       cast((line_no % 16) * 0.5 as decimal(18,6)) as hours
from {fin_document_detail} where detail_type = 'L' and line_no % 5 <> 0""")

_bind("fin_document_detail_labor", ["fin_document_detail"], """
select fin_document_detail_key, cast(line_no % 7 as bigint) as cost_struct_labor_key,
       case when line_no % 3 = 0 then line_no % 40 end as invoice_key,
       case when line_no % 3 = 1 then line_no % 45 end as manual_invoice_key,
       case when line_no % 4 = 0 then cast(null as bigint) else line_no % 50 end
         as post_history_key,
       debit_amount as amount, cast(debit_amount * cast(1.5 as decimal(3,1)) as decimal(18,2)) as bill_amount,
       cast(1 + line_no % 3 as bigint) as bill_currency,
       cast(95 as decimal(18,6)) as bill_rate
from {fin_document_detail} where detail_type = 'L'""")

_bind("fin_document_det_proj_expense", ["fin_document_detail"], """
select fin_document_detail_key, cast(1 + line_no % 5 as bigint) as expense_type_key,
       line_no % 10 as project_key,
       case when line_no % 4 = 0 then cast(null as bigint) else cast(1 + line_no % 5 as bigint) end
         as task_key,
       cast(1 + line_no % 3 as bigint) as project_type_key
from {fin_document_detail} where detail_type = 'E' and line_no % 7 <> 3""")

_bind("fin_document_detail_expense", ["fin_document_detail"], """
select fin_document_detail_key, cast(line_no % 5 as bigint) as cost_struct_odc_key,
       case when line_no % 3 = 0 then line_no % 40 end as invoice_key,
       case when line_no % 3 = 2 then line_no % 45 end as manual_invoice_key,
       case when line_no % 4 = 1 then cast(null as bigint) else line_no % 50 end
         as post_history_key,
       debit_amount as amount, cast(debit_amount * cast(1.1 as decimal(3,1)) as decimal(18,2)) as bill_amount,
       cast(1 + line_no % 3 as bigint) as bill_currency
from {fin_document_detail} where detail_type = 'E'""")

_bind("fin_document_detail_po", ["fin_document_detail"], """
select fin_document_detail_key, fin_document_key as po_key,
       case when detail_type = 'L' then fin_document_detail_key end as po_labor_line_descriptor_key,
       case when detail_type = 'E' then fin_document_detail_key end as po_expense_line_descriptor_key
from {fin_document_detail} where line_no % 4 = 0""")

_bind("po_labor_line_descriptor", ["fin_document_detail"], """
select fin_document_detail_key as po_labor_line_descriptor_key, fin_document_key as po_key,
       cast(line_no % 100 as int) as line_id, account_key, organization_key,
       concat('POL-', cast(line_no % 1000 as string)) as reference
from {fin_document_detail} where detail_type = 'L' and line_no % 8 = 0""")

_bind("po_expense_line_descriptor", ["fin_document_detail"], """
select fin_document_detail_key as po_expense_line_descriptor_key, fin_document_key as po_key,
       cast(line_no % 100 as int) as line_id, account_key, organization_key,
       concat('POE-', cast(line_no % 1000 as string)) as reference
from {fin_document_detail} where detail_type = 'E' and line_no % 8 = 0""")

_bind("expense_type", [], f"""
select expense_type_key, expense_type, expense_type_name
from {_values([(1, 'TRAVEL', 'Travel'), (2, 'MEALS', 'Meals'), (3, 'ADVANCE', 'Advance'),
               (4, 'CASH-RETURN', 'Cash return'), (5, 'SUPPLIES', 'Supplies')],
              ['expense_type_key', 'expense_type', 'expense_type_name'])}""")


# --- expense reports (events) and item lines (financial details) ----------------
_bind("expense_report", ["events"], f"""
select distinct user_id * 10 + {WEEK_OF_TS} as expense_report_key, user_id as owner_key,
       cast(1 + user_id % 3 as bigint) as currency,
       case when user_id % 4 = 0 then cast(null as date) else make_date(2024, 2, cast(1 + user_id % 20 as int)) end
         as date_completed,
       make_date(2024, 2, cast(3 + user_id % 20 as int)) as post_date,
       case when user_id % 5 = 0 then 'Open' else 'Approved' end as status
from {{events}} where event_type in ('purchase', 'click')""")

_bind("expense_data", ["events"], f"""
select event_id as expense_data_key, user_id * 10 + {WEEK_OF_TS} as expense_report_key,
       cast(1 + event_id % 5 as bigint) as expense_type_key,
       case when event_id % 3 = 0 then cast(null as string) else concat('exp ', cast(event_id as string)) end as comments,
       cast(ts as date) as expense_date, concat('summary ', event_type) as summary
from {{events}} where event_type in ('purchase', 'click')""")

_bind("expense_data_allocation", ["events"], """
select event_id as expense_data_allocation_key, event_id as expense_data_key, user_id % 10 as project_key,
       cast(1 + event_id % 3 as bigint) as project_type_key,
       case when event_id % 4 = 0 then cast(null as bigint) else cast(1 + event_id % 5 as bigint) end as task_key,
       case when event_id % 3 = 0 then event_id % 40 end as invoice_key,
       case when event_id % 13 = 0 then event_id end as vendor_invoice_key,
       case when event_id % 5 = 0 then cast(null as bigint) else event_id % 50 end as post_history_key,
       event_id % 50 as cost_post_history_key, cast(event_id % 5 as bigint) as cost_struct_odc_key,
       cast(10 + event_id % 90 as decimal(18,2)) as amount, cast(12 + event_id % 95 as decimal(18,2)) as bill_amount,
       cast(1 + event_id % 3 as bigint) as bill_currency, cast(9 + event_id % 80 as decimal(18,2)) as ic_cost_amount,
       cast(1 as bigint) as ic_cost_currency
from {events} where event_type in ('purchase', 'click')""")

_bind("journal_expense", ["events"], _journal("expense_data_allocation_key", "event_type in ('purchase', 'click')")
      .replace("case when event_id % 2 = 0 then 6 else 3 end", "case when event_id % 2 = 0 then 18 else 3 end"))


def _detail_journal(key_filter: str) -> str:
    return f"""
select fin_document_detail_key, cast(debit_amount * cast(0.2 as decimal(3,1)) as decimal(18,2)) as amount,
       case line_no % 6 when 0 then 5 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 9 else 1 end
         as category, transaction_date + cast(line_no % 10 as int) as journal_trans_date
from {{fin_document_detail}} where {key_filter}
union all
select fin_document_detail_key, cast(line_no % 70 as decimal(18,2)), 3, transaction_date + 20
from {{fin_document_detail}} where {key_filter} and line_no % 2 = 0"""


_bind("journal_document_labor", ["fin_document_detail"], _detail_journal("detail_type = 'L'"))
_bind("journal_document_expense", ["fin_document_detail"], _detail_journal("detail_type = 'E'"))
_bind("journal_document_item", ["fin_document_detail"], _detail_journal("detail_type = 'I'"))

_bind("invcd_document_labor", ["fin_document_detail"], """
select fin_document_detail_key, line_no % 40 as invoice_key,
       cast((line_no % 5) * 0.25 as decimal(18,6)) as writeoff_quantity
from {fin_document_detail} where line_no % 7 in (0, 1)""")

_bind("fin_document_det_proj_item", ["fin_document_detail"], """
select fin_document_detail_key, line_no % 10 as project_key,
       case when line_no % 3 = 0 then cast(null as bigint) else cast(1 + line_no % 5 as bigint) end
         as task_key,
       cast(1 + line_no % 3 as bigint) as project_type_key
from {fin_document_detail} where detail_type = 'I'""")

_bind("fin_doc_det_item", ["fin_document_detail"], """
select fin_document_detail_key, cast(1 + line_no % 6 as bigint) as item_key,
       cast(1 + line_no % 3 as bigint) as uom_key,
       cast(1 + line_no % 12 as decimal(18,6)) as quantity
from {fin_document_detail} where detail_type = 'I' and line_no % 9 <> 0""")

_bind("fin_document_detail_item", ["fin_document_detail"], """
select fin_document_detail_key, cast(line_no % 5 as bigint) as cost_struct_odc_key,
       cast(1 + line_no % 5 as bigint) as expense_type_key,
       case when line_no % 3 = 0 then line_no % 40 end as invoice_key,
       case when line_no % 4 = 2 then cast(null as bigint) else line_no % 50 end
         as post_history_key,
       debit_amount as amount, cast(debit_amount * cast(1.2 as decimal(3,1)) as decimal(18,2)) as bill_amount,
       cast(1 + line_no % 3 as bigint) as bill_currency
from {fin_document_detail} where detail_type = 'I'""")

_bind("item", [], f"""
select item_key, code, name
from {_values([(k, f'ITM{k}', f'Item {k}') for k in range(1, 7)], ['item_key', 'code', 'name'])}""")

_bind("unit_of_measure", [], f"""
select uom_key, name
from {_values([(1, 'Each'), (2, 'Box'), (3, 'Hour')], ['uom_key', 'name'])}""")


DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# ``customer`` is both a driver table and the ledger's org table; the binding
# named ``customer`` reads the driver's region/nation/supplier only, so the
# driver's own customer table is exposed to bindings as ``tpch_customer``.
_RENAMED = {"customer": "tpch_customer"}


def _driver_name(dep: str) -> str:
    return _RENAMED.get(dep, dep)


# project binding reads the *driver* customer table.
BINDINGS["project"] = Binding(
    "project", ("tpch_customer",), BINDINGS["project"].sql.replace("{customer}", "{tpch_customer}")
)


def closure(names) -> list[str]:
    """Bindings needed for ``names``, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(n):
        if n in seen or n not in BINDINGS:
            return
        seen.add(n)
        for d in BINDINGS[n].deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def duckdb_prefix(names) -> str:
    """``WITH`` clauses defining ``names`` over DuckDB's pre-registered views."""
    order = closure(names)
    parts = []
    if any("tpch_customer" in BINDINGS[n].deps for n in order):
        # must precede the ``customer`` CTE, which shadows the driver view
        parts.append("tpch_customer AS (select * from customer)")
    for n in order:
        b = BINDINGS[n]
        parts.append(f"{n} AS ({b.sql.format(**{d: d for d in b.deps})})")
    return ",\n".join(parts)


# Bindings that join, aggregate or unite driver tables.  In a real deployment
# these are stored ERP tables; a report that reads one from many places would
# derive it again for every reader (column pruning makes every copy different,
# so Spark cannot reuse the exchange).  They are staged: written once to the
# shared folder and read as Parquet until a driver table under them changes.
# Bindings that only project one driver table stay views.
STAGED = frozenset({
    "customer", "account", "project", "person", "org_tree", "org_fin_tree", "org_cost_pool_tree", "acct_fin_tree", "acct_cost_pool_tree",
    "access_customer_view", "org_access_hierarchy", "person_time", "person_accrual_plan", "person_rate", "expense_report",
    "approval_group_submitter", "cost_pool_group_calc", "cost_pool_group_calc_budget", "cost_pool_calc", "cost_pool_source_calc",
    "cost_pool_basis_calc", "project_controller", "project_open_access_view", "project_fee", "project_intercompany", "fin_document_detail",
})

# Staged tables that many tables and reports meet by one key: stored in buckets
# of that key, one for each shuffle partition, so that these joins move no rows.
BUCKETED = {"fin_document_detail": ["fin_document_detail_key"]}

# Driver columns by which the window of a staged binding groups: the driver's rows
# are dealt by them as they are, before the binding derives further columns,
# which the window's own exchange would move as well.
DEALT = {"fin_document_detail": {"lineitem": ["l_orderkey", "l_linenumber"]}}


def driver_tables(name: str) -> set[str]:
    """The driver tables that a binding is derived from."""
    if name not in BINDINGS:
        return {"customer" if name == "tpch_customer" else name}
    return set().union(*[driver_tables(d) for d in BINDINGS[name].deps])


def recipe(name: str) -> str:
    """The SQL of a binding and of those under it."""
    b = BINDINGS.get(name)
    return "" if b is None else "\n".join([b.sql, *(recipe(d) for d in b.deps)])


class Ledger:
    """Ledger tables over one scale-factor folder.

    Bindings are lazy views; those in ``STAGED`` are written on first use to
    ``store`` (default: a folder in the session's checkpoint folder) and read
    from there.  ``stage=False`` leaves them as views.
    """

    def __init__(self, spark, sf_dir: str, stage: bool = True, store: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.stage = stage
        self._store = store
        self._held: dict[str, object] = {}
        self._lock = threading.RLock()

    @functools.cached_property
    def store(self) -> TableStore:
        return TableStore(self.spark, self._store or posixpath.join(ensure_checkpoint_dir(self.spark), "ledger-store"))

    def staged_name(self, name: str) -> str:
        """A staged table's name: one folder holds the tables of several ledgers."""
        return f"{name}-{hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]}"

    def input_paths(self, names) -> list[str]:
        """Paths of the driver tables under some bindings."""
        return [f"{self.sf_dir}/{t}.parquet" for t in sorted(set().union(*[driver_tables(n) for n in names]))]

    def driver(self, name: str):
        real = "customer" if name == "tpch_customer" else name
        key = f"driver {real}"
        if key not in self._held:
            self._held[key] = load(self.spark, self.sf_dir, real)
        return self._held[key]

    def derived(self, name: str):
        """A binding as a view over the tables under it."""
        b, dealt = BINDINGS[name], DEALT.get(name, {})
        frames = {d: self.table(d) if d in BINDINGS else self.driver(d) for d in b.deps}
        return self.spark.sql(b.sql, **{d: f.repartition(*dealt[d]) if d in dealt else f for d, f in frames.items()})

    def table(self, name: str):
        with self._lock:
            if name not in self._held:
                if self.stage and name in BUCKETED:
                    self._held[name] = self.store.get_bucketed(
                        self.staged_name(name), self.input_paths([name]), recipe(name), lambda: self.derived(name),
                        BUCKETED[name], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                elif self.stage and name in STAGED:
                    self._held[name] = self.store.get(self.staged_name(name), self.input_paths([name]), recipe(name),
                                                      lambda: self.derived(name))
                else:
                    self._held[name] = self.derived(name)
            return self._held[name]

    def __getattr__(self, name):
        if name in BINDINGS:
            return self.table(name)
        raise AttributeError(name)
