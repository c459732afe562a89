"""The access filters for several viewers against the same definitions in SQL, and the order of the sorted reports.

1 is an administrator, 2 holds global grants, 3 and 4 scoped and delegated
ones, 5 none (but controls a project), 9 one by organization; the default viewer has a bit of each.
"""

import datetime as dt

import pytest

from check import digest
from tallyspark.operators import accruals as AC
from tallyspark.operators import ledger as L
from tallyspark.operators import payables as V
from tallyspark.operators import postings as PS
from tallyspark.params import DEFAULT as P
from tallyspark.plans import accrual_queries as AQ
from tallyspark.plans import ledger_queries as LQ
from tallyspark.plans import payables_queries as VQ
from tallyspark.plans import posting_queries as PQ
from tallyspark.plans.registry import spark_callables
from tallyspark.plans.sqltext import with_fixtures

VIEWERS = [1, 2, 3, 4, 5, 9, P.viewer]
REPORTS = {
    "budget_actual": (lambda lg, v: L.budget_actual_fact(lg, v, P.as_of),
                      lambda v: with_fixtures(LQ.BUDGET_FIXTURES, LQ.budget_actual_sql(v, P.as_of))),
    "invoice_header": (lambda lg, v: V.vendor_invoice_header(lg, v, P.as_of),
                       lambda v: with_fixtures(VQ.FIX, "SELECT * FROM headers", VQ.header_ctes(v, P.as_of))),
    "accrual_report": (lambda lg, v: AC.accrual_report(lg, v, AQ.BEGIN_UNTIL, AQ.END_UNTIL),
                       lambda v: AQ.report_sql(v, AQ.BEGIN_UNTIL, AQ.END_UNTIL)),
    "project_dim": (PS.project_dim, lambda v: with_fixtures(PQ.FIX, "SELECT * FROM projects", PQ.project_dim_ctes(v))),
}


@pytest.mark.parametrize("viewer", VIEWERS)
@pytest.mark.parametrize("report", sorted(REPORTS))
def test_viewer_sees_what_the_definitions_say(report, viewer, lg, duck):
    build, sql = REPORTS[report]
    df = build(lg, viewer)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(sql(viewer))
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, got)[0] == digest(cols, want)[0]
    if viewer == 1:
        assert got
    if viewer == 5 and report != "project_dim":  # a person of the events, so also a project's controller
        assert not got


def test_rates_stay_hidden_without_a_role(lg):
    rows = AC.accrual_report(lg, 9, AQ.BEGIN_UNTIL, AQ.END_UNTIL).collect()
    rates = [i for i, c in enumerate(AC.REPORT_COLUMNS) if c.startswith("person_cost_rate")]
    assert rows and all(r[i] is None for r in rows for i in rates)
    shown = AC.accrual_report(lg, 1, AQ.BEGIN_UNTIL, AQ.END_UNTIL).collect()
    assert any(r[i] is not None for r in shown for i in rates)


def _asc(x):  # nulls first
    return (x is not None, x if x is not None else 0)


def _desc(x):  # nulls last
    if x is None:
        return (1, 0)
    return (0, -(x.toordinal() if isinstance(x, (dt.date, dt.datetime)) else x))


ORDERS = {
    "d32_aop_vs_actual": lambda r: (_asc(r["c4"]), _desc(r["c3"])),
    "d42_accrual_report": lambda r: (_asc(r["c0"]), _asc(r["c1"]), f"{r['c3'] or ''}, {r['c4'] or ''}", _desc(r["c6"]), _desc(r["c8"])),
    "d46_cost_pool_report": lambda r: (_asc(r["c0"]), _asc(r["c16"]), _asc(r["c1"]), _desc(r["c9"])),
    "d58_posting_summary": lambda r: (f"{r['c0'] or ''} {r['c1'] or ''}", f"{r['c2'] or ''} {r['c3'] or ''}"),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_report_comes_sorted(name, spark):
    rows = spark_callables()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1
    keys = [ORDERS[name](r) for r in rows]
    assert keys == sorted(keys)


def test_budgets_need_a_role(lg):
    money = PS.PROJECT_BILL_BUDGETS + PS.PROJECT_COST_BUDGETS
    shown, hidden = PS.project_dim(lg, 1).collect(), PS.project_dim(lg, P.viewer).collect()
    assert all(any(r[c] is not None for r in shown) for c in money)
    assert hidden and all(r[c] is None for r in hidden for c in money)
