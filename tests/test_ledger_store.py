"""The GL stored by fiscal year and its monthly movements by (account, org)."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import balances as B, ledger as L
from tallyspark.operators.ledger_store import LedgerStore
from tallyspark.params import DEFAULT as P


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(lg):
    return LedgerStore(lg)


REPORTS = {
    "d20": lambda lg: B.zero_fill_grid(lg, P.as_of), "d21": lambda lg: B.running_balance(lg, P.as_of),
    "d22": lambda lg: B.ytd_balance(lg, P.as_of), "d24": lambda lg: L.gl_detail(lg, P.as_of),
    "d26": lambda lg: L.ledger_totals(lg, P.viewer, P.as_of, P.kpi_orgs, P.kpi_accounts),
    "d15": lambda lg: L.budget_actual_fact(lg, P.viewer, P.as_of),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_stored_ledger_gives_the_same(lg, stored, name):
    assert rows(REPORTS[name](stored)) == rows(REPORTS[name](lg))


@pytest.mark.parametrize("name", ["d24", "d26", "d15"])
def test_years_are_pruned(stored, name):
    df = REPORTS[name](stored)
    text = plan(df).split("PartitionFilters: [")[1].split("]")[0]
    assert "fiscal_year_key" in text and ">= Subquery" in text.replace("scalar-subquery", "Subquery")
    df.collect()
    ran = df._jdf.queryExecution().executedPlan()
    read = [int(x) for x in re.findall(r"number of partitions read: (\d+)", str(metrics(ran)))]
    assert read and max(read) < stored.general_ledger.select("fiscal_year_key").distinct().count()


def metrics(node):
    """``name: value`` of the metrics of all scans below a plan node that ran."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return metrics(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return metrics(node.plan())
    out, m = [], node.metrics()
    if node.nodeName().startswith("Scan") and m.contains("numPartitions"):
        out.append(f"number of partitions read: {m.apply('numPartitions').value()}")
    kids = node.children()
    for k in range(kids.size()):
        out += metrics(kids.apply(k))
    return out


@pytest.mark.parametrize("name", ["d21", "d22"])
def test_movements_need_no_exchange(stored, name):
    text = plan(REPORTS[name](stored))
    assert "lineitem.parquet" not in text and "Bucketed: true" in text
    keyed = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "org_key" in x]
    assert not keyed, keyed


def test_period_balances_read_no_ledger_rows(stored):
    assert "lineitem.parquet" not in plan(B.period_balances(stored, P.as_of))


def test_layout_is_found_by_another_session_entry(spark, lg, tmp_path):
    first = LedgerStore(lg, f"{tmp_path}/store", buckets=3)
    want = rows(first.movements)
    entry = first.tables.spark.catalog.listTables(pattern="tallyspark_*")
    for t in entry:
        spark.sql(f"DROP TABLE {t.name}")  # an external table: its files stay
    again = LedgerStore(lg, f"{tmp_path}/store", buckets=3)
    assert rows(again.movements) == want and not again.tables.written
    assert rows(B.sum_movements(lg.general_ledger)) == want


def test_months_outside_the_calendar_are_kept(spark, lg):
    """Their amounts are in no balance, but their currencies count for the gaps of their key."""
    odd = lg.general_ledger.limit(40).withColumn("fiscal_month_key", F.lit(180001).cast("long"))
    few = SimpleNamespace(general_ledger=odd, **{n: getattr(lg, n) for n in ("account", "fiscal_month", "fiscal_quarter", "fiscal_year")})
    few.movements = B.sum_movements(odd)
    got = B.running_balance(few, P.as_of)
    assert got.count() > 0 and got.where("amount <> 0").count() == 0
