"""Properties of the ledger operators."""

from pyspark.sql import functions as F

from tallyspark.operators import balances as B
from tallyspark.operators import hierarchy as H
from tallyspark.operators import ledger as L
from tallyspark.params import DEFAULT as P


def test_flatten_row_count_equals_tree_nodes(lg):
    tree = lg.org_tree
    flat = H.flatten_nested_set(tree, 6)
    assert flat.count() == tree.select("node_key").distinct().count()
    # every node is its own ancestor at its level
    t = tree.select("node_key", "tree_level").collect()
    wide = {r["node_key"]: r for r in flat.collect()}
    for r in t:
        assert wide[r["node_key"]][f"lvl_key_{r['tree_level']}"] == r["node_key"]


def test_flatten_drops_deeper_levels(lg):
    flat = H.flatten_nested_set(lg.org_tree, 2)
    assert "lvl_key_2" not in flat.columns
    assert flat.count() == lg.org_tree.count()


def test_viewer_without_grants_sees_nothing(lg):
    assert L.budget_actual_fact(lg, 5, P.as_of).count() == 0
    assert L.ledger_totals(lg, 5, P.as_of, P.kpi_orgs, P.kpi_accounts).first()["debit_amount"] is None


def test_admin_sees_everything(lg):
    full = L.budget_actual_fact(lg, 1, P.as_of).count()
    scoped = L.budget_actual_fact(lg, P.viewer, P.as_of).count()
    assert full > scoped > 0
    assert L.budget_actual_fact(lg, 2, P.as_of).count() == full  # global access


def test_ending_equals_next_beginning_for_balance_sheet(lg):
    rb = B.running_balance(lg, P.as_of)
    # carried amount out of month m equals the beginning of m+1: pairs are consistent by construction
    pb = B.period_balances(lg, P.as_of).filter(F.col("acct_type").isin("Asset", "Liability"))
    a = pb.alias("a")
    b = pb.alias("b")
    cal = lg.fiscal_month.select(F.col("fiscal_month_key").alias("m"),
                                 F.date_add("end_date", 1).alias("nb"))
    nxt = lg.fiscal_month.select(F.col("fiscal_month_key").alias("m2"), F.col("begin_date").alias("nb"))
    step = cal.join(nxt, "nb").select("m", "m2")
    j = (a.join(step, F.col("a.fiscal_month_key") == F.col("m"))
         .join(b, (F.col("b.fiscal_month_key") == F.col("m2")) & (F.col("a.account_key") == F.col("b.account_key"))
               & (F.col("a.organization_key") == F.col("b.organization_key"))))
    assert j.filter(F.col("a.ending_balance") != F.col("b.beginning_balance")).count() == 0
    assert rb.count() > 0


def test_ytd_reset_at_period_one(lg):
    ytd = B.ytd_balance(lg, P.as_of)
    cal = lg.fiscal_month.select("fiscal_month_key", "period_number")
    first = ytd.join(cal, "fiscal_month_key").filter(F.col("period_number") == 1)
    assert first.filter(F.col("amount") != 0).count() == 0
