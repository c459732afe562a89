"""Staged tables: written once, read back, written again when an input or the recipe changes."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import dims, postings as PS
from tallyspark.operators.posting_store import MONTH, PostingStore
from tallyspark.plans.posting_queries import POSTING_AS_OF, SUMMARY_FROM
from tallyspark.sources.fixtures import STAGED, Ledger
from tallyspark.sources.store import TableStore

CHARGES = ["fixed_price", "fee_cap", "onetime_charge"]


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_is_written_again_only_after_a_change(spark, tmp_path):
    source = f"{tmp_path}/in.parquet"
    spark.range(5).write.parquet(source)
    store = lambda: TableStore(spark, f"{tmp_path}/store")
    build = lambda: spark.read.parquet(source).withColumn("k", F.col("id") % 2)
    first = store()
    held = first.get("t", [source], "v1", build, ["k"])
    assert first.written == ["t"] and sorted(r["id"] for r in held.collect()) == [0, 1, 2, 3, 4]
    assert held.columns == ["id", "k"]
    again = store()
    assert again.get("t", [source], "v1", lambda: pytest.fail("not needed"), ["k"]).count() == 5 and not again.written
    spark.range(7).write.mode("overwrite").parquet(source)
    changed = store()
    assert changed.get("t", [source], "v1", build, ["k"]).count() == 7 and changed.written == ["t"]
    assert held.where("k = 1").count() == 2  # who has the old version open keeps it
    recipe = store()
    assert recipe.get("t", [source], "v2", build, ["k"]).count() == 7 and recipe.written == ["t"]
    assert recipe.drop_old("t") == 2 and recipe.drop_old("t") == 0 and recipe.drop_old("none") == 0
    assert store().get("t", [source], "v2", build, ["k"]).count() == 7


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    source = f"{tmp_path}/in.parquet"
    spark.range(5).write.parquet(source)
    TableStore(spark, f"{tmp_path}/store").get("t", [source], "v1", lambda: spark.range(3))
    broken = lambda: spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"))
    with pytest.raises(Exception):
        TableStore(spark, f"{tmp_path}/store").get("t", [source], "v2", broken)
    assert TableStore(spark, f"{tmp_path}/store").get("t", [source], "v1", lambda: pytest.fail("not needed")).count() == 3


def test_empty_table_keeps_its_columns(spark, tmp_path):
    t = TableStore(spark, f"{tmp_path}/store").get("t", [], "v1", lambda: spark.range(0).selectExpr("id", "cast(id as int) as k"), ["k"])
    assert t.columns == ["id", "k"] and t.count() == 0


def test_staged_bindings_equal_views(spark, lg):
    views = Ledger(spark, lg.sf_dir, stage=False)
    for name in sorted(STAGED - {"fin_document_detail"}):
        assert rows(lg.table(name)) == rows(views.table(name)), name


def test_store_gives_the_union_of_the_sources(spark, lg, tmp_path):
    store = PostingStore(lg, f"{tmp_path}/postings")
    assert rows(store.read(CHARGES)) == rows(PS.posting_sources(lg, CHARGES))
    assert len(store.tables.written) == 3
    second = PostingStore(Ledger(spark, lg.sf_dir), f"{tmp_path}/postings")
    recent = second.read(CHARGES, "1998-03-10 00:00:00", 12)
    assert not second.tables.written
    assert rows(recent) == rows(PS.posting_sources(lg, CHARGES).where("trans_date >= '1997-03-01'"))
    assert "PartitionFilters: [isnotnull(trans_month" in plan(recent)
    assert store.source("fee_cap").where(F.col(MONTH) != F.year("trans_date") * 100 + F.month("trans_date")).count() == 0


def test_detail_from_the_store_equals_the_union(spark, lg, tmp_path):
    store = PostingStore(lg, f"{tmp_path}/postings")
    names = [*CHARGES, "timesheet_labor"]
    for viewer in (900001, 5):
        stored = PS.posting_detail(lg, viewer, POSTING_AS_OF, 600, names, store=store)
        assert rows(stored) == rows(PS.posting_detail(lg, viewer, POSTING_AS_OF, 600, names))


def test_summary_plan_is_short(spark, lg):
    df = PS.posting_summary(lg, 900001, POSTING_AS_OF, SUMMARY_FROM, store=PostingStore(lg))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len(lines) < 1000, len(lines)


@pytest.mark.parametrize("columns", [["project_key"], ["project_code", "status"], ["project_manager_email", "pi"], ["owning_le_name", "project_fee_method"]])
def test_project_columns_come_with_the_same_rows(lg, columns):
    if "pi" in columns:
        with pytest.raises(ValueError, match="no such columns: pi"):
            PS.project_dim(lg, 900001, columns)
        return
    assert rows(PS.project_dim(lg, 900001, columns)) == rows(PS.project_dim(lg, 900001).select(*columns))


def test_unwanted_lookups_are_not_planned(lg):
    few, all_ = (plan(PS.project_dim(lg, 900001, c)).count("Join") for c in (["project_key"], None))
    assert few < all_ - 15, (few, all_)
    assert plan(dims.account_dim(lg, columns=["account_key", "acct_type"])).count("Join") == 0
    assert plan(dims.org_dim(lg, columns=["customer_key", "legal_entity_name"])).count("Join") == 1


@pytest.mark.parametrize("columns", [["org_consolidation_lv3_name", "customer_key"], ["org_fin_lv6_code"], ["active"]])
def test_org_columns_come_with_the_same_rows(lg, columns):
    assert rows(dims.org_dim(lg, columns=columns)) == rows(dims.org_dim(lg).select(*columns))
