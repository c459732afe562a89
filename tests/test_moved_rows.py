"""Facts are not moved for lookups (F1-F10 of round 3): plans without an exchange, and the joins that replace one."""

import contextlib
import io
import re

import pytest

from tallyspark.operators import balances as B
from tallyspark.operators import joins, ledger, payables, postings
from tallyspark.params import DEFAULT as P


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_size_guess(spark):
    """Spark broadcasts nothing of its own accord, as where every lookup table is over its threshold."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_ledger_detail_keeps_its_rows_in_place(lg, no_size_guess):
    text = plan(ledger.gl_detail(lg, P.as_of))
    assert "Exchange hashpartitioning(organization_key" not in text and "Exchange hashpartitioning(person_key" not in text


def test_balances_look_up_organizations_without_a_shuffle(lg, no_size_guess):
    assert "Exchange hashpartitioning(org_key" not in plan(B.period_balances(lg, P.as_of))


def test_statement_filters_organizations_not_rows(lg):
    whole = B.period_balances(lg, P.as_of).unionByName(ledger.gl_detail(lg, P.as_of).select(
        *[c for c in B.STATEMENT_COLUMNS])).count()
    for viewer in (1, P.viewer):
        mine = B.gl_statement(lg, viewer, P.as_of)
        allowed = {r[0] for r in ledger.finance_filter(lg, lg.customer, "customer_key", viewer).select("customer_key").collect()}
        assert {r[0] for r in mine.select("organization_key").distinct().collect()} <= allowed
        assert mine.count() <= whole and (viewer != 1 or mine.count() == whole)


def test_postings_are_not_moved_to_the_allowed_projects(lg, no_size_guess):
    x = postings.source_prebilled_labor(lg)
    text = plan(postings.filter_project_access(lg, x, "project_key", P.viewer))
    assert re.search(r"BroadcastHashJoin \[project_key#\d+L\], \[_allowed#", text)


def test_document_lines_are_stored_by_their_key(lg, no_size_guess):
    a = lg.fin_document_det_proj_labor.join(lg.fin_document_detail_labor, "fin_document_detail_key")
    assert "Exchange" not in plan(a)


def test_header_meets_lookup_tables_in_place(lg, no_size_guess):
    text = plan(payables.vendor_invoice_header(lg, P.viewer, P.as_of))
    for key in ("financial_org_key", "created_by", "posted_by", "submitted_by"):  # the access filter may move rows by the others
        assert f"Exchange hashpartitioning({key}#" not in text, key


def test_held_has_a_bound(spark, monkeypatch):
    t = spark.range(5)
    assert "broadcast" in joins.held(t)(t)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(joins, "HELD", 4)
    assert joins.held(t)(t) is t


LEFT = [(1, 10, "a"), (1, 10, "a"), (1, None, "b"), (None, 10, "c"), (2, 11, "d"), (2, 12, "e"), (3, 99, "f"), (None, None, "g")]
RIGHT = [(1, 10, "x"), (1, 10, "y"), (1, 11, "no"), (2, 12, None), (None, 10, "no"), (2, None, "no")]


def test_left_join_within_is_a_left_join(spark):
    df = spark.createDataFrame(LEFT, "by int, k int, v string").repartition(3)
    right = spark.createDataFrame(RIGHT, "by int, k int, w string")
    rows = lambda d: sorted(map(str, d.select("by", "k", "v", "w").collect()))
    assert rows(joins.left_join_within(df, right, "by", "k")) == rows(df.join(right, ["by", "k"], "left"))


def test_left_join_rare_is_a_left_join(spark):
    df = spark.createDataFrame([r for r in LEFT if r[0] is not None], "by int, k int, v string")
    right = spark.createDataFrame([(10, "x"), (10, "y"), (12, None), (None, "no")], "k int, w string")
    rows = lambda d: sorted(map(str, d.select("by", "k", "v", "w").collect()))
    assert rows(joins.left_join_rare(df, df, right, "k", "by")) == rows(df.join(right, "k", "left"))
