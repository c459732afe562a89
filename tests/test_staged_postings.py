"""What staging the postings moves and leaves on disk (F1, F3 of round 4), and that the results stay the same."""

import contextlib
import io
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import joins
from tallyspark.operators import postings as PS
from tallyspark.operators.posting_store import PostingStore
from tallyspark.sources.fixtures import Ledger
from tallyspark.sources.store import CLEANUP, TableStore, shuffles_end_with_writes


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture
def small_lists_only(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # the code lists of the bindings are below, tables of rows above
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("source", ["fin_labor", "fin_expense", "fin_item"])
def test_lines_stay_in_place_for_documents_and_journals(lg, small_lists_only, source):
    df = PostingStore(lg)._build(source)
    assert "Exchange hashpartitioning(fin_document" not in plan(df)
    assert "Exchange hashpartitioning(cost_struct" not in plan(df)


def test_numbering_lines_moves_driver_columns(spark, lg):
    text = plan(Ledger(spark, lg.sf_dir).derived("fin_document_detail"))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_COL" in text


def test_documents_by_line_are_the_documents(spark):
    """Keys that repeat, lines of two documents under one key, lines without one, invoices with another number."""
    rng = random.Random(5)
    lines = [(rng.choice([1, 1, 2, 3, 4, 5, 6, None]), rng.choice([10, 11, 12, 13, 14, None]), n) for n in range(60)]
    docs = [(10, 0, "Open", "VI10", 1), (11, 0, None, "VI11", 2), (11, 1, "Open", "VI11b", 2), (12, 3, "Open", None, 3), (13, 0, "x", "VI13", 1), (None, 0, "x", "no", 1)]
    frame = spark.createDataFrame
    lg = SimpleNamespace(
        fin_document=frame(docs, "fin_document_key long, document_type int, status string, document_number string, currency long")
        .withColumn("post_date", F.lit("2024-01-02").cast("date")),
        vendor_invoice=frame([(11,), (11,), (12,), (13,), (99,), (None,)], "fin_document_key long"),
        fin_document_detail=frame([r[:2] for r in lines], "fin_document_detail_key long, fin_document_key long"))
    df = frame(lines, "fin_document_detail_key long, fin_document_key long, n int").filter("fin_document_detail_key is not null")
    want = PS._met_documents(lg, df)
    lg.line_documents = PS.line_documents(lg)
    assert "_vendor" in PS._met_documents(lg, df).columns
    assert rows(PS._met_documents(lg, df), *want.columns) == rows(want, *want.columns) and want.count() > 60


def test_split_join_is_a_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (9, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "no")], "k int, w string")
    assert rows(joins.left_join_split(left, right, "k"), "k", "v", "w") == rows(left.join(right, "k", "left"), "k", "v", "w")


def test_written_without_moving_rows(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).withColumn("m", F.lit(202401) + F.col("id") % 2)
    store = TableStore(spark, f"{tmp_path}/s")
    got = store.get("t", [], "r", lambda: df, ("m",), rebalance=False)
    assert len(got.inputFiles()) == 8 and rows(got, "id", "m") == rows(df, "id", "m")
    assert all(f.endswith(".zstd.parquet") for f in got.inputFiles())


def test_setting_is_given_back(spark):
    was = spark.conf.get(CLEANUP, None)
    with shuffles_end_with_writes(spark):
        with shuffles_end_with_writes(spark):
            assert spark.conf.get(CLEANUP) == "true"
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP, None) == was
