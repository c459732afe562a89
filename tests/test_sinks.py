"""Report sink and partitioned ledger layout (S5, partition pruning)."""

import tempfile

from pyspark.sql import functions as F

from tallyspark.operators import postings as PS
from tallyspark.operators.posting_store import PostingStore
from tallyspark.sources.sinks import write_partitioned_ledger, write_report


def test_partitioned_ledger_prunes(spark, lg):
    path = tempfile.mkdtemp(prefix="tallyspark-gl-") + "/gl"
    write_partitioned_ledger(lg, path)
    back = spark.read.parquet(path)
    assert back.count() == lg.general_ledger.count()
    q = back.filter(F.col("fiscal_year_key") == 1998)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "fiscal_year_key" in plan
    assert q.count() == lg.general_ledger.filter(F.col("fiscal_month_key").between(199801, 199812)).count()


def test_write_report_roundtrip(spark, lg):
    path = tempfile.mkdtemp(prefix="tallyspark-rep-") + "/r"
    df = lg.account
    write_report(df, path, partition_by=("type",))
    assert spark.read.parquet(path).count() == df.count()


def test_summary_checkpoint_matches(spark, lg):
    """All sources as one union, against the staged sources with the detail checkpointed."""
    a = PS.posting_summary(lg, 900001, "2029-01-15 09:00:00", "2024-01-10 00:00:00")
    b = PS.posting_summary(lg, 900001, "2029-01-15 09:00:00", "2024-01-10 00:00:00", checkpoint=True, store=PostingStore(lg))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
