"""Report output (S5) and the partitioned ledger layout.

Reports are returned as DataFrames; writing one is an explicit step.  A GL
stored partitioned by fiscal year lets every ``as_of``-relative filter on the
year prune whole directories at scan time (partition pruning), which matters
when the ledger holds decades of history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def display_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the column titles of a printed report (P1): ``names``, else words in capitals (fiscal_period: Fiscal Period).

    Two columns with the same title are an error.
    """
    titles = {c: (names or {}).get(c) or c.replace("_", " ").title() for c in df.columns}
    if len({t.lower() for t in titles.values()}) < len(titles):
        raise ValueError("two columns have the same title")
    return df.withColumnsRenamed(titles)


def write_report(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    """Write a report as parquet, optionally partitioned (e.g. by fiscal year)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_partitioned_ledger(lg, path: str) -> None:
    """Store the general ledger partitioned by fiscal year (key = month key div 100 via the calendar)."""
    cal = lg.fiscal_month.select("fiscal_month_key", "fiscal_year_key")
    gl = lg.general_ledger.join(F.broadcast(cal), "fiscal_month_key")
    # rows of a year meet in few tasks, but a large year is split between several (rebalanced by size)
    write_report(gl.hint("rebalance", "fiscal_year_key"), path, partition_by=("fiscal_year_key",))
