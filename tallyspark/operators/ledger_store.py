"""The general ledger as it is stored for reports.

``LedgerStore`` stands in for a ledger source and keeps two tables of its own
(``TableStore``: written once, again when an input or the recipe changes):

* ``general_ledger`` by fiscal year.  Reports of the trailing months join the
  calendar on year and month, so Spark prunes years it does not need when the
  query runs (dynamic partition pruning).
* ``movements``, debit minus credit per (account, org, month, currency pair),
  bucketed by (account, org).  Balances group and sort by that key where the
  rows lie, without an exchange.  A hot key has no more rows here than months
  and currency pairs, so its bucket is no larger than others.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import recipe
from ..sources.store import TableStore
from . import balances

GL, MOVEMENTS = "general_ledger", "movements"


class LedgerStore:
    """A ledger whose GL and monthly movements are staged under ``folder`` (default: where the ledger stages its tables)."""

    def __init__(self, lg, folder: str | None = None, buckets: int | None = None):
        self.lg = lg
        self.tables = TableStore(lg.spark, folder or lg.store.folder)
        self.buckets = buckets or int(lg.spark.conf.get("spark.sql.shuffle.partitions"))
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name):
        return getattr(self.lg, name)

    def _by_year(self) -> DataFrame:
        # a row whose month is in no calendar keeps a null year
        years = F.broadcast(self.lg.fiscal_month.select("fiscal_month_key", "fiscal_year_key"))
        return self.lg.general_ledger.join(years, "fiscal_month_key", "left")

    @property
    def general_ledger(self) -> DataFrame:
        if GL not in self._held:
            self._held[GL] = self.tables.get(self.lg.staged_name(f"{GL}-by-year"), self.lg.input_paths([GL]),
                                             recipe(GL) + recipe("fiscal_month"), self._by_year, ("fiscal_year_key",))
        return self._held[GL]

    @property
    def movements(self) -> DataFrame:
        if MOVEMENTS not in self._held:
            self._held[MOVEMENTS] = self.tables.get_bucketed(
                self.lg.staged_name(MOVEMENTS), self.lg.input_paths([GL]), recipe(GL) + inspect.getsource(balances.sum_movements),
                lambda: balances.sum_movements(self.lg.general_ledger), balances.KEY, self.buckets)
        return self._held[MOVEMENTS]
