"""Staged posting store (U2, D49-D50): each posting source written once, by posting month.

The union of the fifteen sources is the widest plan of the library: every
source joins its own lines, journals and lookups.  The store writes each
source as a table of its own, partitioned by the month of its transactions
(``trans_month``, year x 100 + month), and reads the union back from Parquet:

* a report plans fifteen scans in place of fifteen join trees, and its date
  range is a partition filter, so months outside it are never listed;
* a source is written again only if one of the driver tables under its
  bindings, or the code that derives it, has changed (``TableStore``);
* sources are independent jobs, a few at a time, so one lost executor repeats
  tasks of one source;
* rows are written where their joins leave them, a file for each task and
  month: dealing the wide rows out by month would move all of them once more.
  Six sources meet documents, which are found once for all of them by narrow
  rows (``line_documents``) and lie by the line's key, as the lines do.
"""

from __future__ import annotations

import functools
import inspect
import threading
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..sources import fixtures
from ..sources.store import TableStore, digest
from . import joins, postings
from .calendar import month_start

MONTH = "trans_month"
#: Sources written at a time.
JOBS = 4


class _Recorder:
    """A ledger that notes which tables are asked for."""

    def __init__(self, lg):
        self._lg, self.seen = lg, set()

    def table(self, name: str):
        self.seen.add(name)
        return self._lg.table(name)

    def __getattr__(self, name):
        return self.table(name) if name in fixtures.BINDINGS else getattr(self._lg, name)


@functools.cache
def _recipe(source: str) -> str:
    """The code that derives a source: the modules it draws on and all bindings."""
    code = [inspect.getsource(m) for m in (postings, joins, labels)]
    return "\n".join([source, *code, *(f"{b.name}: {b.sql}" for b in fixtures.BINDINGS.values())])


class _Lines:
    """A ledger as the sources see it: the document of each line (``line_documents``) is staged, in buckets of the line's key.

    Six sources meet documents; with it their lines, which lie in buckets of
    the same key, are moved for it no more.
    """

    def __init__(self, lg, tables: TableStore):
        self._lg, self._tables, self._lock, self._found = lg, tables, threading.Lock(), None

    @property
    def line_documents(self) -> DataFrame:
        with self._lock:
            if self._found is None:
                lg = self._lg
                self._found = self._tables.get_bucketed(
                    lg.staged_name("line-documents"), lg.input_paths(["fin_document_detail", "fin_document", "vendor_invoice"]),
                    _recipe("line_documents"), lambda: postings.line_documents(lg), ["fin_document_detail_key"],
                    int(lg.spark.conf.get("spark.sql.shuffle.partitions")))
            return self._found

    def __getattr__(self, name):
        return getattr(self._lg, name)


class PostingStore:
    """The posting sources of one ledger, staged under ``folder`` (default: where the ledger stages its tables)."""

    def __init__(self, lg, folder: str | None = None):
        self.lg = lg
        self.tables = TableStore(lg.spark, folder or lg.store.folder)
        self._lines = _Lines(lg, self.tables)
        self._held: dict[str, DataFrame] = {}

    def _inputs(self, source: str) -> list[str]:
        """The driver tables under a source: those its manifest names if this code wrote it, else those that planning it asks for."""
        m = self.tables.manifest(self.lg.staged_name(source))
        if m is not None and m["recipe"] == digest(_recipe(source)):
            return [s[0] for s in m["inputs"]]
        seen = _Recorder(self.lg)
        postings.SOURCES[source](seen)
        return self.lg.input_paths(seen.seen)

    def _build(self, source: str) -> DataFrame:
        return postings.SOURCES[source](self._lines).withColumn(MONTH, F.year("trans_date") * 100 + F.month("trans_date"))

    def source(self, name: str) -> DataFrame:
        """One source with its ``trans_month``, written first if its inputs or its code have changed."""
        if name not in self._held:
            self._held[name] = self.tables.get(self.lg.staged_name(name), self._inputs(name), _recipe(name), lambda: self._build(name), (MONTH,),
                                               rebalance=False)
        return self._held[name]

    def read(self, names: Iterable[str] | None = None, as_of: str | None = None, months_back: int = 0) -> DataFrame:
        """The union of the sources; with ``as_of`` only months from ``months_back`` before its month on."""
        names = list(names or postings.SOURCES)
        with ThreadPoolExecutor(JOBS) as pool:
            parts = list(pool.map(self.source, names))
        if as_of is not None:
            first = F.add_months(month_start(as_of), -months_back)
            parts = [p.filter(F.col(MONTH) >= F.year(first) * 100 + F.month(first)) for p in parts]
        return functools.reduce(DataFrame.unionByName, [p.select(*postings.SOURCE_COLUMNS) for p in parts])
