"""Report parameters.

The reference hard-codes "now" (GETDATE / current_date), the viewer and the
org/account literals.  Here they are arguments; ``DEFAULT`` holds the values
the registered queries use on the test data (whose dates span 1995-2002).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    as_of: str = "2000-06-15 10:30:00"  # timestamp: the time of day decides edge days
    viewer: int = 900001
    # D26 direct-cost KPI filters (org codes, account descriptions)
    kpi_orgs: tuple = ("S3", "S8", "S15", "S22", "S29", "S36", "S43", "S57", "S64", "S71")
    kpi_accounts: tuple = ("Account 3", "Account 7", "Account 11", "Account 15", "Account 19")
    # D27 revenue KPI filters
    rev_orgs: tuple = ("S1", "S6", "S9", "S12", "S18", "S21", "S27", "S30")
    rev_accounts: tuple = ("Account 2", "Account 6", "Account 10", "Account 14")
    extra: dict = field(default_factory=dict)

    @property
    def as_of_date(self) -> str:
        return self.as_of[:10]


DEFAULT = Params()
