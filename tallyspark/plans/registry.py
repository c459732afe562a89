"""Query registry: name -> (builder over a ledger source, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..sources.fixtures import Ledger


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable  # (ledger source) -> DataFrame
    oracle: str | None


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, build: Callable, oracle: str | None) -> None:
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    REGISTRY[name] = QuerySpec(name, build, oracle)


def _load_all() -> None:
    # importing the modules registers their queries
    from . import (  # noqa: F401
        accrual_queries,
        balance_queries,
        dim_queries,
        ledger_queries,
        payables_queries,
        pool_queries,
        posting_queries,
        report_queries,
    )


def all_queries() -> dict[str, QuerySpec]:
    _load_all()  # also when some of the modules were imported on their own
    return dict(REGISTRY)


def spark_callables() -> dict[str, Callable]:
    out = {}
    for name, spec in all_queries().items():
        out[name] = (lambda b: (lambda spark, sf_dir: b(Ledger(spark, sf_dir))))(spec.build)
    return out


def oracle_sqls() -> dict[str, str]:
    return {n: s.oracle for n, s in all_queries().items() if s.oracle is not None}
