"""Account (D8) and organization (D9) dimensions, cash-flow columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import account_type_name, account_type_order
from .hierarchy import flatten_with_attributes
from .joins import Lookup, join_lookups, pick, reads

# An organization's own attributes.
USER_FIELDS = [f"user{i:02d}" for i in range(1, 21)]
ORG_ATTRIBUTES = [
    "email_1099", "vendor_1099", "recipient_name_1099", "federal_tax_id", "federal_tax_id_type", "financial_org", "legal_entity",
    "active", "classification", "entry_allowed", "begin_date", "end_date", "account_number", "industry", "sic_code", "sector",
    "customer_size", "stock_symbol", *USER_FIELDS, "transact_elimination_flag"]

ACCT_LEVELS = 10
ORG_LEVELS = 6

# Cash-flow category codes and names (anything else is one blank).
CASHFLOW_CATEGORIES = {
    "O": "Operating Activities",
    "I": "Investing Activities",
    "F": "Financing Activities",
    "C": "Cash",
}


def cashflow_category(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    expr = None
    for k, v in CASHFLOW_CATEGORIES.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr.otherwise(" ")


def _tree_lookup(tree, levels: int, attrs: DataFrame, key: str, attr_cols: list[str], prefix: str, on: str | None = None) -> Lookup:
    """Ancestor attributes by level, ``{prefix}{k}_{attr}``, for the node named by column ``on`` (default: ``key``)."""
    on = on or key
    return Lookup(lambda: flatten_with_attributes(tree(), levels, attrs, key, attr_cols, prefix).withColumnRenamed("node_key", on),
                  (on,), tuple(f"{prefix}{k}_{c}" for k in range(1, levels + 1) for c in attr_cols))


def _filled(attr: str, k: int, *prefixes: str):
    """Ragged fill (D6, D7): level k, k-1 .. 1 of the first tree, then of the next one."""
    names = [f"{p}{j}_{attr}" for p in prefixes for j in range(k, 0, -1)]
    return reads(*names)(F.coalesce(*names))


def account_dim(lg, levels: int = ACCT_LEVELS, columns=None) -> DataFrame:
    """Account with financial and cost-pool tree levels, type levels and cash flow.

    ``columns`` names the output columns wanted (default: all); a tree or
    lookup that none of them reads is not planned.
    """
    acct = lg.account
    attrs = acct.select("account_key", "account_code", "description", "type")
    lookups = [
        _tree_lookup(lambda: lg.acct_fin_tree, levels, attrs, "account_key", ["account_code", "description", "type"], "fin"),
        _tree_lookup(lambda: lg.acct_cost_pool_tree, levels, attrs, "account_key", ["account_code", "description"], "cp"),
        Lookup(lambda: lg.cashflow_account.select(F.col("cashflow_account_key").alias("account_key"), "rollup_account_key",
                                                  F.col("category").alias("_cat")), ("account_key",), ("rollup_account_key", "_cat")),
        Lookup(lambda: acct.select(F.col("account_key").alias("rollup_account_key"), F.col("account_code").alias("_r_code"),
                                   F.col("description").alias("_r_desc")), ("rollup_account_key",), ("_r_code", "_r_desc")),
    ]
    flow = F.col("_cat").isin(*CASHFLOW_CATEGORIES)

    def rolled(mine, theirs):
        return reads("_cat", theirs, mine)(F.when(flow, F.coalesce(theirs, mine)).otherwise(F.col(theirs)))

    outputs = {
        "account_key": reads("account_key")(F.col("account_key")), "acct_code": reads("account_code")(F.col("account_code")),
        "acct_description": reads("description")(F.col("description")), "acct_type": reads("type")(account_type_name("type")),
        "acct_type_order": reads("type")(account_type_order("type"))}
    for tree, prefix in (("fin", "fin"), ("cost_pool", "cp")):
        for k in range(1, levels + 1):
            outputs |= {f"acct_{tree}_lv{k}_code": _filled("account_code", k, prefix),
                        f"acct_{tree}_lv{k}_name": _filled("description", k, prefix)}
    outputs |= {
        "acct_fin_lv1_type": reads("fin1_type")(account_type_name("fin1_type")),
        "acct_fin_lv2_type": reads("fin1_type", "fin2_type")(account_type_name(F.coalesce("fin2_type", "fin1_type"))),
        "cash_flow_category": reads("_cat")(cashflow_category("_cat")),
        "cfr_account_code": rolled("account_code", "_r_code"), "cfr_account_description": rolled("description", "_r_desc")}
    chosen, needed = pick(outputs, columns)
    return join_lookups(acct, lookups, needed).select(*chosen)


ORG_TREES = {
    "org_cost_pool": "org_cost_pool_tree",
    "org_fin": "org_fin_tree",
    "org_org": "org_tree",
}


def org_dim(lg, levels: int = ORG_LEVELS, columns=None) -> DataFrame:
    """Organization with cost-pool, financial, org and consolidation levels.

    Consolidation levels fall back to the legal entity's consolidation levels
    (own levels first, then the legal entity's).  ``columns`` names the output
    columns wanted (default: all); a tree or lookup that none of them reads is
    not planned.
    """
    cust = lg.customer
    attrs = cust.select("customer_key", "customer_code", "customer_name")
    named = ["customer_code", "customer_name"]

    def org(key, prefix):
        return Lookup(lambda: attrs.select(F.col("customer_key").alias(key), F.col("customer_code").alias(f"{prefix}_code"),
                                           F.col("customer_name").alias(f"{prefix}_name")), (key,), (f"{prefix}_code", f"{prefix}_name"))

    flat = functools.cache(lambda: flatten_with_attributes(lg.org_consolidation_tree, levels, attrs, "customer_key", named, "lv"))

    def consolidation(prefix, on):  # flattened once, joined by the organization's own key and by its legal entity's
        columns = [f"{k}_{c}" for k in range(1, levels + 1) for c in named]
        return Lookup(lambda: flat().select(F.col("node_key").alias(on), *[F.col(f"lv{c}").alias(f"{prefix}{c}") for c in columns]),
                      (on,), tuple(f"{prefix}{c}" for c in columns))

    lookups = [
        Lookup(lambda: lg.customer_type.select("customer_type_key", "customer_type"), ("customer_type_key",), ("customer_type",)),
        org("default_gl_post_org_key", "default_gl_post_org"), org("legal_entity_key", "legal_entity"),
        *[_tree_lookup(functools.partial(lg.table, tree), levels, attrs, "customer_key", named, f"{out}_") for out, tree in ORG_TREES.items()],
        consolidation("own", "customer_key"), consolidation("le", "legal_entity_key"),
    ]
    outputs = {c: reads(c)(F.col(c)) for c in (
        "customer_key", "customer_code", "customer_name", "customer_type", "default_gl_post_org_code", "default_gl_post_org_name",
        "legal_entity_code", "legal_entity_name", *ORG_ATTRIBUTES)}
    for out, prefixes in [(o, (f"{o}_",)) for o in ORG_TREES] + [("org_consolidation", ("own", "le"))]:
        for k in range(1, levels + 1):
            outputs |= {f"{out}_lv{k}_code": _filled("customer_code", k, *prefixes), f"{out}_lv{k}_name": _filled("customer_name", k, *prefixes)}
    chosen, needed = pick(outputs, columns)
    return join_lookups(cust.filter(F.col("customer_key").isNotNull()), lookups, needed).select(*chosen)
