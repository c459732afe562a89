"""Registered hierarchy and dimension queries (D3, D5-D9, D12c) with their DuckDB SQL.

The SQL lists every node's ancestors as rows (node, level, key).  A flattened
tree reads the key of a level from a map of these rows; a level column of a
dimension is the attribute of the deepest ancestor above that level that has
one, which is the ragged fill by definition.
"""

from __future__ import annotations

from ..operators import dims as D
from ..operators import hierarchy as H
from .registry import register
from .sqltext import acct_type_order_sql, acct_type_sql, decode_sql, with_fixtures


def ancestors_sql(tree: str) -> str:
    """(node, level, key) for each node and each node whose visits enclose it, itself included."""
    return f"""(
  SELECT low.node_key AS node, up.tree_level AS level, up.node_key AS key
  FROM {tree} up JOIN {tree} low ON up.left_visit <= low.left_visit AND low.left_visit <= up.right_visit)"""


register(
    "d05_flatten_nested_set",
    lambda lg: H.flatten_nested_set(lg.org_tree, 6, prefix="org_key"),
    with_fixtures(["org_tree"], f"""
SELECT node AS node_key, {', '.join(f'path[{k}] AS org_key_{k}' for k in range(6))}
FROM (SELECT node, map_from_entries(list((level, key))) AS path FROM {ancestors_sql('org_tree')} GROUP BY node)"""),
)


def levels_sql(tree: str, table: str, key: str, attributes: dict[str, str], n: int, prefix: str) -> str:
    """One row per node: for each level and attribute, the value of the deepest ancestor so far that has one."""
    filled = ", ".join(f"arg_max(t.{column}, a.level) FILTER (a.level < {k}) AS {prefix}_lv{k}_{suffix}"
                       for k in range(1, n + 1) for suffix, column in attributes.items())
    return f"""(
  SELECT a.node, {filled}
  FROM {ancestors_sql(tree)} a JOIN {table} t ON t.{key} = a.key
  WHERE a.level < {n} GROUP BY a.node)"""


def level_names(prefix: str, suffixes, n: int) -> list[str]:
    return [f"{prefix}_lv{k}_{s}" for k in range(1, n + 1) for s in suffixes]


def account_dim_sql(n: int = D.ACCT_LEVELS) -> str:
    text = {"code": "account_code", "name": "description"}
    fin = levels_sql("acct_fin_tree", "account", "account_key", text | {"type": "type"}, n, "acct_fin")
    pool = levels_sql("acct_cost_pool_tree", "account", "account_key", text, n, "acct_cost_pool")
    shown = level_names("acct_fin", text, n) + level_names("acct_cost_pool", text, n)
    flow = decode_sql("flow.category", D.CASHFLOW_CATEGORIES, " ")
    own = f"flow.category IN ({', '.join(repr(c) for c in D.CASHFLOW_CATEGORIES)})"
    return f"""
SELECT a.account_key, a.account_code AS acct_code, a.description AS acct_description,
       {acct_type_sql('a.type')} AS acct_type, {acct_type_order_sql('a.type')} AS acct_type_order,
       {', '.join(shown)},
       {acct_type_sql('fin.acct_fin_lv1_type')} AS acct_fin_lv1_type, {acct_type_sql('fin.acct_fin_lv2_type')} AS acct_fin_lv2_type,
       {flow} AS cash_flow_category,
       coalesce(target.account_code, CASE WHEN {own} THEN a.account_code END) AS cfr_account_code,
       coalesce(target.description, CASE WHEN {own} THEN a.description END) AS cfr_account_description
FROM account a
LEFT JOIN {fin} fin ON fin.node = a.account_key
LEFT JOIN {pool} pool ON pool.node = a.account_key
LEFT JOIN (cashflow_account flow LEFT JOIN account target ON target.account_key = flow.rollup_account_key)
  ON flow.cashflow_account_key = a.account_key"""


ACCOUNT_DIM_FIXTURES = ["account", "acct_fin_tree", "acct_cost_pool_tree", "cashflow_account"]

register(
    "d08_account_dim",
    lambda lg: D.account_dim(lg),
    with_fixtures(ACCOUNT_DIM_FIXTURES, account_dim_sql()),
)


def org_dim_sql(n: int = D.ORG_LEVELS) -> str:
    text = {"code": "customer_code", "name": "customer_name"}
    trees = "\n".join(f"LEFT JOIN {levels_sql(tree, 'customer', 'customer_key', text, n, out)} t_{out} ON t_{out}.node = c.customer_key"
                      for out, tree in D.ORG_TREES.items())
    shown = [x for out in D.ORG_TREES for x in level_names(out, text, n)]
    # an organization outside the consolidation tree takes its legal entity's place in it
    both = [f"coalesce(mine.{x}, entity.{x}) AS {x}" for x in level_names("org_consolidation", text, n)]
    consolidation = levels_sql("org_consolidation_tree", "customer", "customer_key", text, n, "org_consolidation")
    return f"""
SELECT c.customer_key, c.customer_code, c.customer_name, kind.customer_type,
       post.customer_code AS default_gl_post_org_code, post.customer_name AS default_gl_post_org_name,
       le.customer_code AS legal_entity_code, le.customer_name AS legal_entity_name,
       {', '.join(f'c.{x}' for x in D.ORG_ATTRIBUTES)},
       {', '.join(shown + both)}
FROM customer c
{trees}
LEFT JOIN {consolidation} mine ON mine.node = c.customer_key
LEFT JOIN customer le ON le.customer_key = c.legal_entity_key
LEFT JOIN {consolidation} entity ON entity.node = le.customer_key
LEFT JOIN customer post ON post.customer_key = c.default_gl_post_org_key
LEFT JOIN customer_type kind ON kind.customer_type_key = c.customer_type_key
WHERE c.customer_key IS NOT NULL"""


ORG_DIM_FIXTURES = ["customer", "customer_type", "org_tree", "org_fin_tree", "org_cost_pool_tree",
                    "org_consolidation_tree"]

register(
    "d09_org_dim",
    lambda lg: D.org_dim(lg),
    with_fixtures(ORG_DIM_FIXTURES, org_dim_sql()),
)
