"""Nested-set hierarchies flattened to level columns.

A nested-set tree stores ``(node_key, tree_level, left_visit, right_visit)``;
the ancestors of a node are the nodes whose interval contains its
``left_visit`` (the node itself included).  That is a range join, which Spark
would run as a nested loop (quadratic in tree size).  Here it is a sweep over
the left visits.  Intervals of one level never overlap, so at any visit number
only the node of that level which began last can still be open, and it is an
ancestor if it ends no earlier:

* nodes are dealt into ``SLICES`` ranges of left visits with about as many
  nodes each (quantiles, so dense and sparse stretches of numbers make no
  difference), and a window over each slice carries the last node of every
  level along;
* what a slice takes over from those before it, one node per level, is a
  running maximum over one summary row per slice (at most ``SLICES + 1`` of
  them, so they are broadcast).

Every node is read, shuffled and sorted once and written once: the work is
linear in the tree (times the levels), whatever the interval widths, and
nothing is exploded or compared in pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of left visits that are swept side by side.
SLICES = 128
#: Accuracy of the quantiles that bound them (Spark's parameter; about this many different values are exact).
QUANTILES = 10_000


def _sweep(tree: DataFrame, n_levels: int, payload: list[str], node: str, level: str, left: str, right: str) -> DataFrame:
    """Each node (``_n``) with its ancestor at every level: structs ``_a0`` .. of (_l, _r, _n, payload), or null."""
    t = tree.select(F.col(node).alias("_n"), F.col(level).alias("_lv"), F.col(left).cast("bigint").alias("_l"),
                    F.col(right).cast("bigint").alias("_r"), *payload)
    cuts = t.agg(F.percentile_approx("_l", [k / SLICES for k in range(1, SLICES)], QUANTILES).alias("c")).scalar()
    t = t.withColumn("_c", cuts).withColumn("_s", F.coalesce(F.size(F.filter("_c", lambda c: c <= F.col("_l"))), F.lit(0))).drop("_c")
    opened = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    own = [F.max(F.when(opened & (F.col("_lv") == k), F.struct("_l", "_r", "_n", *payload))) for k in range(n_levels)]
    last = t.groupBy("_s").agg(*[m.alias(f"_o{k}") for k, m in enumerate(own)])
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.select(F.col("_s"), *[F.max(f"_o{k}").over(before).alias(f"_t{k}") for k in range(n_levels)])
    so_far = Window.partitionBy("_s").orderBy("_l")  # RANGE up to the current visit: the node itself counts
    swept = t.select("*", *[m.over(so_far).alias(f"_w{k}") for k, m in enumerate(own)]).join(F.broadcast(taken), "_s")
    at = lambda k: F.coalesce(F.col(f"_w{k}"), F.col(f"_t{k}"))
    return swept.select("_n", *[F.when(at(k)["_r"] >= F.col("_l"), at(k)).alias(f"_a{k}") for k in range(n_levels)])


def tree_ancestors(tree: DataFrame, n_levels: int, node="node_key", level="tree_level",
                   left="left_visit", right="right_visit") -> DataFrame:
    """Long form: (node_key, anc_level, anc_key) for ancestors at levels < n_levels.

    Nodes without any such ancestor come back once with NULL ancestor
    columns, so every node of the tree is present (the reference's self join
    always matches the node itself).
    """
    wide = _sweep(tree, n_levels, [], node, level, left, right)
    found = F.filter(F.array(*[F.when(F.col(f"_a{k}").isNotNull(), F.struct(
        F.lit(k).alias("anc_level"), F.col(f"_a{k}._n").alias("anc_key"))) for k in range(n_levels)]), lambda x: x.isNotNull())
    return wide.select(F.col("_n").alias(node), F.inline_outer(found))


def flatten_nested_set(tree: DataFrame, n_levels: int, prefix: str = "lvl_key",
                       node="node_key", level="tree_level", left="left_visit", right="right_visit") -> DataFrame:
    """Wide form (D5): one row per node, ``{prefix}_0 .. {prefix}_{n-1}`` ancestor keys.

    Intervals of one level must not overlap and a node stands once in the tree,
    as in any nested set numbered by a walk; gaps between numbers may be of any
    size.  Nodes without visits have no ancestors.
    """
    wide = _sweep(tree, n_levels, [], node, level, left, right)
    return wide.select(F.col("_n").alias(node), *[F.col(f"_a{k}._n").alias(f"{prefix}_{k}") for k in range(n_levels)])


def flatten_with_attributes(tree: DataFrame, n_levels: int, attrs: DataFrame, attr_key: str,
                            attr_cols: list[str], prefix: str, node="node_key") -> DataFrame:
    """Ancestor attributes per level: ``{prefix}{k}_{attr}`` for k = 1..n.

    Attributes are attached to the nodes *before* the sweep (one join per tree
    instead of one per level) and carried along with them.
    """
    named = tree.join(attrs.select(F.col(attr_key).alias(node), *attr_cols), node, "left")
    wide = _sweep(named, n_levels, attr_cols, node, "tree_level", "left_visit", "right_visit")
    return wide.select(F.col("_n").alias(node), *[
        F.col(f"_a{k}.{c}").alias(f"{prefix}{k + 1}_{c}") for k in range(n_levels) for c in attr_cols])
