"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Every round hangs each node's larger neighbours, then each node's smaller
    neighbours, on the smallest one.  The smallest neighbours are stored before
    they meet the links, so that both sides of that join come from plain
    shuffles and a node with very many links can be split between tasks.
    Null ends and self links are left out; no links give an empty table.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    e = stored(e)
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        big = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(big.groupBy("u").agg(F.min("v").alias("m")))
        small = big.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = _state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
