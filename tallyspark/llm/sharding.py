"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group.  Groups that are a noticeable part of a shard are
packed one by one; the others are first gathered, by a hash of their text,
into a fixed number of bundles, so that the packing itself sees a bounded
number of items however large the corpus is.  Items go, largest first, into
the shard with the least room that still holds them; shards are kept by their
room in a balanced tree.  The capacity is the smallest at which all items fit
into the given number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
#: A group of at least a shard's mean over this is packed by itself.
FINE = 64
BUNDLES = 4096
_BUCKETS = 256


@dataclass
class _Node:
    room: int
    shard: int
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _h(t):
    return t.height if t else 0


def _balance(t: _Node) -> _Node:
    t.height = 1 + max(_h(t.left), _h(t.right))
    if _h(t.left) > _h(t.right) + 1:
        if _h(t.left.left) < _h(t.left.right):
            t.left = _turn(t.left, "right", "left")
        return _turn(t, "left", "right")
    if _h(t.right) > _h(t.left) + 1:
        if _h(t.right.right) < _h(t.right.left):
            t.right = _turn(t.right, "left", "right")
        return _turn(t, "right", "left")
    return t


def _turn(t: _Node, up: str, down: str) -> _Node:
    top = getattr(t, up)
    setattr(t, up, getattr(top, down))
    setattr(top, down, t)
    for n in (t, top):
        n.height = 1 + max(_h(n.left), _h(n.right))
    return top


class RoomTree:
    """A balanced (AVL) tree of shards by (room, shard)."""

    def __init__(self):
        self.root = None

    def add(self, room: int, shard: int) -> None:
        def into(t):
            if t is None:
                return _Node(room, shard)
            if (room, shard) < (t.room, t.shard):
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return _balance(t)

        self.root = into(self.root)

    def pop_tightest(self, size: int):
        """Remove and return the (room, shard) of least room that holds ``size``; None if there is none."""
        t, best = self.root, None
        while t:
            if t.room >= size:
                best, t = t, t.left
            else:
                t = t.right
        if best is None:
            return None
        key = best.room, best.shard

        def lowest(t):
            while t.left:
                t = t.left
            return t

        def without(t, key):
            if key < (t.room, t.shard):
                t.left = without(t.left, key)
            elif key > (t.room, t.shard):
                t.right = without(t.right, key)
            else:
                if not t.left or not t.right:
                    return t.left or t.right
                n = lowest(t.right)
                t.room, t.shard = n.room, n.shard
                t.right = without(t.right, (n.room, n.shard))
            return _balance(t)

        self.root = without(self.root, key)
        return key


def best_fit_decreasing(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """The shard of each item (items largest first), or None if they need more shards."""
    tree, used, out = RoomTree(), 0, []
    for s in sizes:
        got = tree.pop_tightest(s)
        if got is None:
            if used == shards or s > capacity:
                return None
            got = (capacity, used)
            used += 1
        tree.add(got[0] - s, got[1])
        out.append(got[1])
    return out


def assign(items: list[tuple[str, int]], shards: int = SHARDS) -> dict[str, int]:
    """Item -> shard.  Items larger than the mean of what is left have a shard to themselves."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    out, rest, first = {}, sum(s for _, s in items), 0
    while items and first < shards - 1 and items[0][1] * (shards - first) > rest:
        out[items[0][0]] = first
        rest -= items[0][1]
        first += 1
        items = items[1:]
    if not items:
        return out
    sizes = [s for _, s in items]
    low, high = max(sizes[0], -(-rest // (shards - first))), max(rest, 1)
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(sizes, mid, shards - first) is None:
            low = mid + 1
        else:
            high = mid
    return out | {k: first + b for (k, _), b in zip(items, best_fit_decreasing(sizes, low, shards - first))}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The law is ``bytes``: shards are near equal in size (UTF-8 bytes of the
    text plus 8), up to a group that is larger than a shard's mean, and equal
    texts share a shard; ``grown_shard`` is null.  Null and empty texts are
    equal texts of no bytes.  ``slot`` numbers a shard's rows from 0.
    Repeated rows have a slot each; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_g")))
    groups = rows.groupBy("_g").agg(F.sum("size").alias("bytes"))
    groups = stored(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cut = max(1, total // (shards * FINE))
    large = [(r["_g"], r["bytes"]) for r in groups.where(F.col("bytes") > cut).collect()]  # at most shards x FINE rows
    bundle = F.concat(F.lit("#"), F.pmod(F.xxhash64("_g"), F.lit(BUNDLES)))
    small = groups.where(F.col("bytes") <= cut).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()
    place = assign(large + [(r["b"], r["bytes"]) for r in small], shards)
    spark = docs.sparkSession
    at = spark.createDataFrame(sorted(place.items()), "_k string, shard int")  # at most shards x FINE + BUNDLES rows
    alone = F.broadcast(at.where(~F.col("_k").startswith("#")).select(F.col("_k").alias("_g"), F.col("shard").alias("_own")))
    placed = (rows.join(alone, "_g", "left").withColumn("_k", bundle)
              .join(F.broadcast(at), "_k", "left").withColumn("shard", F.coalesce("_own", "shard"))
              .withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(_BUCKETS)).cast("int")))
    held = placed.groupBy("shard", "_b").count().collect()  # at most shards x buckets rows
    starts, upto = [], {}
    for r in sorted(held, key=lambda r: (r["shard"], r["_b"])):
        starts.append((r["shard"], r["_b"], upto.get(r["shard"], 0)))
        upto[r["shard"]] = starts[-1][2] + r["count"]
    before = F.broadcast(spark.createDataFrame(starts, "shard int, _b int, _before long"))
    rank = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "_g"))
    return placed.withColumn("_r", rank).join(before, ["shard", "_b"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_r") - 1 + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
