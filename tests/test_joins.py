"""Joins on hot keys and lookups by wanted columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.joins import Lookup, _dealt, join_lookups, skewed_join


def sides(spark, seed=1, n=4000, m=3000):
    """One key on a tenth of both sides, one on many rows of one side only, nulls, and keys without a partner."""
    rng = random.Random(seed)
    key = lambda hot, share, rest: hot if rng.random() < share else rng.choice(rest)
    left = [(key("hot", 0.1, [f"k{i}" for i in range(400)] + ["only-left", None, "wide"] * 3), i) for i in range(n)]
    right = [(key("hot", 0.1, [f"k{i}" for i in range(50, 500)] + [None, ""] + ["lonely"] * 60), i) for i in range(m)]
    left, right = left + left[:40], right + [("wide", -1)]  # equal rows; one row for a key with many
    return (left, right, spark.createDataFrame(left, "a string, x int").repartition(5),
            spark.createDataFrame(right, "b string, y int").repartition(4))


@pytest.mark.parametrize("how", ["inner", "right"])
@pytest.mark.parametrize("heavy", [20, 100_000])
def test_skewed_join_equals_a_plain_one(spark, how, heavy):
    left, right, a, b = sides(spark)
    more = b.unionByName(b.limit(500)).unionByName(spark.createDataFrame([("k3", 0), ("unknown", 0)], "b string, y int"))
    for keys in (None, more.select("b")):
        check(skewed_join(a, b, "a", "b", how, heavy, right_keys=keys), left, right, how)
    few = a.select("a").distinct().unionByName(a.where("a = 'hot'").select("a").limit(90))
    check(skewed_join(a, b, "a", "b", how, heavy, few, more), left, right, how)


def check(got, left, right, how):
    assert got.columns == ["a", "x", "b", "y"]
    by = {}
    for k, x in left:
        by.setdefault(k, []).append(x)
    want = Counter()
    for k, y in right:
        met = by.get(k, []) if k is not None else []
        want.update((k, x, k, y) for x in met)
        if not met and how == "right":
            want[None, None, k, y] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_parts_of_a_hot_key_are_bounded(spark):
    """No part of a key holds many more rows of a side than asked for, and only rows of heavy keys are repeated."""
    left, right, a, b = sides(spark)
    lefts, rights = _dealt(a, b, "a", "b", 50, a, b)
    most = lambda df, *k: df.groupBy(*k).count().agg(F.max("count")).first()[0]
    assert most(a, "a") > 400 and most(lefts.where("_j = 0"), "a", "_i") < 100
    assert most(rights.where("_i2 = 0 and b is not null and b != 'lonely'"), "b", "_j2") < 100
    keys = Counter(k for k, _ in left)
    heavy = {k for k in keys if k in ("hot", "wide")}
    assert Counter(r["a"] for r in lefts.where("_j = 0").collect()) == keys
    again = Counter(r["a"] for r in lefts.where("_j > 0").collect())
    assert set(again) <= heavy and again["hot"] > 0 and again["wide"] == 0


def test_lookups_are_planned_backwards(spark):
    """A lookup is planned if a wanted column, or the key of a later planned one, comes from it."""
    base = spark.createDataFrame([(1, 10), (2, 20)], "id int, p int")
    frames = []

    def frame(name, rows, schema):
        def build():
            frames.append(name)
            return spark.createDataFrame(rows, schema)
        return build

    lookups = [
        Lookup(frame("first", [(10, 100, "x")], "p int, q int, unused string"), ("p",), ("q", "unused")),
        Lookup(frame("second", [(100, "deep")], "q int, deep string"), ("q",), ("deep",)),
        Lookup(frame("other", [(10, "o")], "p int, o string"), ("p",), ("o",)),
        Lookup(frame("many", [(1, "m"), (1, "n")], "id int, m string"), ("id",), ("m",), many=True)]
    got = join_lookups(base, lookups, ["id", "deep"])
    assert frames == ["first", "second", "many"] and "unused" not in got.columns and "m" not in got.columns
    assert sorted((r["id"], r["deep"] or "") for r in got.collect()) == [(1, "deep"), (1, "deep"), (2, "")]
    frames.clear()
    assert join_lookups(base, lookups[:3], ["id"]).columns == ["id", "p"] and not frames
