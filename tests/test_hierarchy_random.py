"""Nested-set flatten vs brute force on random trees with uneven interval widths."""

import random

import pytest

from tallyspark.operators import hierarchy
from tallyspark.operators.hierarchy import flatten_nested_set, flatten_with_attributes, tree_ancestors

SCHEMA = "node_key long, tree_level int, left_visit long, right_visit long"


def random_nested_set(seed: int, n: int, gap_max: int):
    rnd = random.Random(seed)
    children = {0: []}
    for k in range(1, n):
        parent = rnd.randrange(k)
        children.setdefault(parent, []).append(k)
        children.setdefault(k, [])
    rows, counter = [], [rnd.randrange(-50, 50)]

    def visit(node, level):
        counter[0] += rnd.randint(1, gap_max)
        left = counter[0]
        for c in children[node]:
            visit(c, level + 1)
        counter[0] += rnd.randint(1, gap_max)
        rows.append((1000 + node, level, left, counter[0]))

    import sys
    sys.setrecursionlimit(10000)
    visit(0, 0)
    # a second root, far away, to widen the key range
    rows.append((999, 0, counter[0] + 10**6, counter[0] + 10**6 + 3))
    return rows


def brute(rows, n_levels):
    out = {}
    for node, _, left, _ in rows:
        levels = [None] * n_levels
        for p, plev, pl, pr in rows:
            if plev < n_levels and pl <= left <= pr:
                levels[plev] = p if levels[plev] is None else max(levels[plev], p)
        out[node] = levels
    return out


def test_flatten_matches_brute_force(spark):
    for seed, n, gap in [(1, 60, 1), (2, 120, 50), (3, 200, 1000)]:
        rows = random_nested_set(seed, n, gap)
        tree = spark.createDataFrame(rows, "node_key long, tree_level int, left_visit long, right_visit long")
        got = {r["node_key"]: [r[f"lvl_key_{k}"] for k in range(6)] for r in flatten_nested_set(tree, 6).collect()}
        assert got == brute(rows, 6)


def dense_and_sparse(seed):
    """Most nodes crowd a few visit numbers; the rest lie far apart."""
    rnd, rows, at = random.Random(seed), [], 0
    for root in range(30):
        left, crowded = at, root == 7
        for k in range(1500 if crowded else 8):
            step = 1 if crowded else rnd.randint(10**6, 10**9)
            at += step
            inner = at
            rows.append((root * 10_000 + 2 * k, 2, at + step, at + 2 * step))
            at += 3 * step
            rows.append((root * 10_000 + 2 * k + 1, 1, inner, at))
        at += 1
        rows.append((10**6 + root, 0, left, at))
        at += rnd.choice([1, 10**8])
    return rows


@pytest.mark.parametrize("slices", [1, 3, 128])
def test_dense_and_sparse_visits(spark, monkeypatch, slices):
    monkeypatch.setattr(hierarchy, "SLICES", slices)
    rows = dense_and_sparse(5)
    tree = spark.createDataFrame(rows, SCHEMA).repartition(4)
    up = {}
    for lv in (0, 1):  # each node lies in one interval of a level at most, found by bisection
        import bisect

        some = sorted((l, r, n) for n, v, l, r in rows if v == lv)
        lefts = [x[0] for x in some]
        for n, _, l, _ in rows:
            i = bisect.bisect_right(lefts, l) - 1
            up[n, lv] = some[i][2] if i >= 0 and some[i][1] >= l else None
    got = {r["node_key"]: (r["lvl_key_0"], r["lvl_key_1"]) for r in flatten_nested_set(tree, 2).collect()}
    assert got == {n: (up[n, 0], up[n, 1]) for n, *_ in rows}


def test_slices_hold_about_as_many_nodes(spark):
    """The work of a task does not hang on how the numbers are spread."""
    from pyspark.sql import functions as F

    tree = spark.createDataFrame(dense_and_sparse(6), SCHEMA)
    cuts = tree.agg(F.percentile_approx("left_visit", [k / 16 for k in range(1, 16)], hierarchy.QUANTILES).alias("c")).scalar()
    cut = tree.withColumn("c", cuts).groupBy(F.size(F.filter("c", lambda c: c <= F.col("left_visit"))))
    sizes = [r["count"] for r in cut.count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 16


def test_long_form_and_attributes(spark):
    rows = random_nested_set(4, 80, 9)
    tree = spark.createDataFrame([*rows, (5000, 1, None, None), (5001, None, rows[0][2], rows[0][2])], SCHEMA)
    want = brute(rows, 4)
    got = {}
    for r in tree_ancestors(tree, 4).collect():
        got.setdefault(r["node_key"], {})[r["anc_level"]] = r["anc_key"]
    assert {n: {k: v for k, v in enumerate(a) if v is not None} or {None: None} for n, a in want.items()} == {
        n: v for n, v in got.items() if n < 5000}
    assert got[5000] == {None: None} and got[5001] == {0: want[rows[0][0]][0], **{k: v for k, v in enumerate(want[rows[0][0]]) if v is not None}}
    names = spark.createDataFrame([(r[0], f"n{r[0]}") for r in rows[::2]], "key long, name string")
    named = {r[0]: f"n{r[0]}" for r in rows[::2]}
    wide = {r["node_key"]: [r[f"p{k}_name"] for k in range(1, 5)] for r in flatten_with_attributes(tree, 4, names, "key", ["name"], "p").collect()}
    assert {n: wide[n] for n in want} == {n: [named.get(a) for a in up] for n, up in want.items()}


def test_empty_tree(spark):
    assert flatten_nested_set(spark.createDataFrame([], SCHEMA), 3).count() == 0
