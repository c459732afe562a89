"""Interval joins against brute force on random and skewed intervals."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.accruals import rate_for_period
from tallyspark.operators.intervals import interval_lookup, overlap_join

START = dt.datetime(2020, 2, 27, 22, 0)


def lengths(rng):
    """From nothing to centuries: most intervals are short, some open-ended ones are very long."""
    return rng.choice([0, rng.randint(0, 3), rng.randint(0, 200), rng.randint(0, 10**5), 3_000_000])


def moments(kind, a, n):
    if kind == "bigint":
        return a - 500, a - 500 + n
    if kind == "date":
        return START.date() + dt.timedelta(a), START.date() + dt.timedelta(a + n % 700_000)
    return START + dt.timedelta(seconds=a * 977.25), START + dt.timedelta(seconds=a * 977.25 + n * 31.5)


def intervals(rng, kind, n, keys):
    out = []
    for i in range(n):
        b, e = moments(kind, rng.randint(0, 1000), lengths(rng))
        if rng.random() < 0.06:
            b, e = rng.choice([(None, e), (b, None), (e, b), (None, None)])
        out.append((i, rng.choice(keys), b, e))
    return out


@pytest.mark.parametrize("kind", ["bigint", "date", "timestamp_ntz", "timestamp"])
def test_overlaps_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    keys = [1] * 5 + [2, 3, None]  # one key holds most rows
    left, right = intervals(rng, kind, 150, keys), intervals(rng, kind, 170, keys)
    frame = lambda rows, s: spark.createDataFrame(rows, f"{s} int, k int, {s}b {kind}, {s}e {kind}").repartition(3)
    got = overlap_join(frame(left, "l"), frame(right, "r"), ["k"], ("lb", "le"), ("rb", "re"))
    assert got.columns == ["l", "k", "lb", "le", "r", "rb", "re"]
    whole = lambda x: None not in x[2:] and x[2] <= x[3]
    want = Counter((a[0], z[0]) for a in left if whole(a) and a[1] is not None for z in right
                   if whole(z) and a[1] == z[1] and a[2] <= z[3] and z[2] <= a[3])
    assert Counter((r["l"], r["r"]) for r in got.collect()) == want and len(want) > 100


def test_overlaps_without_rows(spark):
    a = spark.createDataFrame([(1, 5, 9)], "x int, b long, e long")
    z = spark.createDataFrame([], "y int, c long, d long")
    assert overlap_join(a, z, [], ("b", "e"), ("c", "d")).count() == 0
    assert overlap_join(z, a, [], ("c", "d"), ("b", "e")).count() == 0


def test_candidates_stay_near_the_result(spark):
    """Short intervals beside a few that span everything do not meet each other in pairs."""
    rows = [(i, 10 * i, 10 * i + 5) for i in range(3000)] + [(5000 + i, 0, 10**9) for i in range(3)]
    a = spark.createDataFrame(rows, "x int, b long, e long")
    z = a.withColumnsRenamed({"x": "y", "b": "c", "e": "d"})
    got = overlap_join(a, z, [], ("b", "e"), ("c", "d"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "sequence(cast" not in plan
    assert got.count() == 3000 + 2 * 3 * 3000 + 9


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "bigint"])
def test_lookup_equals_brute_force(spark, kind, how):
    rng = random.Random(3)
    periods = [(i, rng.randint(1, 2), *moments(kind, a, n)) for i, (a, n) in enumerate([(0, 30), (31, 20), (52, 900), (40, 5), (600, 0), (-400, 100)])]
    periods += [(90, 1, None, moments(kind, 0, 5)[0]), (91, 1, moments(kind, 9, 0)[0], moments(kind, 2, 0)[0])]
    points = [(i, rng.randint(1, 2), moments(kind, rng.randint(-600, 1200), 0)[0] if rng.random() < 0.95 else None) for i in range(300)]
    p = spark.createDataFrame(periods, f"p int, k int, begin_date {kind}, end_date {kind}")
    d = spark.createDataFrame(points, f"x int, k int, at {kind}")
    got = interval_lookup(d, "at", p, ["p"], how, on=["k"])
    assert got.columns == ["x", "k", "at", "p"]
    want = Counter()
    for x, k, at in points:
        met = [q[0] for q in periods if q[1] == k and at is not None and q[2] is not None and q[2] <= at <= q[3]]
        want.update((x, m) for m in met or ([None] if how == "left" else []))
    assert Counter((r["x"], r["p"]) for r in got.collect()) == want


def test_lookup_of_times_between_dates(spark):
    p = spark.sql("select 1 as p, date'2024-01-01' as begin_date, date'2024-01-31' as end_date")
    d = spark.sql("select explode(array(timestamp_ntz'2024-01-31 23:59:59', timestamp_ntz'2024-02-01 00:00:00', timestamp_ntz'2023-12-31 23:59:59')) as t")
    assert [r["t"].day for r in interval_lookup(d, "t", p, ["p"]).collect()] == [31]
    none = p.where("false")
    assert interval_lookup(d, "t", none, ["p"]).count() == 0 and interval_lookup(d, "t", none, ["p"], "left").count() == 3


def test_rates_equal_brute_force(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    span = lambda: (lambda a, n: (day(a), day(a + n)))(rng.randint(0, 400), rng.choice([0, 6, 30, 400, 20_000, -3]))
    rates = [(rng.choice([1, 1, 1, 2, 3]), *span(), Decimal(rng.randint(1, 99))) for _ in range(150)]
    rates = [(p, b if rng.random() < 0.9 else None, e if rng.random() < 0.9 else None, r) for p, b, e, r in rates]
    periods = [(rng.choice([1, 1, 2, 4]), *span()) for _ in range(60)] + [(1, None, day(3))]
    got = rate_for_period(spark.createDataFrame(rates, "person_key int, begin_date date, end_date date, cost_rate decimal(18,2)"),
                          spark.createDataFrame(periods, "person_key int, period_begin date, period_end date"))
    best = lambda xs: max((x for x in xs if x is not None), default=None)
    want = set()
    for p, pb, pe in set(periods):
        if pb is None:
            continue
        met = [(r, b, e) for q, b, e, r in rates if p == q and ((b is not None and pb <= b <= pe) or (e is not None and pb <= e <= pe)
                                                                or (b is not None and e is not None and b < pb and e > pe))]
        if met:
            want.add((p, pb, pe, *[best(m[i] for m in met) for i in range(3)]))
    assert {tuple(r) for r in got.collect()} == want
