"""Interval joins (J11, P20, D41): points in periods, and intervals that overlap.

Both are equi joins on cells of a time line, with the exact condition beside
them; no interval is written out by days or any other unit.

* ``interval_lookup``: cells are as wide as the longest period (rounded up to
  a power of two), so a period lies in at most two of them and a point in one.
* ``overlap_join``: intervals may differ in length by any factor.  Each has a
  level, the power of two just above its length, and two intervals meet in
  the cells of the longer one's level: there both lie in at most two cells, so
  what shares a cell is close to overlapping.  An interval is written once for
  its own level and once for each higher level that the other side has
  (at most 63, usually two or three).  A pair counts in the one cell that
  holds the later of its two beginnings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def position(c: Column, kind: str) -> Column:
    """A place on the time line as a whole number: microseconds for dates and times, the number itself for integers."""
    if kind == "date":
        return F.unix_date(c).cast("long") * _DAY
    if kind.startswith("timestamp"):  # by its fields, so that a change of clocks leaves the order as it is shown
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        return F.unix_date(c.cast("date")).cast("long") * _DAY + seconds.cast("long") * 1_000_000 + (
            F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return c.cast("long")


def _kind(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _level(length: Column) -> Column:
    """The least n with 2^n > length, for a length of 0 or more."""
    return F.length(F.regexp_replace(F.bin(length), "^0+", "")).cast("int")


def _cell(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place, level)  # rounds down, also below zero


def interval_lookup(df: DataFrame, point: str, periods: DataFrame, columns: Sequence[str], how: str = "inner",
                    begin: str = "begin_date", end: str = "end_date", on: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``columns`` of the period that holds ``point`` (J11), bounds included.

    ``on`` names columns that must be equal as well.  A point in several
    periods gives a row for each; a point in none, or a null one, is left out
    or, with ``how="left"``, kept with nulls.  Periods without a bound or that
    end before they begin hold nothing.  Between dates a time counts as its day.
    """
    kind = _kind(periods, begin)
    mine = F.col(point).cast("date") if kind == "date" else F.col(point)
    p = periods.select(*[F.col(c).alias(f"_on_{c}") for c in on], *columns, position(F.col(begin), kind).alias("_from"),
                       position(F.col(end), _kind(periods, end)).alias("_to"))
    p = p.filter(F.col("_from") <= F.col("_to"))
    width = F.coalesce(p.agg(F.max(_level(F.col("_to") - F.col("_from")))).scalar(), F.lit(0))
    p = p.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_from"), width), _cell(F.col("_to"), width))))
    d = df.withColumn("_at", position(mine, kind if kind == "date" else _kind(df, point)))
    d = d.withColumn("_own", _cell(F.col("_at"), width))
    match = (d["_own"] == p["_cell"]) & d["_at"].between(p["_from"], p["_to"])
    for c in on:
        match &= d[c] == p[f"_on_{c}"]
    return d.join(p, match, how).select(*df.columns, *columns)


def _placed(df: DataFrame, begin: str, end: str, other_levels: Column, side: str) -> DataFrame:
    """Each row of ``df`` in the cells of its own level and of the other side's higher levels."""
    own = _level(F.col(end) - F.col(begin))
    higher = F.filter(f"_ov_{side}all", lambda x: x > F.col(f"_ov_{side}own"))
    at = F.col(f"_ov_{side}level")
    return (df.withColumns({f"_ov_{side}own": own, f"_ov_{side}all": F.coalesce(other_levels, F.array().cast("array<int>"))})
            .withColumn(f"_ov_{side}level", F.explode(F.array_union(F.array(f"_ov_{side}own"), higher))).drop(f"_ov_{side}all")
            .withColumn(f"_ov_{side}cell", F.explode(F.sequence(_cell(F.col(begin), at), _cell(F.col(end), at)))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """All pairs of rows that are equal in ``on`` and whose intervals share a point, bounds included (inner join).

    Bounds are dates, timestamps or integers, of one kind on both sides;
    ``left`` and ``right`` have no other column name in common than ``on``.
    Intervals without a bound or that end before they begin overlap nothing.
    """
    def placed(df, bounds, side):
        b, e = bounds
        df = df.withColumns({f"_ov_{side}b": position(F.col(b), _kind(df, b)), f"_ov_{side}e": position(F.col(e), _kind(df, e))})
        return df.filter(F.col(f"_ov_{side}b") <= F.col(f"_ov_{side}e"))

    a, z = placed(left, left_bounds, "l"), placed(right, right_bounds, "r")
    levels = lambda df, side: df.agg(F.array_sort(F.collect_set(_level(F.col(f"_ov_{side}e") - F.col(f"_ov_{side}b"))))).scalar()
    a, z = _placed(a, "_ov_lb", "_ov_le", levels(z, "r"), "l"), _placed(z, "_ov_rb", "_ov_re", levels(a, "l"), "r")
    z = z.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = (a["_ov_llevel"] == z["_ov_rlevel"]) & (a["_ov_lcell"] == z["_ov_rcell"]) & (a["_ov_lb"] <= z["_ov_re"]) & (z["_ov_rb"] <= a["_ov_le"])
    match &= a["_ov_llevel"] == F.greatest(a["_ov_lown"], z["_ov_rown"])
    match &= a["_ov_lcell"] == _cell(F.greatest(a["_ov_lb"], z["_ov_rb"]), a["_ov_llevel"])
    for c in on:
        match &= a[c] == z[f"_on_{c}"]
    helpers = [f"_ov_{s}{c}" for s in "lr" for c in ("b", "e", "own", "level", "cell")]
    return a.join(z, match).drop(*helpers, *[f"_on_{c}" for c in on])
