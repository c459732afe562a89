"""Left joins on keys that most rows do not have, and lookups planned by the columns a report wants."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 256

#: Rows up to which a lookup table is sent to every executor.
HELD = 1_000_000


def held(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks columns of ``table`` for a broadcast join: a hint if it has at most ``HELD`` rows, else nothing.

    Spark's own choice goes by estimated bytes, and a lookup table just over
    them has every row of a fact moved once for each lookup.  The rows are
    counted (staged tables have that in their Parquet footers), and a larger
    table is shuffled as before.  For narrow tables: keys, codes and names.
    """
    return F.broadcast if table.count() <= HELD else lambda df: df



def left_join_some(df: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``df`` left join ``right`` on ``key``, for keys that are NULL in most rows.

    A shuffle on such a key would send all NULL rows to one task.  A second
    join column deals them out by a hash of ``spread_by`` (a column with many
    values); it is 0 wherever there is a key, and on the right.  The right
    side's 0 is computed from its key, as a constant would be folded away.
    """
    salt = "_salt"
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    return (df.withColumn(salt, dealt)
            .join(right.withColumn(salt, F.pmod(F.hash(key), F.lit(1))), [key, salt], "left").drop(salt))


def left_join_split(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``df`` left join ``right`` on ``key``, for keys that are NULL in most rows: only rows that have one are moved.

    Both halves derive ``df``, so it should be cheap to derive.
    """
    has = F.col(key).isNotNull()
    found = df.filter(has).join(right, key, "left")
    kept = set(df.columns)
    given = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in kept]
    return found.unionByName(df.filter(~has).select("*", *given))


def join_within(df: DataFrame, right: DataFrame, by: str, key: str) -> DataFrame:
    """``df`` join ``right`` on ``by`` and ``key``, moving rows by ``by`` alone, so that sides that lie by it stay in place."""
    r = right.withColumnsRenamed({by: "_by", key: "_key"})
    # as an equality, ``key`` would be one of the columns that both sides are dealt by
    same = (F.col(key) <= F.col("_key")) & (F.col(key) >= F.col("_key"))
    return df.join(r, (F.col(by) == F.col("_by")) & same).drop("_by", "_key")


def left_join_within(df: DataFrame, right: DataFrame, by: str, key: str) -> DataFrame:
    """``df`` left join ``right`` on ``by`` and ``key``, moving rows by ``by`` alone.

    For a second key that few rows have or that has few values for a ``by``:
    the rows of ``right`` are gathered for each ``by``, so a fact that lies by
    ``by`` already stays where it is.  Columns of ``right`` other than the two
    must be new to ``df``.
    """
    given = [c for c in right.columns if c not in (by, key)]
    rows = (right.filter(F.col(by).isNotNull() & F.col(key).isNotNull())
            .groupBy(by).agg(F.collect_list(F.struct(key, *given)).alias("_rows")))
    x = df.join(rows, by, "left")
    mine = F.filter("_rows", lambda r: r[key] == F.col(key))
    return x.select(*df.columns, F.explode_outer(mine).alias("_row")).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in given])


def left_join_rare(df: DataFrame, keys: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` left join ``right`` on ``key``, which few rows have: only these meet ``right``, then their row by ``by``.

    ``keys`` is a narrow frame that holds the (``by``, ``key``) of every row of ``df``.
    """
    some = keys.select(by, key).filter(F.col(by).isNotNull() & F.col(key).isNotNull()).distinct()
    return left_join_within(df, some.join(right, key), by, key)


@dataclass(frozen=True)
class Lookup:
    """A table joined to a base table: its frame, the join columns and the columns it gives.

    ``many``: it may match several rows, or drop some (an inner join), so it
    belongs to the rows of the result whether or not its columns are wanted.
    """

    frame: Callable[[], DataFrame]
    on: tuple[str, ...]
    gives: tuple[str, ...]
    many: bool = False
    how: str = "left"


def join_lookups(df: DataFrame, lookups: list[Lookup], wanted: Iterable[str]) -> DataFrame:
    """``df`` with the lookups that ``wanted`` needs, in their order.

    Catalyst keeps a left join whose columns nobody reads, since it cannot know
    that the other side has one row for a key.  The lookup says so, and is not
    planned unless a wanted column, or the key of a later planned lookup,
    comes from it.  A planned lookup brings only the columns that are needed.
    """
    need, planned = set(wanted), []
    for x in reversed(lookups):
        if x.many or x.how == "inner" or need & set(x.gives):
            planned.append((x, [c for c in x.gives if c in need]))
            need |= set(x.on)
    for x, columns in reversed(planned):
        df = df.join(x.frame().select(*x.on, *columns), list(x.on), x.how)
    return df


def reads(*columns: str):
    """Marks the columns that an output column is made from: ``reads("a", "b")(expression)``."""
    return lambda expression: (expression, columns)


def pick(outputs: dict[str, tuple[Column, tuple[str, ...]]], columns: Iterable[str] | None) -> tuple[list[Column], set[str]]:
    """The wanted output columns (all if ``columns`` is None) and the columns they are made from."""
    names = list(outputs) if columns is None else list(columns)
    if unknown := [c for c in names if c not in outputs]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return [outputs[c][0].alias(c) for c in names], {x for c in names for x in outputs[c][1]}


#: Rows of one key that a task takes in ``skewed_join``.
HEAVY = 100_000


def _dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: int, left_keys: DataFrame,
           right_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of their key (``_i`` of the left rows, ``_j`` of the right) that each row belongs to."""
    count = lambda df, key, name: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    parts = lambda n: F.ceil(F.col(n) / heavy).cast("int")
    # keys with more than ``heavy`` rows on a side: at most rows / heavy of them
    both = (count(left_keys, left_key, "_n").join(count(right_keys, right_key, "_m"), "_key")
            .filter((F.col("_n") > heavy) | (F.col("_m") > heavy)).select("_key", parts("_n").alias("_is"), parts("_m").alias("_js")))
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns), n).cast("int")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lefts = (left.join(both.withColumnRenamed("_key", left_key), left_key, "left")
             .select(*[left[c] for c in left.columns], spread(left, one("_is")).alias("_i"), every(one("_js")).alias("_j")))
    rights = (right.join(both.withColumnRenamed("_key", right_key), right_key, "left")
              .select(*[right[c] for c in right.columns], every(one("_is")).alias("_i2"), spread(right, one("_js")).alias("_j2"),
                      F.col("_is").isNotNull().alias("_met")))
    return lefts, rights


def skewed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", heavy: int = HEAVY,
                left_keys: DataFrame | None = None, right_keys: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` where a few keys may stand on very many rows of both sides (``how``: inner or right).

    The rows of such a key are dealt into parts of about ``heavy`` on each
    side, by a hash of the whole row, and every part of one side meets every
    part of the other, so a task holds one part of each.  Only rows of heavy
    keys are repeated, once for each part of the other side.  A right row of a
    heavy key has partners in some part; its copies in parts without one are no
    result of a right join and are left out.  Equal rows of a key fall into one
    part; column names of the sides must differ.  ``left_keys`` and
    ``right_keys`` count the keys where a side itself is dear to compute: the
    first must have the keys of ``left`` and no others, the second may have
    more than those of ``right``; how often is an estimate.
    """
    lefts, rights = _dealt(left, right, left_key, right_key, heavy, left if left_keys is None else left_keys,
                           right if right_keys is None else right_keys)
    match = (lefts[left_key] == rights[right_key]) & (lefts["_i"] == rights["_i2"]) & (lefts["_j"] == rights["_j2"])
    joined = lefts.join(rights, match, how)
    if how == "right":
        joined = joined.filter(F.col("_i").isNotNull() | ~F.col("_met"))
    return joined.select(*left.columns, *right.columns)
