"""Mixing sources to target weights by entropy balancing.

Every source has a target in tokens.  Among all document rates between 0 and
``cap`` that meet the targets, the ones of largest (bounded) entropy have
exponentially tilted odds, ``r / (cap - r) = exp(lambda_s * size / mean_s)``.
The multipliers maximise a concave dual with one coordinate per source, found
by Newton steps whose sums run on Spark over one row per source and size.
Rates become whole copies by cumulative rounding along the sizes of a source,
and a few repairs bring the taken tokens of each source next to its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
#: Sources, and so the rows that go to the driver at each step; more is an error.
MAX_SOURCES = 100_000
_BUCKET_ROWS = 512


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, cap: float = CAP,
            weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Each source's target: ``share`` of all tokens by weight, at most ``cap`` times its own, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s[0] is None, [ord(c) for c in s[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    own = dict(order)
    rest, free, out = share * sum(own.values()), set(own), {}
    while free:
        total = sum(weight[s] for s, _ in order if s in free)
        over = [s for s, _ in order if s in free and rest * weight[s] / total > cap * own[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(cap * own[s])
            free.discard(s)
        rest = share * sum(own.values()) - sum(out.values())
    return out


def solve(cells: DataFrame, own: dict, goal: dict, mean: dict, cap: float = CAP, steps: int = 60) -> dict:
    """The multiplier of each source; ``cells`` has (source, size, n).  A full source has an infinite one."""
    spark = cells.sparkSession
    lam = {s: 0.0 for s in own}
    low, high = dict.fromkeys(own, -math.inf), dict.fromkeys(own, math.inf)
    todo = {s for s in own if 0 < goal[s] < cap * own[s]}
    for s in own:
        if goal[s] >= cap * own[s]:
            lam[s] = math.inf
        elif goal[s] <= 0:
            lam[s] = -math.inf
    for _ in range(steps):
        if not todo:
            break
        at = F.broadcast(spark.createDataFrame([(s, lam[s], mean[s]) for s in sorted(todo, key=str)], "source string, lam double, mean double"))
        j = cells.join(at, cells["source"].eqNullSafe(at["source"])).select(cells["source"], "size", "n", "lam", "mean")
        u = F.col("size") / F.col("mean")
        r = cap / (1 + F.exp(-F.col("lam") * u))
        # summed as decimals: a sum of doubles would hang on the order in which rows arrive
        total = lambda x: F.sum(x.cast("decimal(38,12)")).cast("double")
        sums = j.groupBy("source").agg(total(F.col("n") * F.col("size") * r).alias("got"),
                                       total(F.col("n") * F.col("size") * u * r * (1 - r / cap)).alias("slope")).collect()
        for x in sums:
            s, off = x["source"], goal[x["source"]] - x["got"]
            if abs(off) <= 1e-9 * max(1.0, goal[s]):
                todo.discard(s)
                continue
            low[s], high[s] = (lam[s], high[s]) if off > 0 else (low[s], lam[s])
            new = lam[s] + off / x["slope"] if x["slope"] > 0 else math.nan
            if not low[s] < new < high[s]:  # outside what earlier steps allow: halve, or double outwards
                new = ((low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s])
                       else 2 * lam[s] + (1 if off > 0 else -1))
            if abs(new - lam[s]) <= 1e-13 * max(1.0, abs(new)):
                todo.discard(s)
            lam[s] = new
    return lam


def copies(rows: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS,
           repairs: int = 4) -> tuple[DataFrame, dict, dict]:
    """(``rows`` with ``copies``, sizes of the sources, targets); ``rows`` has (doc_id, source, size), stored."""
    spark = rows.sparkSession
    cells = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    own = {r["source"]: int(r["tokens"]) for r in per}
    mean = {r["source"]: max(r["tokens"] / r["docs"], 1e-9) for r in per}
    goal = targets(list(own.items()), share, cap, weights)
    lam = solve(cells, own, goal, mean, cap)
    big = 1e300
    at = spark.createDataFrame([(s, max(-big, min(big, lam[s])), mean[s], goal[s]) for s in sorted(own, key=str)],
                               "source string, lam double, mean double, goal double")
    c = (cells.join(F.broadcast(at.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
         .withColumn("rate", cap / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))))
    along = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("n") * F.col("rate")).over(along)
    c = c.withColumn("run", run).withColumn("upto", F.floor(F.col("run") + 0.5))
    c = c.withColumn("take", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0)))
    c = stored(c.select("source", "size", "n", "goal", F.least(F.greatest("take", F.lit(0)), cap * F.col("n")).alias("take")))
    for _ in range(repairs):  # one copy more or less where its size comes nearest to what is off
        off = c.groupBy("source").agg((F.max("goal") - F.sum(F.col("take") * F.col("size"))).alias("off"))
        j = c.join(F.broadcast(off.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        up = F.col("off") > 0
        can = (F.col("size") > 0) & F.when(up, F.col("take") < cap * F.col("n")).otherwise(F.col("take") > 0)
        gain = F.abs("off") - F.abs(F.abs("off") - F.col("size"))
        pick = (j.where(can & (gain > 0)).groupBy("source")
                .agg(F.max(F.struct(gain.alias("gain"), F.col("size"))).alias("m"), F.max("off").alias("off"))
                .select(F.col("source").alias("_s"), F.col("m.size").alias("_size"), F.signum("off").cast("long").alias("_d")))
        c = stored(c.join(F.broadcast(pick), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
                   .select("source", "size", "n", "goal", (F.col("take") + F.coalesce("_d", F.lit(0))).alias("take")))
    # within a cell: whole copies for all, one more for the first by hash, ranked within buckets of bounded size
    k = F.greatest(F.lit(1), F.ceil(F.col("n") / _BUCKET_ROWS)).cast("long")
    cell = c.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "n", "take", k.alias("_k"))
    dealt = stored(rows.join(cell, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")))
                   .select("doc_id", "source", "size", "n", "take",
                           F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("_k")).alias("_b")))
    held = stored(dealt.groupBy("source", "size", "_b").agg(F.count("*").alias("_m")))
    before = F.sum("_m").over(Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("_b").alias("_bb"),
                         F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_b").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = dealt.withColumn("_r", rank).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("_b") == F.col("_bb")))
    whole = F.floor(F.col("take") / F.col("n"))
    extra = (F.col("_r") + F.col("_before") <= F.col("take") - whole * F.col("n")).cast("long")
    return ranked.select("doc_id", "source", "size", (whole + extra).cast("long").alias("copies")), own, goal


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``.

    Size is the number of words (null text: 0).  A null source is a source,
    last in order.  A document without words is taken once or not at all and
    adds nothing.  Rows that repeat a doc_id are dealt with one by one.  The
    same rows always give the same copies; other columns are not read.
    """
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    got, own, goal = copies(rows, share, cap, weights)
    if not own:
        return got.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"),
                          F.lit(0).cast("long").alias("taken"), "copies")
    at = F.broadcast(docs.sparkSession.createDataFrame(
        [(s, own[s], goal[s]) for s in sorted(own, key=str)], "_s string, source_size long, target double"))
    return got.join(at, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are.

    Rows find their copies by (doc_id, source, size) and their place among
    rows that agree in all three; such rows are interchangeable for the mix.
    Null and empty texts have size 0 and are taken as the mix says of them; a
    null source is a source, a null doc_id an id like any other.  Very long
    texts are counted whole.  No rows give no rows; extra columns stay.
    """
    key = fresh(docs, "_mix")
    size, ident, src, length, n, total, nth = (f"{key}_{x}" for x in ("words", "id", "source", "size", "n", "copies", "nth"))
    sized = docs.withColumn(size, word_count(F.col("text")))
    rows = stored(sized.select("doc_id", "source", F.col(size).alias("size")))
    got, _, _ = copies(rows, share, cap, weights)
    per = stored(got.groupBy("doc_id", "source", "size").agg(F.count("*").alias(n), F.sum("copies").alias(total))
                 .select(F.col("doc_id").alias(ident), F.col("source").alias(src), F.col("size").alias(length), n, total))
    on = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(size) == F.col(length))

    def repeated(df: DataFrame, times: Column) -> DataFrame:
        return df.select(*docs.columns, F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)

    once = sized.join(per.where((F.col(n) == 1) & (F.col(total) > 0)), on)
    rank = F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text")))
    often = sized.join(per.where((F.col(n) > 1) & (F.col(total) > 0)), on).withColumn(nth, rank)
    share_of = F.floor(F.col(total) / F.col(n)) + (F.col(nth) <= F.col(total) % F.col(n)).cast("long")
    return repeated(once, F.col(total)).unionByName(repeated(often.where(share_of > 0), share_of))
