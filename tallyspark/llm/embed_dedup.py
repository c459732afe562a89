"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are halved, each half has a codebook of its own, and the pairs
of centroids form a grid of cells.  Every vector lies in one cell and visits,
by the multi-sequence traversal, its nearest cells until their distance passes
that of its own cell by a margin.  The margin is measured on the fit sample:
so wide that ``RECALL`` of all neighbours at exactly the threshold lie in a
visited cell.  What a visit finds is verified by the cosine in double
precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.98
RECALL = 0.999
#: The codebooks and the margin are fitted on about so many vectors at most.
SAMPLE = 8_192
#: Vectors for each cell and codebook size at most.
PER_CELL, MAX_CODES = 256, 512
#: A task compares blocks of about so many members and visitors of a cell.
BLOCK = 256


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def codebook(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """k-means centroids of ``x``."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _sq(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Two codebooks over the halves of unit vectors of one length, and the margin."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.a = codebook(sample[:, :self.half], k, rng)
        self.b = codebook(sample[:, self.half:], k, rng)
        # neighbours at exactly the threshold, in random directions
        side = rng.normal(size=sample.shape)
        side -= (side * sample).sum(1)[:, None] * sample
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        other = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * side / np.where(norm > 0, norm, 1)
        d1, d2 = _sq(sample[:, :self.half], self.a), _sq(sample[:, self.half:], self.b)
        i, j = _sq(other[:, :self.half], self.a).argmin(1), _sq(other[:, self.half:], self.b).argmin(1)
        rows = np.arange(len(sample))
        over = d1[rows, i] + d2[rows, j] - d1.min(1) - d2.min(1)
        self.margin = float(np.quantile(over, recall)) if len(over) else 0.0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell and all visited cells (own cell first) of unit vectors."""
        d1, d2 = _sq(x[:, :self.half], self.a), _sq(x[:, self.half:], self.b)
        o1, o2 = d1.argsort(1), d2.argsort(1)
        d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        width = len(self.b)
        visits = [[o1[r, i] * width + o2[r, j] for i, j in _traverse(d1[r].tolist(), d2[r].tolist(), self.margin)] for r in range(len(x))]
        return o1[:, 0] * width + o2[:, 0], [[int(c) for c in v] for v in visits]


def _traverse(d1: list[float], d2: list[float], margin: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: pairs of places in two ascending lists by their sum, up to the least sum plus ``margin``."""
    stop, heap, out = d1[0] + d2[0] + margin, [(d1[0] + d2[0], 0, 0)], []
    while heap and heap[0][0] <= stop:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        if j + 1 < len(d2):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(d1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the members of a cell and its visitors: what each vector gains in links, and edges that connect them.

    A pair is met twice if either lies in a cell that the other visits, else
    once; then both ends gain.  ``seen`` says which, for each cell of a visitor.
    """
    here, there = part[part["kind"] == 0], part[part["kind"] == 1]
    if not len(here) or not len(there):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    x, y = _unit(np.stack(there["v"].to_numpy()).astype(np.float64)), _unit(np.stack(here["v"].to_numpy()).astype(np.float64))
    xi, yi = there["id"].to_numpy(np.int64), here["id"].to_numpy(np.int64)
    link = (x @ y.T >= threshold) & (xi[:, None] != yi[None, :])
    if not link.any():
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    own, row = np.unique(there["own"].to_numpy(np.int64), return_inverse=True)
    seen = np.stack([np.isin(own, v) for v in here["visits"]], axis=1)  # own cell of a visitor x member
    single = link & ~seen[row]
    xn = link @ here["m"].to_numpy(np.int64)
    yn = single.T @ there["m"].to_numpy(np.int64)
    # least visitor of each member and least member of each visitor, spread until nothing changes
    low_y = yi.copy()
    low_x = xi.copy()
    top = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(low_x, np.where(link, low_y[None, :], top).min(1))
        ny = np.minimum(low_y, np.where(link, nx[:, None], top).min(0))
        if (nx == low_x).all() and (ny == low_y).all():
            break
        low_x, low_y = nx, ny
    a, b, n = np.concatenate((xi, yi)), np.concatenate((low_x, low_y)), np.concatenate((xn, yn))
    use = (a != b) | (n > 0)
    return pd.DataFrame({"a": a[use], "b": b[use], "n": n[use]})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors are compared if their labels are equal and not null and their
    lengths agree.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do rows without an id.
    Equal vectors of a label meet in one row before any comparison and count
    as links of each other.  Rows that repeat an id are separate vectors of
    the same component.  Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0)
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    whole = stored(rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    n = whole.count()
    share = min(1.0, SAMPLE / max(1, n))
    picked = whole.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).select("v").toPandas()
    by_len: dict[int, list] = {}
    for x in picked["v"]:
        by_len.setdefault(len(x), []).append(np.asarray(x, np.float64))
    k = int(min(MAX_CODES, max(1, round(math.sqrt(n / PER_CELL)))))
    index = {d: MultiIndex(_unit(np.stack(xs)), k, threshold, recall) for d, xs in by_len.items() if d >= 2 and len(xs) >= 2}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = b["v"].map(len).to_numpy(np.int64)
            own, visits = np.zeros(len(b), np.int64), [[0]] * len(b)
            for x in np.unique(d):  # a length that the sample has not met is one cell, visited by all
                at = np.flatnonzero(d == x)
                if int(x) in index:
                    o, vs = index[int(x)].cells(_unit(np.stack(b["v"].iloc[at].to_numpy()).astype(np.float64)))
                    own[at] = o
                    for r, cs in zip(at, vs):
                        visits[r] = cs
            yield b.assign(d=d, own=own, visits=visits)

    placed = stored(whole.mapInPandas(cells, "label string, v array<double>, id long, m long, d long, own long, visits array<long>"))
    visit = placed.select("label", "d", "own", "id", "m", "v", F.explode("visits").alias("cell"))
    held = placed.groupBy("label", "d", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).alias("ks"))
    came = visit.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("kv"))
    size = stored(held.join(came, ["label", "d", "cell"]))  # one row per cell that holds something
    block = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    cols = ["label", "d", "cell", "s", "t", "kind", "id", "m", "own", "v", "visits"]
    none = F.array().cast("array<long>")
    members = (placed.withColumn("cell", F.col("own")).join(size, ["label", "d", "cell"]).withColumn("s", block("ks", 1))
               .withColumn("t", every("kv")).withColumn("kind", F.lit(0)).select(*cols))
    visitors = (visit.join(size, ["label", "d", "cell"]).withColumn("t", block("kv", 2)).withColumn("s", every("ks"))
                .withColumn("kind", F.lit(1)).withColumn("visits", none).select(*cols))
    # dealt anew by all five columns: the joins left the rows together by cell, which would put a hot cell's blocks in one task
    blocks = members.unionByName(visitors).repartition("label", "d", "cell", "s", "t")
    found = stored(blocks.groupBy("label", "d", "cell", "s", "t").applyInPandas(lambda p: _compare(p, threshold), "a long, b long, n long"))
    gained = found.groupBy("a").agg(F.sum("n").alias("n"))
    group = components(found.where("a != b").select("a", "b"))
    per = stored(whole.join(gained, whole["id"] == gained["a"], "left").join(group, whole["id"] == group["node"], "left")
                 .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                         F.coalesce("component", "id").alias("component_id")))
    linked = rows.where("fine").join(per, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
