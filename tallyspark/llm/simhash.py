"""SimHash near-duplicates through vantage-point trees.

A text's fingerprint takes its word shingles' XXH64 values and sets each of
64 bits that more than half of them set.  Distinct fingerprints at a Hamming
distance of ``max_bits`` or less are linked.  All such pairs are found with a
vantage-point tree: a node's point splits the others by their distance, those
at most ``mu`` away go inside, the rest outside.  By the triangle inequality
an inside point can only have a partner outside if it is more than
``mu - max_bits`` away; those boundary points also go outside, everything else
is pruned.  The upper tree is grown on a bounded sample and its leaves are the
shards; every shard grows its own tree further down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_code, stored
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
#: The upper tree is grown on about so many fingerprints at most.
SAMPLE = 60_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit integer; no word: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle_words + 1].tolist()
        grams = [joined[a:b] for a, b in zip(starts, (ends[shingle_words - 1:] - 1).tolist())]
    h64 = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(grams)
    for k in range(0, n, 8192):  # in blocks: a very long text needs no large array
        h = np.array([h64(g, 42) for g in grams[k:k + 8192]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > n].sum(dtype=np.uint64).astype(np.int64))


def fingerprint_column(text, shingle_words: int = SHINGLE_WORDS):
    @F.pandas_udf("long")
    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, shingle_words) for x in t], dtype="int64")

    return compute(text)


def _split(points: np.ndarray, rng, bits: int):
    """(vantage point, mu) of the best of a few tries; None where no split helps."""
    best = None
    for v in points[rng.integers(0, len(points), 3)]:
        d = np.bitwise_count(points ^ v).astype(np.int64)
        have = np.cumsum(np.bincount(d, minlength=65))
        mu = np.arange(65)
        inside = have
        band = have - np.concatenate((np.zeros(bits, np.int64), have[:-bits]))  # mu - bits < d <= mu
        worst = np.maximum(inside, len(points) - inside + band)
        total = len(points) + band
        m = int(mu[np.argmin(worst + 0.5 * total)])
        cost = int(worst[m])
        if best is None or cost < best[0]:
            best = (cost, v, m)
    return None if best[0] > 0.9 * len(points) else best[1:]


def grow(points: np.ndarray, leaf: int, bits: int = MAX_BITS, seed: int = 1) -> list:
    """A tree as a list of nodes: (vantage point, mu, inside, outside), or None for a leaf."""
    rng = np.random.default_rng(seed)
    nodes: list = [None]
    todo = [(0, points)]
    while todo:
        at, p = todo.pop()
        cut = _split(p, rng, bits) if len(p) > leaf else None
        if cut is None:
            continue
        v, mu = cut
        d = np.bitwise_count(p ^ v)
        nodes[at] = (v, mu, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[at][2], p[d <= mu]), (nodes[at][3], p[d.astype(np.int64) > mu - bits])]
    return nodes


def route(nodes: list, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every shard a fingerprint belongs to, boundary shards included."""
    rows, leaves = [], []
    todo = [(0, np.arange(len(fps)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if nodes[at] is None:
            rows.append(idx)
            leaves.append(np.full(len(idx), at))
            continue
        v, mu, inside, outside = nodes[at]
        d = np.bitwise_count(fps[idx] ^ v).astype(np.int64)
        todo += [(inside, idx[d <= mu]), (outside, idx[d > mu - bits])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _forest(ids: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked, at most one less than the points: breadth first, never all pairs."""
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            block = np.array(queue[:64])
            queue = queue[64:]
            near = np.bitwise_count(fps[block][:, None] ^ fps[left][None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                parent = block[near[:, hit].argmax(axis=0)]
                out += list(zip(ids[parent].tolist(), ids[left[hit]].tolist()))
                queue += left[hit].tolist()
                left = left[~hit]
    return out


def links(ids: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS, leaf: int = 192) -> list[tuple[int, int]]:
    """Links within one shard that connect all points at ``bits`` or less (a spanning forest for each leaf)."""
    if len(fps) <= leaf:
        return _links_small(ids, fps, bits)
    nodes = grow(fps, leaf, bits)
    rows, leaves = route(nodes, fps, bits)
    order = np.argsort(leaves, kind="stable")
    rows, leaves = rows[order], leaves[order]
    out = []
    for part in np.split(rows, np.flatnonzero(np.diff(leaves)) + 1):
        out += _links_small(ids[part], fps[part], bits)
    return out


def _links_small(ids, fps, bits):
    if len(fps) <= 512:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        mine = near.sum(axis=1) > 1
        if not mine.any():
            return []
        ids, fps = ids[mine], fps[mine]
    return _forest(ids, fps, bits)


def near_pairs(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the rows of ``points`` (id, fp), one row per distinct fingerprint.

    A shard that the tree cannot split further (very many fingerprints within
    a few bits) is dealt out as pairs of chunks, so no task gets it whole.
    """
    n = points.count()
    schema = "a long, b long"
    if n < 2:
        return points.sparkSession.createDataFrame([], schema)
    share = min(1.0, SAMPLE / n)
    picked = points.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < share * 1_000_003).select("fp")
    sample = np.array([r[0] for r in picked.collect()], dtype=np.int64).view(np.uint64)
    target = int(min(max(n / 512, 256), 65_536))
    nodes = grow(np.sort(sample), max(8, int(target * share)), max_bits) if len(sample) else [None]

    def shards(batches):
        for b in batches:
            rows, leaves = route(nodes, b["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
            yield pd.DataFrame({"leaf": leaves, "id": b["id"].to_numpy()[rows], "fp": b["fp"].to_numpy()[rows]})

    routed = points.select("id", "fp").mapInPandas(shards, "leaf long, id long, fp long")
    size = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}  # one row per leaf of the sampled tree
    chunks = {leaf: -(-m // target) for leaf, m in size.items() if m > 3 * target}

    def dealt(batches):
        for b in shards(batches):
            k = b["leaf"].map(lambda x: chunks.get(x, 1)).to_numpy(np.int64)
            mixed = b["fp"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mine = ((mixed >> np.uint64(32)) % k.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(b)), k)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            out = b.iloc[rep]
            yield out.assign(i=np.minimum(mine[rep], other), j=np.maximum(mine[rep], other))

    def linked(key, part):
        got = links(part["id"].to_numpy(np.int64), part["fp"].to_numpy(np.int64).view(np.uint64), max_bits)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    spread = points.select("id", "fp").mapInPandas(dealt, "leaf long, id long, fp long, i long, j long")
    return spread.groupBy("leaf", "i", "j").applyInPandas(linked, schema)


def fingerprint_groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, group, component_id) for each different fingerprint of ``rows`` (doc_id, fp).

    Fingerprints are linked as they are, whether or not a row has a doc_id;
    ``group`` is the smallest fingerprint reachable, ``component_id`` the
    smallest doc_id among all rows of the group (null: none has one).
    """
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_pairs(points.select(F.col("fp").alias("id"), "fp"), max_bits))
    grouped = stored(points.join(linked, points["fp"] == linked["node"], "left")
                     .select("fp", F.coalesce("component", "fp").alias("group"), "least"))
    return grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links.  Null and
    empty texts have no word and the fingerprint zero, which links like any
    other.  Copies meet in one row per fingerprint before anything is
    compared.  A row without a doc_id links like any other, also as the only
    link between others; its component is null if no row of it has a doc_id.
    Rows that repeat a doc_id with other texts are not linked by it.  Very long
    texts are read whole; an empty table gives no rows.  Other columns are not
    read.
    """
    ship_code(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    return rows.join(fingerprint_groups(rows, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates, all columns as they are.

    The row with the smallest doc_id stays (rows without one come last), among
    those of one doc_id that of the smallest hash of all its columns, and one
    of several equal rows; reruns keep the same.  Rows that repeat a doc_id with
    unlike texts are of different groups and all stay; rows without a doc_id
    are compared like any other.  An empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    key = fresh(docs, "_kept")
    # what tells a row from others: its id, and two hashes of all it holds
    tag = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").cast("long").alias("b"), F.md5("text").alias("c"), F.xxhash64(*docs.columns).alias("d"))
    keyed = docs.withColumn(key, tag)
    rows = stored(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), shingle_words).alias("fp"), F.col(key).alias("tag")))
    first = (rows.groupBy("fp").agg(F.min("tag").alias("tag")).join(fingerprint_groups(rows.select("doc_id", "fp"), max_bits), "fp")
             .groupBy("group").agg(F.min("tag").alias(key + "k")).select(key + "k"))
    kept = stored(first.join(rows.groupBy("tag").count(), F.col(key + "k") == F.col("tag")).select(key + "k", F.col("count").alias(key + "n")))
    found = keyed.join(kept, F.col(key) == F.col(key + "k"))
    again = found.where(F.col(key + "n") > 1).dropDuplicates([key])
    return found.where(F.col(key + "n") == 1).unionByName(again).select(*docs.columns)
