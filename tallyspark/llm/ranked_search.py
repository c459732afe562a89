"""Ranked lexical search as dense blocked matrix products.

Each document's impact of a term is an integer below 10^6; each item's weight
of a term is an integer too, so a score is a sum of products of integers.
Items are taken in tiles; the terms of a tile's items are its compact
vocabulary, cut into tiles of columns.  A tile of documents becomes a dense
float64 matrix over such columns and BLAS multiplies it by the matrix of
weights.  Columns are grouped so that no sum can reach 2^53, where float64
stops being exact; the partial products are added up as 64-bit integers.  From
each tile of scores an item takes its k-th best score and all that are equal
or better, so ties at the edge are settled by doc_id and never by chance.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from .common import ship_code, stored

TOP = 10
#: Documents, vocabulary columns and items of a tile.
DOC_TILE, TERM_TILE, ITEM_TILE = 1024, 2048, 256
#: Bytes of item texts searched for in one pass over the documents, on average.
ITEM_BYTES = 1_000_000
#: Impacts are below this number, products of a tile's column sums below 2^53.
IMPACT = 1_000_000
EXACT = 2 ** 53
CHUNK_WORDS = 1_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z in lower case; null: none."""
    return (text or b"").translate(_FOLD).split()


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): a row's number of terms, and how often it holds each term of the vocabulary that it holds."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {t: k for k, t in enumerate(held.value)}
        v = max(1, len(code))
        for b in batches:
            texts, k = b.column("text").cast(pa.binary()).to_pylist(), 0
            while k < len(texts):
                parts, sizes = [], []
                while k < len(texts) and (not sizes or sum(sizes) < CHUNK_WORDS):
                    ws = terms(texts[k])
                    parts.append(np.fromiter(map(code.get, ws, repeat(-1)), np.int64, len(ws)))
                    sizes.append(len(ws))
                    k += 1
                ids, doc = np.concatenate(parts), np.repeat(np.arange(len(sizes)), sizes)
                met = ids >= 0
                key, tf = np.unique(doc[met] * v + ids[met], return_counts=True)
                offsets = np.searchsorted(key, np.arange(len(sizes) + 1) * v).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % v, tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(k - len(sizes), len(sizes)), pa.array(sizes, pa.int64()), *lists],
                                                 ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tiles(counts: list[dict[int, int]], weights: dict[int, int]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first item, one past the last, [(terms, weights by term and item)]) for each tile of items.

    ``counts`` holds each item's occurrences of its terms.  A weight so large
    that it could reach 2^53 alone is spread over several columns.
    """
    most = (EXACT - 1) // IMPACT
    for lo in range(0, len(counts), ITEM_TILE):
        some = counts[lo:lo + ITEM_TILE]
        vocabulary = sorted({t for c in some for t in c})
        at = {t: k for k, t in enumerate(vocabulary)}
        dense = np.zeros((len(vocabulary), len(some)), np.int64)
        for i, c in enumerate(some):
            for t, n in c.items():
                dense[at[t], i] = n * weights[t]
        columns, out, room = [], [], most
        for t, row in zip(vocabulary, dense):
            parts = max(1, -(-int(row.max()) // most))
            for p in range(parts):
                share = (row * (p + 1)) // parts - (row * p) // parts if parts > 1 else row
                if columns and (len(columns) == TERM_TILE or share.max() > room):
                    out.append(columns)
                    columns, room = [], most
                columns.append((t, share))
                room -= int(share.max())
        out += [columns] if columns else []
        yield lo, lo + len(some), [(np.array([t for t, _ in c]), np.array([s for _, s in c], np.float64)) for c in out]


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # a score of 0 is no result
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, lo: int, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores`` by document and item (from ``lo`` on)."""
        n, items = scores.shape
        least = self.least[lo:lo + items]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        d, i = np.nonzero(scores >= least)
        if not len(d):
            return
        self.item, self.score = np.concatenate((self.item, i + lo)), np.concatenate((self.score, scores[d, i]))
        self.doc, self.null = np.concatenate((self.doc, doc[d])), np.concatenate((self.null, null[d]))
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        order = order[rank < self.k]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]
        full, size = np.unique(self.item, return_counts=True)
        last = np.cumsum(size) - 1
        enough = size == self.k
        self.least[full[enough]] = self.score[last[enough]]


def _scored(freqs: DataFrame, counts: list[dict[int, int]], weights: dict[int, int], n_docs: int, n_terms: int, v: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each partition of ``freqs``."""
    held = freqs.sparkSession.sparkContext.broadcast((counts, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = held.value
        matrices, best = list(tiles(counts, weights)), Best(len(counts), k)
        column = np.full(max(1, v), -1)
        for b in (b.slice(s, DOC_TILE) for b in batches for s in range(0, b.num_rows, DOC_TILE)):
            doc, n = b.column("doc_id"), b.column("n").to_numpy()
            null, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            sizes, place = np.unique(n, return_inverse=True)
            m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in sizes], np.int64)[place]
            size = b.column("terms").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), size)
            term, tf = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            for lo, hi, parts in matrices:
                scores = np.zeros((len(n), hi - lo), np.int64)
                for own, w in parts:
                    column[own] = np.arange(len(own))
                    at = column[term]
                    met = at >= 0
                    dense = np.zeros((len(n), len(own)))
                    dense[row[met], at[met]] = impact[met]
                    scores += (dense @ w).astype(np.int64)
                    column[own] = -1
                best.add(lo, scores, doc, null)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item", "doc_id", "score"])

    return freqs.mapInArrow(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents by score above 0, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Null and empty
    texts have no terms: such a document counts nowhere, such an item finds
    nothing.  Every row of ``items`` is an item of its own, also where ids
    repeat or are null; every row of ``docs`` is a document of its own, a null
    doc_id ranks behind others of the same score.  Very long texts are read
    whole.  Empty tables give no rows.  Other columns are not read.

    The items are dealt by hash into blocks of about ``item_bytes``; each block
    takes a pass over the documents.
    """
    spark = docs.sparkSession
    ship_code(spark)
    held = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    held = held.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    named = StructType([StructField("item", LongType()), StructField("item_id", items.schema["item_id"].dataType)])
    out = None
    for block in range(blocks):
        rows = held.where(F.col("_block") == block).orderBy("item_id", "text").select("item_id", "text").collect()
        code: dict[bytes, int] = {}
        counts = [Counter(code.setdefault(t, len(code)) for t in terms(r["text"].encode("utf-8", "surrogatepass"))) for r in rows]
        freqs = stored(frequencies(docs, list(code)))
        n_docs, n_terms = freqs.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = dict(freqs.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # the block's terms at most
        weights = {t: weight(n_docs, df.get(t, 0)) for t in code.values()}
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], named))
        got = _scored(freqs, [dict(c) for c in counts], weights, n_docs, n_terms or 1, len(code), k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # first among 64 shares of the partitions' results, then among what is left
        share = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))
        got = got.withColumn("rank", share).where(F.col("rank") <= k)
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        got = got.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out
