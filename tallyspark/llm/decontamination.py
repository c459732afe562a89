"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of ten consecutive words of each benchmark item
(an item of fewer words is one window).  A word is a symbol; a block is two
words.  For each window length a shift table says how far the search may jump
after a block: past every place where no window can end.  Where a block ends
some window, the hash of its last and first block selects a bucket of test
strings, and these are compared with the text word by word.  Many places are
searched at once: a batch of texts is cut into equal lanes, and each step
advances all lanes by their own shifts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_code, stored

WINDOW = 10
#: Words of a block (one for windows of one word).
BLOCK = 2
#: (window, item) pairs searched for in one pass over the documents; more of them take more passes.
PAIRS = 200_000
#: Places of a lane, and words searched together.
LANE, CHUNK_WORDS = 256, 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters to lower case, every byte that is in no word to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case; null: none."""
    return (text or b"").translate(_FOLD).split()


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item) pairs: the words of a window joined by blanks, and the item's id as text."""
    ws = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, F.lit(size)), " "))
    return (benchmark.select(F.col(id_col).cast("string").alias("item"), ws.alias("_w")).where(F.size("_w") > 0)
            .select(F.explode(cut).alias("window"), "item").distinct())


class Tables:
    """Shift table and buckets for the windows of one length; ``rows`` holds their words as symbols."""

    def __init__(self, rows: np.ndarray):
        n, self.m = rows.shape
        self.b = min(BLOCK, self.m)
        self.bits = max(12, int(n * self.m).bit_length() + 2)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int64)
        for end in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.block(rows[:, end - self.b + 1], rows[:, end]), self.m - 1 - end)
        key = self.key(rows[:, 0], rows[:, self.b - 1], rows[:, -self.b], rows[:, -1])
        self.order = np.argsort(key, kind="stable")
        self.keys, self.rows = key[self.order], rows[self.order]

    def block(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, a, b, y, z) -> np.ndarray:
        """The bucket of a window, from its first block (a, b) and its last (y, z)."""
        return (self.block(y, z) << self.bits) | self.block(a, b)

    def search(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end place, row of ``rows``) of every occurrence in ``sym``; symbol 0 is in no window."""
        m, b, n = self.m, self.b, len(sym)
        first = np.arange(0, n, LANE)
        at, end, found = np.maximum(first, m - 1), np.minimum(first + LANE, n), []
        live = at < end
        at, end = at[live], end[live]
        while len(at):
            s = self.shift[self.block(sym[at - b + 1], sym[at])]
            found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            live = at < end
            at, end = at[live], end[live]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        key = self.key(sym[at - m + 1], sym[at - m + b], sym[at - b + 1], sym[at])
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        size = hi - lo
        at = np.repeat(at, size)
        row = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(len(at))
        same = np.ones(len(at), bool)
        for k in range(m):  # word by word
            same[same] = sym[at[same] - m + 1 + k] == self.rows[row[same], k]
        return at[same], self.order[row[same]]


class Searcher:
    """All tables for a list of (window, item) pairs."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        by_window: dict[tuple[bytes, ...], list[str]] = {}
        for window, item in pairs:
            held = by_window.setdefault(tuple(window.encode("utf-8", "surrogatepass").split()), [])
            if item is not None:
                held.append(item)
        self.code: dict[bytes, int] = {}
        for w in by_window:
            for x in w:
                self.code.setdefault(x, len(self.code) + 1)
        self.tables = []
        for m in sorted({len(w) for w in by_window}):
            some = [w for w in by_window if len(w) == m]
            rows = np.array([[self.code[x] for x in w] for w in some], np.int64)
            self.tables.append((Tables(rows), [by_window[w] for w in some]))

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: number of words, word spans covered by occurrences (first, one past the last), items found."""
        k = 0
        while k < len(texts):
            parts, sizes, total = [], [], 0
            while k < len(texts) and (not parts or total < CHUNK_WORDS):
                ws = words(texts[k])
                parts.append(np.fromiter(map(self.code.get, ws, repeat(0)), np.int64, len(ws)))
                parts.append(np.zeros(1, np.int64))  # keeps texts apart
                sizes.append(len(ws))
                total += len(ws) + 1
                k += 1
            yield from self._find(np.concatenate(parts), np.array(sizes))

    def _find(self, sym: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(sizes + 1) - sizes - 1
        edge = np.zeros(len(sym) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for table, names in self.tables:
            at, row = table.search(sym)
            np.add.at(edge, at - table.m + 1, 1)
            np.add.at(edge, at + 1, -1)
            doc = np.searchsorted(first, at, "right") - 1
            for d, r in set(zip(doc.tolist(), row.tolist())):
                items.setdefault(d, set()).update(names[r])
        turn = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
        begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, z in zip((np.searchsorted(first, begin, "right") - 1).tolist(), begin.tolist(), stop.tolist()):
            base = int(first[d])
            spans.setdefault(d, []).append((a - base, z - base))
        for d, n in enumerate(sizes.tolist()):
            yield n, spans.get(d, []), sorted(items.get(d, ()))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = "doc_id long, digest string, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _scan(docs: DataFrame, pairs: list[tuple[str, str | None]], only_hits: bool) -> DataFrame:
    """One pass over ``docs`` (doc_id, digest, text); ``only_hits`` leaves out rows without an occurrence."""
    held = docs.sparkSession.sparkContext.broadcast(pairs)  # about PAIRS of them at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(held.value)
        for b in batches:
            found = list(searcher.find(b.column("text").cast(pa.binary()).to_pylist()))
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[{"start": a, "end": z} for a, z in f[1]] for f in found], _SPAN),
                 pa.array([f[2] for f in found], pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if only_hits else out

    return docs.mapInArrow(scan, _SCHEMA)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda s, x: F.struct(
        F.greatest(s["upto"], x["end"]).alias("upto"),
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n")), lambda s: s["n"])


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, spans, items), one row per row of ``docs`` (doc_id, text).

    ``spans`` are the places (counted in words) covered by windows of the
    benchmark, ``n_hit`` the words in them, ``items`` the ids of the items
    found, sorted as strings; ``digest`` tells texts apart.  Null and empty
    texts have no words; items without words are in no document; an item
    without an id marks words and is not listed.  Repeated rows have equal
    results, and rows that repeat a doc_id results of their own.  Very long
    texts are searched whole.  An empty benchmark finds nothing; no documents
    give no rows.  Other columns are not read.

    A benchmark of more than ``pairs`` (window, item) pairs is dealt into
    passes by hash.  Later passes give rows for hit texts only, which are
    joined to the first pass by id and digest; spans of different passes may
    overlap.
    """
    spark = docs.sparkSession
    ship_code(spark)
    held = stored(windows(benchmark, size))
    passes = max(1, -(-held.count() // pairs))
    dealt = held.withColumn("pass", F.pmod(F.xxhash64("window", "item"), F.lit(passes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.md5("text") if passes > 1 else F.lit("")).alias("digest"), "text")
    block = lambda k: [tuple(r) for r in dealt.where(F.col("pass") == k).select("window", "item").collect()]
    out = _scan(rows, block(0), False)
    if passes > 1:
        out = stored(out)
        more = spark.createDataFrame([], _SCHEMA)
        for k in range(1, passes):
            more = more.unionByName(stored(_scan(rows, block(k), True)))
        more = more.groupBy(F.col("doc_id").alias("_d"), F.col("digest").alias("_t")).agg(
            F.flatten(F.collect_set("spans")).alias("_s"), F.flatten(F.collect_set("items")).alias("_i"))  # one of each pass
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("digest").eqNullSafe(F.col("_t")), "left").select(
            "doc_id", "digest", "n_words",
            F.array_sort(F.array_distinct(F.concat("spans", none(F.col("_s"), "array<struct<start: bigint, end: bigint>>")))).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", none(F.col("_i"), "array<string>")))).alias("items"))
    return out.select("doc_id", "digest", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")
