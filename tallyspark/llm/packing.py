"""Best-fit packing of token pieces into sequences, by linear grouping.

Lengths are whole numbers from 1 to the capacity, so the packing problem of
any corpus is one count per length: that table, never the pieces, goes to the
driver.  Long pieces are ordered by length and cut into groups of equal
cardinality; each is rounded up to the largest of its group, which leaves a
handful of sizes.  Configurations of those sizes are chosen for the least
waste, actual lengths take the places of their group's size, and the short
pieces then go, longest first, where they leave the least room.  The outcome is a bounded list of
patterns with multiplicities; a piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import cut_pieces, tokenizer

CAPACITY = 2048
GROUPS = 128
#: Pieces longer than this share of the capacity are grouped, shorter ones fill up; the best of these is taken.
LARGE = (1 / 8, 1 / 4, 1 / 3, 1 / 2)
_BUCKETS = 1024


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids followed by ``end_id``.

    Null and empty texts give one piece, the end mark.  Only texts of more
    than ``capacity`` ids are cut; all but their last piece are full.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            flat, text, number, bounds = cut_pieces(*tok.encode_flat(b.column("text")), end_id, capacity)
            raw, cuts = memoryview(flat.astype("<u4").tobytes()), (4 * bounds).tolist()
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(number * capacity),
                 pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Open:
    """Open patterns (tuple of lengths -> how many sequences) by the room they have left, rooms kept sorted."""

    def __init__(self):
        self.by_room: dict[int, Counter] = {}
        self.rooms: list[int] = []
        self.done: Counter = Counter()

    def add(self, pattern: tuple, room: int, many: int) -> None:
        if not many:
            return
        if room == 0:
            self.done[pattern] += many
            return
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = Counter()
        self.by_room[room][pattern] += many

    def tightest(self, length: int):
        k = bisect.bisect_left(self.rooms, length)
        return self.rooms[k] if k < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[tuple, int]:
        c = self.by_room[room]
        pattern, have = next(iter(c.items()))
        got = min(have, most)
        c[pattern] -= got
        if not c[pattern]:
            del c[pattern]
        if not c:
            del self.by_room[room]
            self.rooms.remove(room)
        return pattern, got

    def all(self) -> Counter:
        out = Counter(self.done)
        for c in self.by_room.values():
            out.update(c)
        return out


def _fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Places of each size (largest first) that fill ``room`` best, one place of the largest left over given."""
    best: list = [room + 1, []]

    def deeper(k: int, room: int, used: list[int], steps: list[int]) -> None:
        steps[0] += 1
        if room < best[0]:
            best[:] = [room, used + [0] * (len(sizes) - len(used))]
        if k == len(sizes) or best[0] == 0 or steps[0] > 4000:
            return
        for n in range(min(left[k], room // sizes[k]), -1, -1):
            deeper(k + 1, room - n * sizes[k], used + [n], steps)

    deeper(0, room, [], [0])
    return best[1]


def configurations(sizes: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(places of each size, how many sequences) that give every item a place.

    The largest size left is put first and the rest of the sequence filled as
    full as the sizes left allow; a configuration is used as often as its
    sizes last.
    """
    left, out = list(counts), []
    while any(left):
        k = next(i for i, n in enumerate(left) if n)
        avail = [n - (i == k) for i, n in enumerate(left)]
        use = _fill(sizes, avail, capacity - sizes[k])
        use[k] += 1
        times = min(left[i] // u for i, u in enumerate(use) if u)
        left = [n - times * u for n, u in zip(left, use)]
        out.append((use, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Counter:
    """Patterns (lengths from the sequence's beginning) and how many sequences have them: the fewest over ``large``."""
    return min((_grouped(counts, capacity, groups, x) for x in large), key=lambda p: sum(p.values()))


def _grouped(counts: dict[int, int], capacity: int, groups: int, large: float) -> Counter:
    long_ = sorted(((n, c) for n, c in counts.items() if n > capacity * large), reverse=True)
    total = sum(c for _, c in long_)
    sizes, members = [], []
    each, room_left = -(-total // groups) if total else 0, 0
    for n, c in long_:  # equal-cardinality groups over the ordered lengths, as runs of equal lengths
        while c:
            if not room_left:
                sizes.append(n)
                members.append([])
                room_left = each
            got = min(c, room_left)
            members[-1].append([n, got])
            c, room_left = c - got, room_left - got
    merged_sizes, merged = [], []
    for s, m in zip(sizes, members):  # a length that fills several groups is one size
        if merged_sizes and merged_sizes[-1] == s:
            merged[-1] += m
        else:
            merged_sizes.append(s)
            merged.append(list(m))
    opened = _Open()
    at = [0] * len(merged)
    for use, times in configurations(merged_sizes, [sum(c for _, c in m) for m in merged], capacity):
        slots = [g for g, u in enumerate(use) for _ in range(u)]
        while times:
            # one run of actual lengths per place: as many sequences as the shortest run lasts
            need = Counter(slots)
            run = min([times] + [merged[g][at[g]][1] // u for g, u in need.items() if merged[g][at[g]][1] >= u])
            if all(merged[g][at[g]][1] >= u for g, u in need.items()):
                pattern = tuple(sorted((merged[g][at[g]][0] for g in slots), reverse=True))
                for g, u in need.items():
                    merged[g][at[g]][1] -= u * run
            else:  # a run ends within a sequence: one sequence, place by place
                run, taken = 1, []
                for g in slots:
                    while not merged[g][at[g]][1]:
                        at[g] += 1
                    taken.append(merged[g][at[g]][0])
                    merged[g][at[g]][1] -= 1
                pattern = tuple(sorted(taken, reverse=True))
            for g in need:
                while at[g] < len(merged[g]) - 1 and not merged[g][at[g]][1]:
                    at[g] += 1
            opened.add(pattern, capacity - sum(pattern), run)
            times -= run
    for n, c in sorted(((n, c) for n, c in counts.items() if n <= capacity * large), reverse=True):
        while c:
            room = opened.tightest(n)
            if room is None:
                fit = capacity // n
                if c >= fit:
                    opened.add((n,) * fit, capacity - fit * n, c // fit)
                    c %= fit
                else:
                    opened.add((n,) * c, capacity - c * n, 1)
                    c = 0
                continue
            pattern, got = opened.take(room, c)
            more = min(room // n, c // got)
            opened.add(pattern + (n,) * more, room - more * n, got)
            c -= more * got
    return opened.all()


def _places(patterns: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of places."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for pattern, many in sorted(patterns.items(), reverse=True):
        at = 0
        for n in pattern:
            runs.setdefault(n, []).append((used[n], first, at))
            used[n] += many
            at += n
        first += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32, stored) with sequence_id and offset.

    Rows that repeat an id or are equal are packed one by one; among pieces of
    one length the order by id, piece and checksum decides, and equal rows are
    interchangeable.  A null doc_id is an id like any other.  No rows give an
    empty table.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_BUCKETS))
    tagged = cut.withColumn("_b", bucket)
    sizes = stored(tagged.groupBy("length", "_b").count())  # at most capacity x 1024 rows
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = _places(plan(counts, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (tagged.withColumn("_r", rank).join(starts, ["length", "_b"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_r") - 1 + F.col("_before")).alias("_rank")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, rank = b["length"].to_numpy(np.int64), b.pop("_rank").to_numpy(np.int64)
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(n):
                m = n == x
                from_, first, at = places[int(x)]
                k = np.searchsorted(from_, rank[m], side="right") - 1
                seq[m], off[m] = first[k] + rank[m] - from_[k], at[k]
            yield b.assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The places of all pieces of ``docs`` (doc_id, text).

    Null and empty texts are one piece, the end mark; a very long text is many,
    all but the last of them full; repeated rows are packed as often as they
    come; no rows give an empty table.  Other columns are not read.
    """
    return pack(stored(pieces(docs, tokenizer_path, capacity)), capacity)
