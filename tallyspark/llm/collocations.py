"""Phrase collocation mining: Misra-Gries summaries first, exact counts second.

Phrases of one to three words are dealt by hash into partitions.  The first
pass counts them in each task and sends a partition's counters to one place,
where they are merged into one Misra-Gries summary: with more counters than
its mass divided by the threshold, subtracting the largest counter that does
not fit takes less than the threshold from any phrase, so every frequent
phrase keeps one.  Such a summary is handed on as a row of bits.  The second
pass counts, by their words and exactly, the phrases whose bit is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, stored

MIN_COUNT = 10
TOP = 2000
#: A phrase goes if a longer one that holds it has at least this share of its occurrences.
COVERED_PERCENT = 50
LONGEST = 3
#: Phrases (with repeats) of a hash partition, and bytes of text that make one phrase, about.
PARTITION_MASS, BYTES_PER_PHRASE = 4_000_000, 2
#: Bits that all summaries hand on together, and each of them, at most.
FILTER_BITS, PARTITION_BITS = 1 << 28, 1 << 22
#: Bytes of text counted together, and different words a worker knows before it starts anew.
CHUNK_BYTES, KNOWN_WORDS = 8_000_000, 1 << 20
NO_LANG = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in _BREAKS else 32 if c == 9 else c for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Coder(dict):
    """Numbers words as they come; 0 stands for the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def hashed(self) -> np.ndarray:
        """A 64-bit hash of each word, by number."""
        import xxhash

        new = [xxhash.xxh64_intdigest(w) for w in self.words[len(self.hashes):]]
        self.hashes = np.concatenate((self.hashes, np.array(new, np.uint64)))
        return self.hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The words of some texts by number, each piece closed by 0, and their languages."""

    def __init__(self, coder: Coder, parts: list[np.ndarray], langs: list[str]):
        import xxhash

        self.coder, self.ids = coder, np.concatenate(parts)
        self.langs = sorted(set(langs))
        at = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([at[x] for x in langs], np.int32), [len(p) for p in parts])
        self.seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs], np.uint64)

    def phrases(self, partitions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, keys) of all phrases of k words, for each k.

        A key's upper half is the hash partition, its lower half the place in it.
        """
        h, start = self.coder.hashed(), np.flatnonzero(self.ids)
        x = _mix(h[self.ids[start]] ^ self.seeds[self.lang[start]])
        for k in range(1, LONGEST + 1):
            if k > 1:
                more = self.ids[start + k - 1] != 0  # the last word of a text has a 0 behind it
                start = start[more]
                x = _mix(x[more] * _GOLD + h[self.ids[start + k - 1]])
            part = (x >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
            yield k, start, part << np.uint64(32) | x & np.uint64(0xFFFFFFFF)

    def different(self, k: int, start: np.ndarray, block: int = 50_000) -> Iterator[tuple[list[str], list[bytes], list[int]]]:
        """Languages, words joined by blanks and occurrences of the different phrases of k words at some places, in blocks."""
        v = np.int64(len(self.coder.words))
        key = self.lang[start] * v + self.ids[start]
        if k > 1:
            key = key * v + self.ids[start + 1]
        for j in range(2, k):  # numbers stay below 2^63: what is told apart so far is numbered anew
            key = np.unique(key, return_inverse=True)[1] * v + self.ids[start + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        words, start = self.coder.words, start[first]
        for a in range(0, len(start), block):
            s = start[a:a + block]
            columns = [[words[x] for x in self.ids[s + j].tolist()] for j in range(k)]
            yield [self.langs[x] for x in self.lang[s].tolist()], [b" ".join(p) for p in zip(*columns)], n[a:a + block].tolist()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The texts of (lang, text) batches in chunks of about CHUNK_BYTES."""
    coder, parts, langs, size = Coder(), [], [], 0
    for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            tokens = ((text or b"").translate(_FOLD) + b".").replace(b".", b" . ").split()
            parts.append(np.fromiter(map(coder.__getitem__, tokens), np.int32, len(tokens)))
            langs.append(NO_LANG if lang is None else lang)
            size += len(text or b"")
            if size >= CHUNK_BYTES:
                yield Chunk(coder, parts, langs)
                parts, langs, size = [], [], 0
                if len(coder) > KNOWN_WORDS:
                    coder = Coder()
    if parts:
        yield Chunk(coder, parts, langs)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and how often each occurs."""
    keys.sort()
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def merged(places: np.ndarray, counts: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The Misra-Gries summary of counters, several of a place allowed: (places, counts, what was subtracted).

    It has more counters than mass / min_count.  If there are too many places,
    the largest counter that has no room is subtracted from all.
    """
    both = np.sort(places.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
    places, counts = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(places)), bool), places[1:] != places[:-1])))
    places, counts = places[at], np.add.reduceat(counts, at) if len(at) else counts
    room, less = int(counts.sum()) // min_count + 1, 0
    if len(counts) > room:
        less = int(np.partition(counts, len(counts) - room - 1)[len(counts) - room - 1])
        places, counts = places[counts > less], counts[counts > less] - less
    return places, counts, less


def summaries(docs: DataFrame, partitions: int) -> DataFrame:
    """(part, places, counts): the counters of each chunk of texts, by hash partition."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            for _, _, keys in c.phrases(partitions):
                keys, n = counted(keys)
                mine, first = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
                low, n = keys.astype("<u4"), n.astype("<u4")
                ends = np.append(first[1:], len(keys)).tolist()
                cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(first.tolist(), ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(mine), cut(low), cut(n)], ["part", "places", "counts"])

    return docs.select("lang", "text").mapInArrow(count, "part long, places binary, counts binary")


def frequent_bits(summed: DataFrame, bits: int, min_count: int) -> DataFrame:
    """(part, bits): the merged summary of each hash partition, a bit for each phrase that may be frequent."""
    def merge(table: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4")
        places, counts, less = merged(join("places"), join("counts"), min_count)
        flags = np.zeros(bits, np.uint8)
        flags[(places[counts + less >= min_count] * np.uint64(bits) >> np.uint64(32)).astype(np.int64)] = 1
        return pa.table({"part": table.column("part")[:1].combine_chunks(), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    return summed.groupBy("part").applyInArrow(merge, "part long, bits binary")


def _rows(langs: list[str], k: int, phrases: list, counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([k] * len(langs), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()),
         pa.array(counts, pa.int64())], ["lang", "words", "phrase", "f"])


def exact_counts(docs: DataFrame, flags: np.ndarray, bits: int, partitions: int, min_count: int) -> DataFrame:
    """(lang, words, phrase, f) of the frequent phrases, and of all words together (words 0, no phrase)."""
    held = docs.sparkSession.sparkContext.broadcast(flags)  # FILTER_BITS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        for c in chunks(batches):
            for k, start, keys in c.phrases(partitions):
                if k == 1:
                    total = np.bincount(c.lang[start], minlength=len(c.langs)).tolist()
                    yield _rows(c.langs, 0, [None] * len(total), total)
                bit = (keys >> np.uint64(32)) * np.uint64(bits) + ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32))
                hit = (flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                for lang, phrase, n in c.different(k, start[hit == 1]):
                    yield _rows(lang, k, phrase, n)

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("words") == 0))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(lang, words, phrase, f): every phrase of one to three words with f >= ``min_count``; words 0: all words of the language."""
    mass = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_PER_PHRASE
    partitions = max(1, -(-mass // partition_mass))
    bits = max(8, min(PARTITION_BITS, FILTER_BITS // partitions) // 8 * 8)
    flags = np.zeros(partitions * bits // 8, np.uint8)
    for r in frequent_bits(summaries(docs, partitions), bits, min_count).toLocalIterator():
        flags[r["part"] * bits // 8:(r["part"] + 1) * bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return stored(exact_counts(docs, flags, bits, partitions, min_count))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, partition_mass: int = PARTITION_MASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words.

    ``docs`` has lang and text.  Pieces end at ``.,;:!?`` and line breaks,
    words at blanks and tabs; A-Z are lower-cased.  Null and empty texts have
    no words, a null lang is ``und``.  Repeated rows count each time.  Very
    long texts are counted whole.  Equal scores rank by more occurrences, then
    by phrase.  No documents, or none with a frequent phrase, give no rows.
    Other columns are not read.
    """
    ship_code(docs.sparkSession)
    seen = frequent_phrases(docs, min_count, partition_mass)
    part = seen.where("words between 1 and 2").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    found = seen.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    whole = lambda *k: F.concat_ws(" ", *[F.col("w")[i] for i in k])
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1, whole(0), whole(1)))).otherwise(
        F.array(cut(1, whole(0), whole(1, 2)), cut(2, whole(0, 1), whole(2))))
    cuts = found.select("lang", "phrase", "a", F.inline(cuts))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part", side).withColumnRenamed("_f", name)
    big = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.withColumns({"up": big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), "down": big("l") * big("r")})
    scored = scored.withColumn("score", F.expr("up div down"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inside = (found.where("words = 3").select("lang", "a", F.explode(F.array(whole(0, 1), whole(1, 2))).alias("phrase"))
              .groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_part")).agg(F.max("a").alias("_f")))
    left = (lowest.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left")
            .where(F.col("_f").isNull() | (100 * F.col("_f") < COVERED_PERCENT * F.col("a"))).select("lang", "phrase", "a", "m.score", "m.l", "m.r"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # first among 64 shares of a language's phrases, then among what is left
    share = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    left = left.withColumn("rank", share).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = seen.where("words = 0").select("lang", F.col("f").alias("n"))
    return left.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
