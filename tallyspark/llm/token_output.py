"""Token-id output in training order: fixed-stride binary shards.

Every text's ids (plus an end mark) are cut into sequences of a fixed number
of ids.  A sequence's number follows from its input partition and its place in
it; partitions are numbered apart by a bound on their sequences, taken from
the bytes of their texts, so no pass over the ids is needed to count them.  A
keyed Feistel network permutes these numbers; where its power-of-two domain is
larger than their range, it is applied again until it lands inside
(cycle-walking).  Equal ranges of the permuted numbers are the shards, and the
order within them is the training order: a sequence's slot is the number of
sequences before it.  In a file each sequence takes the same number of bytes,
so a reader can resume at any slot.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import cut_pieces, tokenizer

IDS = 512
#: Bytes of text for each shard, on average.
SHARD_BYTES = 16_000_000
ROUNDS = 6
KEY = 20_240_229


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of numbers and a round key (the finaliser of splitmix64)."""
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of ``numbers`` (all below ``n``) under the keyed permutation of 0..n-1, or with ``back`` the numbers of slots."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)

    def once(x):
        a, b = x >> half, x & mask
        for r in rounds:
            k = (key + 1) * 0x9E3779B97F4A7C15 * (r + 1)
            a, b = (b ^ (_mix(a, k) & mask), a) if back else (b, a ^ (_mix(b, k) & mask))
        return (a << half) | b

    with np.errstate(over="ignore"):
        x = once(numbers.astype(np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def id_type(tokenizer_path: str, end_id: int = 0) -> str:
    """Two bytes an id if every id of the vocabulary is below the padding value of two bytes, else four."""
    largest = max(tokenizer(tokenizer_path).full.get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if largest < np.iinfo("<u2").max else "<u4"


def sequences(docs: DataFrame, tokenizer_path: str, first: dict[int, int], domain: int, width: int, ids: int = IDS,
              key: int = KEY, end_id: int = 0, kind: str = "<u2") -> DataFrame:
    """(doc_id, piece, n_ids, payload, at, shard): each text's ids and ``end_id`` in pieces, ids of type ``kind``.

    A sequence's number is ``first`` of its input partition plus its place in
    it; a lost partition is read and cut again in the same order, and one that
    ``first`` does not name is an error.  ``at`` is the permuted number,
    ``shard`` its range of ``width`` numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int32()), ("payload", pa.binary()),
                        ("at", pa.int64()), ("shard", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, nth = tokenizer(tokenizer_path), TaskContext.get().partitionId(), None
        for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            if nth is None:
                if part not in first:
                    raise RuntimeError(f"partition {part} was not there when the sequences were numbered")
                nth = first[part]
            flat, text, number, bounds = cut_pieces(*tok.encode_flat(b.column("text")), end_id, ids)
            flat = flat.astype(kind)
            offsets = (bounds * flat.itemsize).astype(np.int32)
            payload = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
            at = feistel(np.arange(nth, nth + len(text)), domain, key)
            nth += len(text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)),
                 payload, pa.array(at), pa.array(at // width)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, n_ids int, payload binary, at long, shard long")


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, ids: int = IDS, shard_bytes: int = SHARD_BYTES,
                 key: int = KEY, end_id: int = 0) -> DataFrame:
    """Write all sequences to ``folder`` and return where each one is.

    ``folder`` is a path or URI that all executors share; ``docs`` is read
    twice and must come in the same partitions and order, as a stored table
    does.  One row per sequence: doc_id, piece, slot, shard, byte_offset,
    n_ids, ids_crc32 (of its ids as they are written).  An id takes two bytes,
    or four if the vocabulary does not fit.  Short sequences are padded with
    the largest number of that size, which is no id.  A file is written under a
    name of its own and renamed when whole, so a task that runs again, or
    twice, leaves the same file.  ``index.json`` holds what a reader needs.
    Null and empty texts are one sequence, the end mark; a very long text is
    many; repeated rows are written as often as they come.  Equal slots do not
    exist: the numbers are a permutation.  No rows give an index with no
    sequences.  Other columns are not read.
    """
    kind = id_type(tokenizer_path, end_id)
    spark, stride = docs.sparkSession, np.dtype(kind).itemsize * ids
    schema = "doc_id long, piece int, shard long, byte_offset long, n_ids int, ids_crc32 long"
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    # an id stands for at least one byte of the folded text, and folding at most triples a text's bytes
    room = (F.lit(1) + F.floor((3 * F.octet_length(F.coalesce("text", F.lit(""))) + 1) / ids)).cast("long")
    parts = (docs.select(F.spark_partition_id().alias("part"), room.alias("room"), F.octet_length("text").alias("bytes"))
             .groupBy("part").agg(F.sum("room").alias("room"), F.sum("bytes").alias("bytes")).collect())  # one row per input partition
    domain, first = 0, {}
    for r in sorted(parts, key=lambda r: r["part"]):
        first[r["part"]] = domain
        domain += r["room"]
    shards = max(1, -(-sum(r["bytes"] or 0 for r in parts) // shard_bytes))
    width = max(1, -(-domain // shards))

    out_schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("shard", pa.int64()), ("byte_offset", pa.int64()),
                            ("n_ids", pa.int32()), ("ids_crc32", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        now, out, name, temp, done = None, None, None, None, 0

        def close():
            if out is not None:
                out.close()
                fs.move(temp, name)

        for b in batches:
            shard = b.column("shard").to_numpy()
            turns = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
            for lo, hi in zip(turns, turns[1:]):
                rows, n = b.slice(lo, hi - lo), hi - lo
                if shard[lo] != now:
                    close()
                    now, done, name = int(shard[lo]), 0, posixpath.join(root, f"shard-{shard[lo]:06d}.bin")
                    temp = f"{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                payloads = rows.column("payload").to_pylist()
                block = np.full((n, ids), np.iinfo(kind).max, kind)
                block[np.arange(ids) < rows.column("n_ids").to_numpy()[:, None]] = np.frombuffer(b"".join(payloads), kind)
                out.write(block.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("piece"), rows.column("shard"), pa.array((done + np.arange(n)) * stride),
                     rows.column("n_ids"), pa.array(list(map(zlib.crc32, payloads)), pa.int64())], schema=out_schema)
                done += n
        close()

    placed = sequences(docs, tokenizer_path, first, domain, width, ids, key, end_id, kind)
    done = placed.repartition(min(shards, 65_536), "shard").sortWithinPartitions("shard", "at").mapInArrow(write, schema)
    where = posixpath.join(folder, "places")
    done.write.mode("overwrite").parquet(where)
    done = spark.read.schema(schema).parquet(where)
    held = {r["shard"]: r["count"] for r in done.groupBy("shard").count().collect()}  # one row per shard
    starts, n = [], 0
    for x in range(shards):
        starts.append(n)
        n += held.get(x, 0)
    with fs.open_output_stream(posixpath.join(root, "index.json")) as f:
        f.write(json.dumps({"sequences": n, "ids": ids, "stride": stride, "starts": starts, "key": key, "id_type": kind}).encode())
    begin = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "shard long, begin long"))
    return done.join(begin, "shard").select(
        "doc_id", "piece", (F.col("begin") + F.floor(F.col("byte_offset") / stride)).cast("long").alias("slot"),
        F.col("shard").cast("int").alias("shard"), "byte_offset", "n_ids", "ids_crc32")


def read_slots(spark: SparkSession, folder: str, start: int, count: int) -> Iterator[np.ndarray]:
    """The sequences of ``count`` slots from ``start`` on, in order, padding removed."""
    fs, root = _filesystem(folder)
    with fs.open_input_stream(posixpath.join(root, "index.json")) as f:
        ix = json.loads(f.read())
    slot, stop = start, min(ix["sequences"], start + count)
    ends = ix["starts"][1:] + [ix["sequences"]]
    while slot < stop:
        shard = bisect.bisect_right(ix["starts"], slot) - 1
        with fs.open_input_file(posixpath.join(root, f"shard-{shard:06d}.bin")) as f:
            f.seek((slot - ix["starts"][shard]) * ix["stride"])
            for _ in range(min(stop, ends[shard]) - slot):
                x = np.frombuffer(f.read(ix["stride"]), ix["id_type"])
                yield x[x != np.iinfo(ix["id_type"]).max]
                slot += 1
