"""Tables written once and read back (staging).

A ``TableStore`` is a folder that all executors share.  Each table in it has a
manifest: which files it was made from (path, bytes, time of change), the
recipe it was made by, and where its Parquet files lie.  A table whose
inputs and recipe are as the manifest says is read as it is; any other is
written again into a folder of its own, and the manifest is replaced last.  A
job that fails leaves the old table in place, and readers that have opened it
keep their files.

Large inputs are listed by their directory, never read.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import posixpath
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: How staged tables are compressed: they are written once and lie on the shared disk.
CODEC = "zstd"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_state(spark: SparkSession, path: str) -> list:
    """[path, files, bytes, latest change] of a file or folder (hidden files do not count)."""
    fs, p = _hadoop(spark, path)
    todo, files, size, latest = [p], 0, 0, 0
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                files, size, latest = files + 1, size + s.getLen(), max(latest, s.getModificationTime())
    return [fs.makeQualified(p).toString(), files, size, latest]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _cleaning_lock, _cleaning_was = Counter(), threading.Lock(), {}


@contextlib.contextmanager
def shuffles_end_with_writes(spark: SparkSession):
    """Within it, a job's shuffle files go when the job ends: tables written one after another do not add up theirs on disk.

    Else they stay until the driver happens to collect its garbage.  A session
    has its own setting again when the last of several writers is done.
    """
    key = id(spark)
    with _cleaning_lock:
        _cleaning[key] += 1
        if _cleaning[key] == 1:
            _cleaning_was[key] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            _cleaning[key] -= 1
            if _cleaning[key] == 0:
                was = _cleaning_was.pop(key)
                spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


class TableStore:
    """Staged tables under ``folder``; ``written`` names those that this object wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.written: list[str] = []
        self._seen: dict[str, list] = {}

    def _manifest_path(self, name: str) -> str:
        return posixpath.join(self.folder, name, "manifest.json")

    def manifest(self, name: str) -> dict | None:
        fs, p = _hadoop(self.spark, self._manifest_path(name))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _write_manifest(self, name: str, manifest: dict) -> None:
        final = self._manifest_path(name)
        fs, temp = _hadoop(self.spark, f"{final}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(final)
        if not fs.rename(temp, target):  # some file systems do not rename onto a file
            fs.delete(target, False)
            fs.rename(temp, target)

    def states(self, inputs: Iterable[str]) -> list:
        """What a manifest says of the inputs; a file is looked at once in the life of this object."""
        for p in inputs:
            if p not in self._seen:
                self._seen[p] = file_state(self.spark, p)
        return [self._seen[p] for p in sorted(set(inputs))]

    def get(self, name: str, inputs: Iterable[str], recipe: str, build: Callable[[], DataFrame], partition_by=(),
            rebalance: bool = True) -> DataFrame:
        """Table ``name``, written first if there is none of these inputs and this recipe.

        ``build`` is called only then.  Rows are dealt by ``partition_by`` and
        a large partition is split between tasks (rebalanced by size).
        Without ``rebalance`` no row moves for that: each task writes a file
        for every partition it has rows of.
        """
        states = self.states(inputs)  # before reading: a change during the job makes the table stale again
        m = self.manifest(name)
        if m is None or m["recipe"] != digest(recipe) or m["inputs"] != states:
            df = build()
            path = posixpath.join(self.folder, name, uuid.uuid4().hex)
            w = (df.hint("rebalance", *partition_by) if partition_by and rebalance else df).write.option("compression", CODEC)
            with shuffles_end_with_writes(self.spark):
                (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
            m = {"inputs": states, "recipe": digest(recipe), "path": path, "schema": df.schema.json(), "partition_by": list(partition_by)}
            self._write_manifest(name, m)
            self.written.append(name)
        schema = StructType.fromJson(json.loads(m["schema"]))
        return self.spark.read.schema(schema).parquet(m["path"]).select(*schema.names)


    def get_bucketed(self, name: str, inputs: Iterable[str], recipe: str, build: Callable[[], DataFrame], by: list[str], buckets: int) -> DataFrame:
        """Like ``get``, with the rows dealt by a hash of ``by`` into ``buckets`` files and sorted by it.

        Spark knows this layout from the table's entry in the session's catalog,
        which is made anew where a session lacks it: joins, groups and windows
        by these columns need no exchange.
        """
        states, recipe = self.states(inputs), f"{recipe}\n{by} {buckets}"
        m = self.manifest(name)
        if m is None or m["recipe"] != digest(recipe) or m["inputs"] != states:
            df = build()
            path = posixpath.join(self.folder, name, uuid.uuid4().hex)
            entry = f"tallyspark_{posixpath.basename(path)}"
            with shuffles_end_with_writes(self.spark):
                (df.repartition(buckets, *by).write.format("parquet").option("compression", CODEC).bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(entry))
            m = {"inputs": states, "recipe": digest(recipe), "path": path, "schema": df.schema.json()}
            self._write_manifest(name, m)
            self.written.append(name)
        entry = f"tallyspark_{posixpath.basename(m['path'])}"
        if not self.spark.catalog.tableExists(entry):
            schema = StructType.fromJson(json.loads(m["schema"]))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            keys = ", ".join(by)
            self.spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {buckets} BUCKETS LOCATION '{m['path']}'")
        # with a comment the key is a column of the frame's own, which a union of two readers needs to keep the layout
        return self.spark.table(entry).select(*[F.col(c).alias(c, metadata={"comment": "stored by this key"}) if c in by else F.col(c)
                                                for c in self.spark.table(entry).columns])

    def drop_old(self, name: str) -> int:
        """Remove the files of versions that the manifest no longer names; how many versions went.

        For times when no reader has an old version open.
        """
        m = self.manifest(name)
        if m is None:
            return 0
        fs, p = _hadoop(self.spark, posixpath.join(self.folder, name))
        old = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != posixpath.basename(m["path"])]
        for x in old:
            fs.delete(x, True)
        return len(old)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
