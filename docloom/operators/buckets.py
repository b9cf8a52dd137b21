"""A keyed table of hash buckets: a write makes only the buckets anew that it touches, and readers see whole versions (K3, K5, V2).

    path/data/<write>/_bucket=7/part-*.parquet     what a write made of bucket 7
    path/manifest/v12.json                         version 12: the folder of each bucket (or a list of them), the number of buckets, the schema

A write stages its rows and reads the keys of the touched buckets of the version it found. A bucket that holds none of them only gets the new rows as one
more folder; the others, and those of more than PARTS folders, are read and made anew. So a table that grows by new keys is not written again with each write. What was
made goes to a folder of the write's own, which then publishes a manifest by a
rename that fails if that version exists. Before the rename nothing of it is visible, so a writer that dies leaves files that no version names. A
reader keeps the files of the version that it opened; they stay until `vacuum` deletes those that no kept version names. Two writers that
start from one version cannot both publish: the second one gets ConcurrentWrite and may run again.

Buckets are by the hash of the key, so they have equal sizes; choose their number so that one is a task's worth (total bytes / 128 MB), and `rebucket` later.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Folders of a bucket before it is made anew as one.
PARTS = 64
#: Keys of a write up to which their hashes are sent to the tasks that look for them: 8 bytes each.
_SENT = 2_000_000


class ConcurrentWrite(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Files:
    """The few file operations of a manifest, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))] if self.fs.exists(self.at(path)) else []

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.at(path)).getLength() if self.fs.exists(self.at(path)) else 0

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def text(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """The text as a new file, whole or not at all; False if there is one."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(path).toUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.at(draft)), self.fs.makeQualified(self.at(path)), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


def bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def parts(folders: dict) -> list[tuple[str, str]]:
    """(bucket, folder) of a manifest's folders."""
    return [(b, f) for b, own in sorted(folders.items(), key=lambda x: int(x[0])) for f in ([own] if isinstance(own, str) else own)]


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = Files(spark, self.path)

    # ---- versions -------------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"no index at {self.path}" if not found else f"no version {version} at {self.path}")
        return json.loads(self.files.text(f"{self.path}/manifest/v{found[-1] if version is None else version}.json"))

    def _publish(self, before: dict | None, folders: dict[str, str], schema: StructType, buckets: int, told: dict | None, **cost: int) -> dict:
        """told: what a writer wants known with this version and all later ones; None keeps what was told before."""
        version = before["version"] + 1 if before else 0
        told = (before or {}).get("told", {}) if told is None else told
        out = {"version": version, "buckets": buckets, "key": self.key, "folders": folders, "schema": schema.jsonValue(), "told": told, **cost}
        if not self.files.publish(f"{self.path}/manifest/v{version}.json", json.dumps(out)):
            raise ConcurrentWrite(f"version {version} of {self.path} was published by another writer")
        return out

    # ---- reading --------------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._rows(m, m["folders"])

    def get(self, keys: list) -> DataFrame:
        """The rows of a few keys: only their buckets are read, and their Parquet statistics prune further."""
        m = self.manifest()
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson(m["schema"])[self.key]]))
        own = {str(r[0]) for r in wanted.select(bucket(self.key, m["buckets"])).distinct().collect()}
        return self._rows(m, {b: f for b, f in m["folders"].items() if b in own}).where(F.col(self.key).isin(keys))

    def _rows(self, m: dict, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b, f in parts(folders)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- writing --------------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, n: int) -> tuple[str, set[str], int]:
        """Rows to a folder of their own, a file for each bucket; the folder's name, its buckets, and bytes."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/{name}"
        b = rows.withColumn("_bucket", bucket(self.key, n))
        b.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(folder)
        return name, {x.split("=")[1] for x in self.files.names(folder) if x.startswith("_bucket=")}, self.files.size(folder)

    def replace(self, rows: DataFrame, buckets: int | None = None, told: dict | None = None) -> dict:
        """All rows anew (keys must be unique)."""
        before = self.manifest() if self.exists() else None
        n = buckets or (before["buckets"] if before else self.buckets)
        name, made, size = self._write(rows, n)
        return self._publish(before, {b: name for b in made}, rows.schema, n, told, bytes_written=size, buckets_written=len(made))

    def rebucket(self, n: int) -> dict:
        return self.replace(self.read(), n)

    def merge(self, new: DataFrame | None = None, gone: DataFrame | None = None, told: dict | None = None) -> dict:
        """Rows of new (unique keys) replace those of their key or are added, keys in gone are deleted. Returns the manifest: bytes_written and
        buckets_written say what the write cost, which grows with the new rows and the buckets that held their keys, not with the table."""
        before = self.manifest()
        n, schema = before["buckets"], StructType.fromJson(before["schema"])
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], schema)
        rows = (empty if new is None else new.select(schema.names)).withColumn("_gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(self.key, F.lit(True).alias("_gone")), allowMissingColumns=True)
        rows.withColumn("_bucket", bucket(self.key, n)).write.parquet(stage)
        staged = self.spark.read.parquet(stage)
        touched = {str(r[0]) for r in staged.select("_bucket").distinct().collect()}  # at most n numbers
        held = {b: f for b, f in before["folders"].items() if b in touched}
        anew = {b for b, f in held.items() if not isinstance(f, str) and len(f) >= PARTS} | self._holding(self._rows(before, held), staged, n)
        old = self._rows(before, {b: f for b, f in held.items() if b in anew})
        kept = old.join(staged.select(self.key), self.key, "left_anti")  # by its file sizes Spark sends a small stage out, so old rows do not move for this
        name, made, size = self._write(kept.select(schema.names).unionByName(staged.where("not _gone").select(schema.names)), n)
        folders = {b: f for b, f in before["folders"].items() if b not in anew} | {b: name for b in made}
        folders |= {b: [*(f for _, f in parts({b: held[b]})), name] for b in made if b in held and b not in anew}
        out = self._publish(before, folders, schema, n, told, bytes_written=size, buckets_written=len(touched))
        self.files.delete(stage)
        return out

    def _holding(self, old: DataFrame, staged: DataFrame, n: int) -> set[str]:
        """Buckets of old that may hold a key of staged: keys are compared by their hash, so one by chance only makes a bucket anew."""
        keys = staged.select(F.xxhash64(self.key).alias("_h")).distinct()
        keys = F.broadcast(keys) if staged.count() <= _SENT else keys
        found = old.select(F.xxhash64(self.key).alias("_h")).join(keys, "_h", "left_semi")
        return {str(r[0]) for r in found.select(F.pmod("_h", F.lit(n)).cast("int")).distinct().collect()}

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep`, and folders that none of these names (a dead writer's too); returns how many folders went.

        No writer may be at work, and readers of older versions must have ended."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for _, f in parts(self.manifest(v)["folders"])}
        gone = [f for f in self.files.names(f"{self.path}/data") if f not in named]
        for f in gone:
            self.files.delete(f"{self.path}/data/{f}")
        for v in self.versions():
            if v not in kept:
                self.files.delete(f"{self.path}/manifest/v{v}.json")
        self.files.delete(f"{self.path}/stage")
        return len(gone)
