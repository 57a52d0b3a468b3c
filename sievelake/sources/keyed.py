"""A stored table with a key, changed in place of the rows' own buckets.

Rows lie in buckets by a hash of their key, each bucket in Parquet files sorted
by key.  A batch of changes rewrites the buckets that it names and no other;
then a manifest says which folder holds which bucket now.  The manifest also
keeps the last batch of each writer, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables


class KeyedTable:
    """A table at ``root``, made by the first use.  ``buckets`` stays as it was made;
    choose it so that a bucket is some hundreds of megabytes.

    One batch is applied at a time: of two writers that meet, the second fails,
    changes nothing, and may try again.  Nulls in the key are refused as errors.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: str, buckets: int = 64):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.buckets = self.manifest().get("buckets", buckets)

    # ---- manifest ------------------------------------------------------------

    def _files(self):
        jvm = self.spark._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_log")
        return jvm, log.getFileSystem(self.spark._jsc.hadoopConfiguration()), log

    def manifest(self) -> dict:
        """The newest whole manifest; empty for a new table."""
        jvm, fs, log = self._files()
        if not fs.exists(log):
            return {}
        for name in sorted((f.getPath().getName() for f in fs.listStatus(log)), reverse=True):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(log, name))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:  # its writer did not finish
                continue
            finally:
                stream.close()
        return {}

    def _commit(self, manifest: dict) -> None:
        jvm, fs, log = self._files()
        path = jvm.org.apache.hadoop.fs.Path(log, f"{manifest['version']:020d}.json")
        stream = fs.create(path, False)  # fails where another writer was first
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    # ---- reading -------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(paths))

    def rows(self) -> DataFrame:
        """The whole table as of now."""
        return self._read(list(self.manifest().get("paths", {}).values()))

    def get(self, *values) -> DataFrame:
        """Rows of some keys, from their buckets alone; files are sorted by key and
        hold bloom filters, so of a bucket's row groups few are read."""
        asked = self.spark.createDataFrame([(v,) for v in values], StructType([self.schema[self.key]]))
        wanted = {str(r[0]) for r in asked.select(self._bucket()).distinct().collect()}  # at most the values given
        paths = self.manifest().get("paths", {})
        return self._read([paths[b] for b in wanted if b in paths]).filter(F.col(self.key).isin(*values))

    def exists(self, value) -> bool:
        return not self.get(value).isEmpty()

    # ---- writing -------------------------------------------------------------

    def apply(self, items: DataFrame, batch: int, writer: str = "writer", action: str = "action", seq: str = "seq") -> bool:
        """Apply a mixed batch (see ``tables.bulk``); false where this writer's batch
        was applied before.  Errors are in ``errors()``."""
        now = self.manifest()
        if now.get("writers", {}).get(writer, -1) >= batch:
            return False
        usable = items.filter(F.col(self.key).isNotNull())
        touched = [str(r[0]) for r in usable.select(self._bucket()).distinct().collect()]  # at most the buckets
        paths = dict(now.get("paths", {}))
        current = self._read([paths[b] for b in touched if b in paths])
        rows, errors = tables.bulk(current, usable, self.key, action, seq)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        placed = placed.repartitionByRange("bucket", self.key).sortWithinPartitions("bucket", self.key)
        if touched:
            placed.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        refused = items.filter(F.col(self.key).isNull()).select(self.key, action, seq, F.lit("no key").alias("error"))
        errors.unionByName(refused).write.mode("overwrite").parquet(f"{self.root}/errors/writer={writer}/batch={batch}")
        written = self._folders(folder) if touched else {}
        paths = {b: p for b, p in paths.items() if b not in touched} | written
        self._commit({"version": now.get("version", 0) + 1, "buckets": self.buckets, "paths": paths, "writers": now.get("writers", {}) | {writer: batch}})
        return True

    def _folders(self, folder: str) -> dict[str, str]:
        """Buckets written under a folder; those left empty have none."""
        jvm, fs, _ = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}

    def errors(self) -> DataFrame:
        """Refused items of all writers and batches."""
        return self.spark.read.parquet(f"{self.root}/errors")

    def sink(self, writer: str, **columns) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch once, however often it is tried."""
        return lambda df, batch: self.apply(df, batch, writer, **columns) and None

    def forget_old(self) -> int:
        """Delete folders that the manifest no longer names, and older manifests;
        readers of these must be done.  Returns how many folders went."""
        jvm, fs, log = self._files()
        now, path, gone = self.manifest(), jvm.org.apache.hadoop.fs.Path, 0
        live = set(now.get("paths", {}).values())
        data = path(f"{self.root}/data")
        for outer in fs.listStatus(data) if fs.exists(data) else ():
            for inner in fs.listStatus(outer.getPath()):
                name = f"{self.root}/data/{outer.getPath().getName()}/{inner.getPath().getName()}"
                if inner.isDirectory() and name not in live:
                    gone += fs.delete(inner.getPath(), True)
        for old in fs.listStatus(log) if fs.exists(log) else ():
            if old.getPath().getName() < f"{now['version']:020d}.json":
                fs.delete(old.getPath(), False)
        return gone
