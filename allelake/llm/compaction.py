"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrame operations alone.

A store is a folder: ``data`` holds Parquet shards that never change, ``manifest`` one JSON file for each version, which
lists the shards that are part of it. A version becomes visible by one rename that fails if the version exists already, so
readers see either the old set of shards or the new one, and of two writers one has to start again. The rename is one step
on HDFS; on a local disk or an object store it is a check and a rename, so writers there need a lock of their own. Files of
a job that died belong to no version.

Appending adds many small shards. Compaction sorts shards into tiers by size (each ``fanout`` times the one below) and
merges a tier that has ``fanout`` shards or more into files of the target size; sources and rows are never regrouped, so a
merge moves no row through a shuffle and no hot key matters. Shards of the target size are left alone.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET_BYTES, FANOUT, SMALLEST = 128 << 20, 4, 1 << 20


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards under ``root``, any folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def _files(self, name: str, ending: str) -> list[tuple[str, int]]:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return []
        return sorted((f"{name}/{s.getPath().getName()}", s.getLen()) for s in fs.listStatus(path) if s.getPath().getName().endswith(ending))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max([0, *(int(name.rpartition("/v")[2].removesuffix(".json")) for name, _ in self._files("manifest", ".json"))])

    def manifest(self, version: int | None = None) -> dict:
        """``shards`` (name to bytes) and ``schema`` of a version, by default the newest."""
        version = self.version() if version is None else version
        if not version:
            return {"shards": {}, "schema": None}
        stream = self._fs().open(self._path(f"manifest/v{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, add: dict[str, int], remove: list[str], schema: str) -> int:
        """Make version ``base`` + 1 from ``base``; raises CommitConflict if it exists."""
        shards = self.manifest(base)["shards"]
        gone = [x for x in remove if x not in shards]
        if gone:
            raise CommitConflict(f"no longer part of version {base}: {gone[:3]}")
        shards = {k: v for k, v in shards.items() if k not in set(remove)} | add
        body = json.dumps({"version": base + 1, "schema": schema, "shards": shards}).encode()
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(body))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"manifest/v{base + 1:012d}.json"), options)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _write(self, df: DataFrame, rows: int = 0) -> dict[str, int]:
        name = f"data/{uuid.uuid4().hex}"
        (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(f"{self.root}/{name}")
        return {k: v for k, v in self._files(name, ".parquet")}

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> int:
        """Add the rows of ``df`` as shards (of at most ``rows_per_shard`` rows each, if given); gives the version."""
        added = self._write(df, rows_per_shard)
        while True:
            base = self.version()
            known = self.manifest(base)["schema"]
            if known and [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(known))] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError("the rows have other columns than the store")
            try:
                return self.commit(base, added, [], df.schema.json())
            except CommitConflict:
                continue

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST) -> int:
        """Merge tiers until none has ``fanout`` shards below the target size; gives the version."""
        if fanout < 2 or target < 1:
            raise ValueError("fanout must be 2 at least, and the target positive")
        while True:
            base = self.version()
            now = self.manifest(base)
            tiers: dict[int, list[str]] = {}
            for name, size in now["shards"].items():
                if size < target / 2:
                    tiers.setdefault(max(0, math.floor(math.log(max(size, 1) / smallest, fanout))), []).append(name)
            ready = [t for t in sorted(tiers) if len(tiers[t]) >= fanout]
            if not ready:
                return base
            names = tiers[ready[0]]
            total = sum(now["shards"][x] for x in names)
            merged = self._read(names, now["schema"]).coalesce(max(1, math.ceil(total / target)))
            made = self._write(merged)
            try:
                self.commit(base, made, names, now["schema"])
            except CommitConflict:  # the files of the lost race belong to no version
                for x in made:
                    self._fs().delete(self._path(x), False)

    def _read(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{x}" for x in names))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was appended yet")
        if not now["shards"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(now["schema"])))
        return self._read(sorted(now["shards"]), now["schema"])

    def vacuum(self, keep: int = 2) -> int:
        """Delete shards that the newest ``keep`` versions don't list (readers of older ones must be done); gives their number."""
        last = self.version()
        live = {x for v in range(max(1, last - keep + 1), last + 1) for x in self.manifest(v)["shards"]}
        old = {x for v in range(1, max(1, last - keep + 1)) for x in self.manifest(v)["shards"]} - live
        for v in range(1, max(1, last - keep + 1)):
            self._fs().delete(self._path(f"manifest/v{v:012d}.json"), False)
        return sum(bool(self._fs().delete(self._path(x), False)) for x in sorted(old))


def compacted(df: DataFrame, root: str, rows_per_shard: int = 2_000, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Append ``df`` to a store at ``root`` as small shards, compact it, and give the newest version's rows.

    All columns and rows are kept as they are, nulls, repeated rows and empty or very long texts included; an empty table
    makes a version without rows.
    """
    store = ShardStore(df.sparkSession, root)
    store.append(df, rows_per_shard)
    store.compact(target, fanout)
    return store.read()
