"""Versioned tables: snapshots, changes appended to them, and a log of numbered versions that names what each consists of.

A table's folder holds ``data/<id>`` folders, which are written once and never changed, and ``log/<number>.json``. A version
exists once its log entry does, and an entry is renamed into place whole, so that a write that is cut off leaves no trace but
a folder that no version names. Readers keep to the version they began with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("instance", "relpath")


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class Snapshots:
    """A table of one row per ``key`` under ``root``, a path of any Hadoop file system.

    A snapshot is partitioned by ``by``; changes replace the rows of their keys, the last by ``order`` where a key changes
    more than once in one append. After ``compact_after`` appends the next one is followed by a compaction.
    """

    def __init__(self, spark: SparkSession, root: str, key: tuple[str, ...] = KEY, by: str | None = "state", order: tuple[str, ...] = (), compact_after: int | None = None) -> None:
        self.spark, self.root, self.key, self.by, self.order, self.compact_after = spark, root.rstrip("/"), key, by, order, compact_after
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str) -> list:
        folder = self._path(f"{self.root}/{name}")
        return list(self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, rising."""
        names = [f.getPath().getName() for f in self._files("log")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def entry(self, version: int | None = None) -> dict | None:
        """The log entry of a version, the latest where none is given; None for a table without versions."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"{self.root} has no version {version}; kept are {known}")
        stream = self._fs.open(self._path(f"{self.root}/log/{version or known[-1]:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> int:
        """Renames the entry into place: it is there whole or not at all, and never over another one."""
        draft = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        final = self._path(f"{self.root}/log/{entry['version']:020d}.json")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise VersionConflict(f"{self.root} already has version {entry['version']}") from e
            raise
        return entry["version"]

    def _write(self, rows: DataFrame, by: str | None) -> str:
        name = f"data/{uuid.uuid4().hex}"
        # rows of one value of ``by`` meet in as many files as their size asks for, whatever its share of the rows
        out = rows.hint("rebalance", by).write.partitionBy(by) if by else rows.write
        out.parquet(f"{self.root}/{name}")
        return name

    def _next(self, before: dict | None, kind: str, snapshot: str | None, changes: list[str], schema: T.StructType) -> int:
        number = before["version"] + 1 if before else 1
        return self._commit({"version": number, "kind": kind, "snapshot": snapshot, "changes": changes, "schema": schema.json(), "at_ms": int(time.time() * 1000)})

    def replace(self, rows: DataFrame) -> int:
        """A new version that holds exactly ``rows``, one per key. Returns its number."""
        return self._next(self.entry(), "replace", self._write(rows, self.by), [], rows.schema)

    def append(self, rows: DataFrame, removed: Column | None = None) -> int:
        """A new version in which the rows of these keys are replaced, or gone where ``removed``; others are not touched.

        Costs the changes, not the table. Columns are those of the table, in any order.
        """
        before = self.entry()
        gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
        if before:
            schema = T.StructType.fromJson(json.loads(before["schema"]))
            if sorted(schema.names) != sorted(rows.columns):
                raise ValueError(f"columns are {rows.columns}, the table has {schema.names}")
            rows = rows.withColumn("_removed", gone).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], "_removed")
        else:
            schema, rows = rows.schema, rows.withColumn("_removed", gone)
        changes = [*(before["changes"] if before else []), self._write(rows, None)]
        number = self._next(before, "append", before["snapshot"] if before else None, changes, schema)
        if self.compact_after and len(changes) >= self.compact_after:
            number = self.compact()
        return number

    def read(self, version: int | None = None, only: list[str] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; ``only`` some values of ``by``, of whose folders alone the snapshot
        is then read. The version is fixed by this call: later commits and compactions change nothing of the result."""
        entry = self.entry(version)
        if entry is None:
            raise ValueError(f"{self.root} has no version")
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        whole = self.spark.createDataFrame([], schema)
        if entry["snapshot"]:
            whole = self.spark.read.schema(schema).parquet(f"{self.root}/{entry['snapshot']}").select(*schema.names)
        wanted = F.col(self.by).isin(*only) if only is not None else None
        whole = whole.where(wanted) if wanted is not None else whole
        if not entry["changes"]:
            return whole
        rest = [n for n in schema.names if n not in self.key]
        log = None
        for i, name in enumerate(entry["changes"]):
            part = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_removed", T.BooleanType())])).parquet(f"{self.root}/{name}").withColumn("_at", F.lit(i))
            log = part if log is None else log.unionByName(part)
        last = log.groupBy(*self.key).agg(F.max_by(F.struct(*rest, "_removed"), F.struct("_at", *self.order)).alias("_last"))
        old, new = whole.alias("old"), last.alias("new")
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.key]
        kept = old.join(new, same, "left_anti").select(*schema.names)
        put = last.where("not _last._removed").select(*[F.col(n) if n in self.key else F.col(f"_last.{n}").alias(n) for n in schema.names])
        return kept.unionByName(put.where(wanted) if wanted is not None else put)

    def compact(self) -> int:
        """A new version with the rows of the latest, as one snapshot. Returns its number."""
        before = self.entry()
        if before is None:
            raise ValueError(f"{self.root} has no version")
        rows = self.read(before["version"])
        return self._next(before, "compact", self._write(rows, self.by), [], rows.schema)

    def history(self) -> DataFrame:
        """(version, kind, at_ms, changes): the versions that are kept and the appends each has yet to fold."""
        rows = [(e["version"], e["kind"], e["at_ms"], len(e["changes"])) for e in map(self.entry, self.versions())]
        return self.spark.createDataFrame(rows, "version long, kind string, at_ms long, changes int")

    def vacuum(self, keep: int = 2, older_ms: int = 86_400_000) -> list[str]:
        """Forgets all but the latest ``keep`` versions, and deletes what none of these names. Folders younger than
        ``older_ms`` stay, as they may belong to a write that has yet to commit or to a reader of an older version."""
        known = self.versions()
        live = {name for v in known[-keep:] for e in [self.entry(v)] for name in [e["snapshot"], *e["changes"]] if name}
        until = int(time.time() * 1000) - older_ms
        gone = [f for f in self._files("data") if f"data/{f.getPath().getName()}" not in live and f.getModificationTime() <= until]
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v:020d}.json"), False)
        for f in gone:
            self._fs.delete(f.getPath(), True)
        return [f"data/{f.getPath().getName()}" for f in gone]
