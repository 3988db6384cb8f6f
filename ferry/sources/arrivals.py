"""Files as they arrive: a streaming source that sweeps the folders of several roots, of any store, again and again."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ferry.sources import store

SCHEMA = "instance string, relpath string, path string, size long, mtime_ms long, sweep long, issue string"


@dataclass
class Unit(InputPartition):
    """Part of a root that one task lists: a folder and all below it, or the files of a folder alone."""

    instance: str
    root: str
    folder: str
    deep: bool
    sweep: int


class Sweeps(DataSourceStreamReader):
    """An offset is a number of ticks. ``shares`` ticks make a sweep, in which every folder is listed once: a tick lists the
    folders whose names hash to its share. A reader begins a sweep behind and takes it a tick a batch, so a query that starts
    or restarts lists everything first; after a long outage it goes on from there, not from where it was."""

    def __init__(self, roots: dict[str, str], rescan_ms: int, shares: int, depth: int) -> None:
        self.roots, self.rescan, self.shares, self.depth = roots, rescan_ms, shares, depth
        self.at: int | None = None

    def _now(self) -> int:
        return int(time.time() * 1000) * self.shares // self.rescan

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        now = self._now()
        self.at = max(now - self.shares + 1, min(self.at + 1, now) if self.at is not None else 0)
        return {"tick": self.at}

    def _units(self, instance: str, root: str) -> Iterator[tuple[str, bool]]:
        """Folders to list: those ``depth`` levels below the root with all they hold, those above by themselves."""
        level = [root]
        for _ in range(self.depth):
            below = []
            for folder in level:
                yield folder, False
                try:
                    below += [name for name, what, *_ in store.listed(folder) if what == "folder"]
                except OSError:
                    continue  # the task that lists it reports why
            level = below
        for folder in level:
            yield folder, True

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        first, last = start["tick"] + 1, end["tick"]
        first = first if last - first < self.shares else last  # what was skipped comes with the ticks that follow
        due = {t % self.shares: t for t in range(first, last + 1)}
        out = []
        for instance, root in sorted(self.roots.items()):
            for folder, deep in self._units(instance, root):
                share = zlib.crc32(folder.encode("utf-8", "replace")) % self.shares
                if share in due:
                    out.append(Unit(instance, root, folder, deep, due[share]))
        return out

    def read(self, partition: Unit) -> Iterator[tuple]:
        todo, skip = [partition.folder], len(partition.root) + 1
        while todo:
            folder = todo.pop()
            try:
                for name, what, size, mtime in store.listed(folder):
                    if what == "file" and not name.rsplit("/", 1)[1].startswith(store.STAGED):
                        yield partition.instance, name[skip:], name, size, mtime, partition.sweep, None
                    elif what == "folder" and partition.deep:
                        todo.append(name)
            except OSError as e:
                yield partition.instance, None, folder, None, None, partition.sweep, type(e).__name__

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ArrivalSource(DataSource):
    """``spark.readStream.format("ferry_arrivals")`` with options roots (JSON), rescan_ms, shares and depth."""

    @classmethod
    def name(cls) -> str:
        return "ferry_arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Sweeps:
        o = self.options
        roots = {i: r.rstrip("/") or "/" for i, r in json.loads(o["roots"]).items()}
        return Sweeps(roots, int(o.get("rescan_ms", 30_000)), int(o.get("shares", 8)), int(o.get("depth", 1)))


def listings(spark: SparkSession, roots: dict[str, str], rescan_ms: int = 30_000, shares: int = 8, depth: int = 1) -> DataFrame:
    """A2. Every file below each instance's root, again in every sweep, and what could not be listed (``issue``).

    All of them are listed at the start, then each folder every ``rescan_ms``, a share of the folders at a time: ``shares``
    bounds what a batch takes in. Empty files and names that begin with ``_`` or ``.`` are there; folders ``depth`` levels
    down are listed by a task each, the driver only lists what is above.
    """
    spark.dataSource.register(ArrivalSource)
    options = {"roots": json.dumps(roots), "rescan_ms": str(rescan_ms), "shares": str(shares), "depth": str(depth)}
    return spark.readStream.format("ferry_arrivals").options(**options).load()
