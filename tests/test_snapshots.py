"""Versioned tables: states that change, writes that are cut off, readers that keep their version."""

import os

import pytest
from pyspark.sql import functions as F

from ferry.sources.snapshots import Snapshots, VersionConflict


def table(spark, rows):
    return spark.createDataFrame(rows, "instance string, relpath string, state string, n int")


def got(df):
    return sorted(((r.instance, r.relpath, r.state, r.n) for r in df.collect()), key=str)


def test_a_changed_state_appears_once(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t", order=("n",))
    s.replace(table(spark, [("i", "a", "failed", 1), ("i", "b", "ready", 1), ("i", "c", "ready", 1), (None, "d", "ready", 1)]))
    s.append(table(spark, [("i", "a", "ready", 2), ("i", "a", "in_progress", 3), ("i", "c", "ready", 2), ("i", "e", "ready", 1), (None, "d", "failed", 2)]), F.col("relpath") == "c")
    want = [("i", "a", "in_progress", 3), ("i", "b", "ready", 1), ("i", "e", "ready", 1), (None, "d", "failed", 2)]
    assert got(s.read()) == sorted(want, key=str)
    assert got(s.read(only=["failed"])) == [(None, "d", "failed", 2)] and got(s.read(only=["ready"])) == [("i", "b", "ready", 1), ("i", "e", "ready", 1)]
    s.replace(table(spark, [("i", "a", "ready", 9), ("i", "b", "ready", 9)]))
    assert got(s.read()) == [("i", "a", "ready", 9), ("i", "b", "ready", 9)]
    assert [r.kind for r in s.history().orderBy("version").collect()] == ["replace", "append", "replace"]


def test_a_write_that_is_cut_off_leaves_the_old_version(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.replace(table(spark, [("i", "a", "ready", 1)]))
    lost = s._write(table(spark, [("i", "a", "failed", 2)]), None)  # the data is there, the version is not
    with pytest.raises(Exception, match="boom"):
        s.append(table(spark, [("i", "a", "failed", 2)]).withColumn("n", F.raise_error(F.lit("boom")).cast("int")))
    assert got(s.read()) == [("i", "a", "ready", 1)] and s.versions() == [1]
    assert s.vacuum(older_ms=10**9) == [] and lost in s.vacuum(older_ms=-1000)
    assert got(s.read()) == [("i", "a", "ready", 1)]


def test_readers_keep_their_version_over_compaction(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/t", compact_after=2)
    s.append(table(spark, [("i", "a", "ready", 1)]))
    pinned = s.read()
    assert s.append(table(spark, [("i", "a", "failed", 2), ("i", "b", "ready", 2)])) == 3  # the append and its compaction
    assert got(pinned) == [("i", "a", "ready", 1)] == got(s.read(1))
    assert s.entry()["changes"] == [] and got(s.read()) == got(s.read(2)) == [("i", "a", "failed", 2), ("i", "b", "ready", 2)]
    s.vacuum(keep=1, older_ms=-1000)
    assert s.versions() == [3] and got(s.read()) == [("i", "a", "failed", 2), ("i", "b", "ready", 2)]
    with pytest.raises(ValueError, match="no version 1"):
        s.read(1)


def test_two_writers_of_one_version(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.replace(table(spark, [("i", "a", "ready", 1)]))
    seen = s.entry()
    s.append(table(spark, [("i", "a", "failed", 2)]))
    with pytest.raises(VersionConflict):
        s._next(seen, "replace", None, [], table(spark, []).schema)
    assert s.versions() == [1, 2] and not [f for f in os.listdir(tmp_path / "t/log") if f.startswith(".") and not f.endswith(".crc")]


def test_empty_tables_and_other_columns(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        s.read()
    s.replace(table(spark, []))
    assert got(s.read()) == [] and got(s.read(only=["ready"])) == []
    s.append(table(spark, []))
    s.compact()
    assert got(s.read()) == []
    with pytest.raises(ValueError, match="columns"):
        s.append(table(spark, []).drop("n"))


def test_a_read_of_one_state_opens_its_folder_only(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.replace(table(spark, [("i", str(i), ("ready", "failed")[i % 2], i) for i in range(10)]))
    plan = s.read(only=["failed"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(state" in plan or "PartitionFilters: [isnotnull(state" in plan
    assert got(s.read(only=["failed"])) == [("i", str(i), "failed", i) for i in (1, 3, 5, 7, 9)]
