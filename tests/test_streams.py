"""Streams with timers and bounded state, and the arrival source."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ferry.operators import metrics, ready, throttle
from ferry.sources import arrivals, files
from ferry.streaming import stateful, streams

OBS = "instance string, relpath string, seq long, observed_ms long, size long, mtime_ms long"


def batches(spark, folder, schema, parts):
    """A stream that takes one part a batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(out, tmp_path, name="q"):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in out.sparkSession.table(name).collect()], q


def plain_release(rows, quiet, end):
    out, by = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        by.setdefault(r[:2], []).append(r)
    for key, seen in by.items():
        i = 0
        while i < len(seen):
            j = i
            while j + 1 < len(seen) and seen[j + 1][4:] == seen[i][4:]:
                j += 1
            due = seen[i][3] + quiet
            # complete when the quiet time ends before the next change, and is known to have ended
            if (seen[j + 1][3] > due) if j + 1 < len(seen) else (due <= seen[j][3] or due < end):
                out.append((*key, *seen[i][4:], seen[i][3], due))
            i = j + 1
    return sorted(out)


def test_a_quiet_file_is_released_without_another_observation(spark, tmp_path):
    parts = [[("i", "quiet", 1, 1_000, 5, 5), ("i", "busy", 2, 2_000, 1, 1)], [("i", "busy", 3, 6_500, 2, 2)], [("j", "other", 4, 60_000, 1, 1)]]
    got, _ = drained(stateful.stream_release(batches(spark, tmp_path / "in", OBS, parts), 5_000), tmp_path, "quiet")
    assert sorted(got) == [("i", "busy", 2, 2, 6_500, 11_500), ("i", "quiet", 5, 5, 1_000, 6_000)]


def test_releases_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], 10_000
    for seq in range(300):
        t += rng.choice([0, 100, 400, 1500])
        rows.append((rng.choice("ij"), rng.choice("abcd"), seq, t, rng.choice([1, 1, 1, 2]), 7))
    want = plain_release(rows, 3_000, t)
    assert len(want) > 30
    for n in (1, 5):
        cuts = sorted(rng.sample(range(1, 300), n - 1))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
        got, _ = drained(stateful.stream_release(batches(spark, tmp_path / f"in{n}", OBS, parts), 3_000), tmp_path, f"release{n}")
        assert sorted(got) == want


def test_release_by_the_wall_clock(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", OBS, [[("i", "a", 1, 0, 5, 5)]])
    out = stateful.stream_release(stream, 1_000, 60_000, clock="processing")
    with stateful.rocksdb(spark):
        q = out.writeStream.format("memory").queryName("wall").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while not spark.table("wall").count() and time.time() < until:
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r.relpath, r.size, r.ready_ms - r.since) for r in spark.table("wall").collect()] == [("a", 5, 1_000)]


def state_rows(q):
    return [o["numRowsTotal"] for o in q.lastProgress["stateOperators"]]


def test_state_goes_when_it_can_hold_nothing_back(spark, tmp_path):
    issues = "instance string, scope string, kind string, ts_ms long, seq long, recovered boolean"
    rows = [("i", f"s{k % 3}", "k", 1_000_000 + 10 * k, k, False) for k in range(30)]
    later = [("z", "last", "k", 9_000_000, 99, True)]
    got, q = drained(stateful.stream_log_once(batches(spark, tmp_path / "a", issues, [rows, later]), 1_000), tmp_path, "once")
    assert len(got) == 3 and state_rows(q) == [0]
    ticks = "transfer long, tick long, percent long, now_ms long"
    rows = [(k % 4, k, k, 1_000_000 + k) for k in range(40)]
    got, q = drained(stateful.stream_progress(batches(spark, tmp_path / "b", ticks, [rows, [(9, 1, 100, 9_000_000)]]), 10, 5_000), tmp_path, "ticks")
    assert state_rows(q)[0] <= 2 and {r[0] for r in got} == {0, 1, 2, 3, 9}  # what is left is of the last transfer
    rows = [("i", f"f{k}", k, 1_000 + k, 1, 1) for k in range(20)]
    got, q = drained(stateful.stream_release(batches(spark, tmp_path / "c", OBS, [rows, [("z", "z", 99, 9_000_000, 1, 1)]]), 1_000, 5_000), tmp_path, "evict")
    assert len(got) == 20 and state_rows(q)[0] <= 3


def test_filters_as_streams_equal_the_batch_operators(spark, tmp_path):
    rng = random.Random(6)
    schema = "instance string, scope string, kind string, ts_ms long, seq long, recovered boolean"
    rows = [("i", rng.choice("ab"), rng.choice("xy"), 1_000_000 + 40 * k, k, rng.random() < 0.05) for k in range(200)]
    want = sorted(r.seq for r in throttle.log_once(spark.createDataFrame(rows, schema), 500).collect())
    got, _ = drained(stateful.stream_log_once(batches(spark, tmp_path / "a", schema, [rows[:70], rows[70:71], rows[71:]]), 500), tmp_path, "once2")
    assert sorted(r[4] for r in got) == want
    schema = "transfer long, tick long, percent long, now_ms long"
    rows = [(rng.randrange(3), k, rng.randrange(0, 105), 1_000_000 + 90 * k) for k in range(200)]
    want = sorted(r.tick for r in throttle.throttle_progress(spark.createDataFrame(rows, schema), 10, 2_000).collect())
    got, _ = drained(stateful.stream_progress(batches(spark, tmp_path / "b", schema, [rows[:50], rows[50:90], rows[90:]]), 10, 2_000), tmp_path, "ticks2")
    assert sorted(r[1] for r in got) == want


def test_metric_groups_as_streams(spark, tmp_path):
    schema = "instance string, ts_ms long, result string, bytes long"
    rng = random.Random(3)
    rows = [(rng.choice("ij"), 60_000 * 100 + 700 * k, rng.choice(["replicated", "failed", "other"]), k) for k in range(400)]
    want = sorted(tuple(r) for r in metrics.metrics_compat(spark.createDataFrame(rows, schema)).collect())
    stream = batches(spark, tmp_path / "in", schema, [rows[:100], rows[100:250], rows[250:]])
    from ferry.streaming import streams

    got, _ = drained(streams.stream_group(stream, "compat", late="1 second"), tmp_path, "compat")
    end = 60_000 * 100 + 700 * 399 - 1_000
    columns = metrics.metrics_compat(spark.createDataFrame(rows, schema)).columns
    at = columns.index("interval_ms")
    assert sorted(got) == [r for r in want if r[at] + 60_000 <= end] and len(got) > 6
    with pytest.raises(ValueError):
        streams.stream_group(stream, "unknown")


def first_state_rows(q):
    """Rows of the state of the step that is next to the source."""
    return q.lastProgress["stateOperators"][-1]["numRowsTotal"]


def test_queue_of_many_items_keeps_state_by_buckets(spark, tmp_path):
    rng = random.Random(8)
    states = [*stateful.QUEUED, "verified", None]
    log = [("ij"[k % 2], f"f{k % 3_000}", rng.choice(states), rng.randrange(50), 1_000_000 + 20 * k, k) for k in range(6_000)]
    end = ("z", "z", "ready", 1, 9_000_000, 9_999)
    schema = "instance string, relpath string, state string, size long, ts_ms long, seq long"
    got, q = drained(streams.stream_queue(batches(spark, tmp_path / "in", schema, [log[:2_500], log[2_500:], [end]])), tmp_path, "gauges")
    want, last, total = {}, {}, {}
    for i, path, state, size, at, _ in log:
        had = last.get((i, path), (None, 0))
        if (state, size) != had:
            t = total.setdefault(i, dict.fromkeys([*stateful.QUEUED, "bytes"], 0))
            for sign, (s, n) in ((-1, had), (1, (state, size))):
                if s in t:
                    t[s] += sign
                t["bytes"] += sign * n * (s == "ready")
            last[i, path] = (state, size)
            want[i, at // 60_000 * 60_000] = (*t.values(), t["failed"], t["in_progress"])
    assert sorted(got) == sorted((*k, *v) for k, v in want.items())
    assert first_state_rows(q) <= stateful.BUCKETS  # 3,001 items


def test_readiness_of_many_files_keeps_state_by_buckets(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("ij"), f"f{rng.randrange(1_500)}", k, 1_000_000 + 10 * k, rng.choice([1, 1, 2]), 7) for k in range(6_000)]
    want = sorted(r.seq for r in ready.ready_by_stability(spark.createDataFrame(rows, OBS), 20_000).where("ready").collect())
    got, q = drained(streams.stream_readiness(batches(spark, tmp_path / "in", OBS, [rows[:2_000], rows[2_000:2_001], rows[2_001:]]), 20_000), tmp_path, "settled")
    assert sorted(r[2] for r in got) == want and want
    assert first_state_rows(q) <= stateful.BUCKETS


def test_releases_of_many_files_keep_state_and_timers_by_buckets(spark, tmp_path):
    rng = random.Random(10)
    rows = [("i", f"f{rng.randrange(4_000)}", k, 1_000_000 + 10 * k, rng.choice([1, 1, 2]), 7) for k in range(8_000)]
    out = stateful.stream_release(batches(spark, tmp_path / "in", OBS, [rows[:3_000], rows[3_000:]]), 20_000)
    got, q = drained(out, tmp_path, "many")
    assert sorted(got) == plain_release(rows, 20_000, rows[-1][3])
    assert first_state_rows(q) <= 3 * stateful.BUCKETS  # state, and a timer from both sides


def run_arrivals(spark, roots, tmp_path, name):
    out = files.stream_manifest(spark, roots, rescan_ms=50, shares=1)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.instance, r.relpath, r.size) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())


def test_arrivals_over_restarts(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "x/y").mkdir(parents=True)
    b.mkdir()
    (a / "x/y/one.txt").write_text("1")
    (a / "_under").write_text("")
    (b / ".hidden").write_text("22")
    roots = {"i": str(a), "j": f"file://{b}"}
    first = [("i", "_under", 0), ("i", "x/y/one.txt", 1), ("j", ".hidden", 2)]
    assert run_arrivals(spark, roots, tmp_path, "first") == first
    time.sleep(0.1)
    (a / "x/y/one.txt").write_text("changed")
    (a / "new").mkdir()
    (a / "new/two.txt").write_text("2")
    assert run_arrivals(spark, roots, tmp_path, "second") == sorted([*first, ("i", "x/y/one.txt", 7), ("i", "new/two.txt", 1)])
    time.sleep(0.1)
    assert len(run_arrivals(spark, roots, tmp_path, "third")) == 5  # nothing has changed


def test_a_sweep_is_taken_a_share_at_a_time(tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/f").write_text("")
    r = arrivals.Sweeps({"i": str(tmp_path), "gone": str(tmp_path / "none")}, rescan_ms=10_000_000, shares=4, depth=1)
    at, seen, sizes = r.initialOffset(), [], []
    for _ in range(4):
        to = r.latestOffset()
        rows = [row for u in r.partitions(at, to) for row in r.read(u)]
        sizes.append(len(rows))
        seen += [row[1] for row in rows if row[6] is None]
        assert r.partitions(at, to) == r.partitions(at, to)
        at = to
    assert sorted(seen) == sorted(f"d{k}/f" for k in range(40)) and max(sizes) < 25 and r.latestOffset() == at
    again, at, seen = arrivals.Sweeps({"i": str(tmp_path)}, rescan_ms=10_000_000, shares=4, depth=1), {"tick": 5}, []
    for _ in range(4):  # after an outage of many sweeps one is read, again a share at a time
        to = again.latestOffset()
        seen += [row[1] for u in again.partitions(at, to) for row in again.read(u)]
        at = to
    assert sorted(seen) == sorted(f"d{k}/f" for k in range(40))
