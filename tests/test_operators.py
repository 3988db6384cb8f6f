"""Cases with hand-checked results, and properties against sequential replay."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ferry.functions.keys import byte_rate, dest_key, duration_ms, glob_regex
from ferry.operators import integrity, ledger, parts, policy, ready, retry, schedule, select, status, throttle
from ferry.plans.scratch import Scratch
from ferry.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "ms"), [("7d", 604_800_000), ("15m", 900_000), ("500ms", 500), ("1.5h", 5_400_000), ("30s", 30_000), ("42", 42), (" 2 S ", 2_000), ("bad", None), ("", None), ("-1s", None)])
def test_durations(spark, text, ms):
    assert one(spark, duration_ms(F.lit(text))) == ms


@pytest.mark.parametrize(("text", "rate"), [("20MB/s", 20_000_000), ("1Gbps", 125_000_000), ("512", 512), ("1MiB", 1_048_576), ("5Mbps", 625_000), ("2 kb/sec", 2_000), ("x", None), ("", None), ("3QB", None)])
def test_rates(spark, text, rate):
    assert one(spark, byte_rate(F.lit(text))) == rate


@pytest.mark.parametrize(("prefix", "rel", "key"), [("", "a/b", "a/b"), ("/p/", "a//./../b", "p/a/b"), ("p", "", "p"), ("p", "/a", "p/a"), ("", "../..", "")])
def test_keys(spark, prefix, rel, key):
    assert one(spark, dest_key(prefix, F.lit(rel))) == key


def test_globs():
    import re

    def hit(p, s):
        return re.fullmatch(glob_regex(p), s, re.S) is not None

    assert hit("*.csv", "a/b.csv") and hit("**/x", "x") and hit("**/x", "a/b/x") and hit("a/**/b", "a/b") and hit("?[!b-d].{x,y}", "qa.x") and not hit("?[!b-d].{x,y}", "qb.x")
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            glob_regex(bad)


def test_collisions(spark):
    plan = spark.createDataFrame([("a/r.csv", 1), ("a/r.csv", 2), ("data", 1), ("free.x", 1)], "target string, seq int")
    there = spark.createDataFrame([("a/r.csv",), ("a/r.1.csv",), ("data",), ("data.2",)], "path string")
    got = {(r["target"], r["seq"]): r["final"] for r in select.resolve_collisions(plan, there).collect()}
    assert got == {("a/r.csv", 1): "a/r.2.csv", ("a/r.csv", 2): "a/r.3.csv", ("data", 1): "data.1", ("free.x", 1): "free.x"}
    fail = {(r["target"], r["seq"]): r["error"] for r in select.resolve_collisions(plan, there, "fail").collect()}
    assert fail[("free.x", 1)] is None and fail[("data", 1)]


def test_prune_is_by_component(spark):
    m = spark.createDataFrame([("i", "out/a"), ("i", "outer/a"), ("i", "out")], "instance string, relpath string")
    assert [r["relpath"] for r in select.prune_dirs(m, spark.createDataFrame([("i", "out"), ("j", "outer")], "instance string, dir string")).collect()] == ["outer/a"]


def test_stability_restarts_and_zero_quiet(spark):
    o = spark.createDataFrame([("i", "f", 1, 0, 5, 1), ("i", "f", 2, 4_000, 5, 1), ("i", "f", 3, 5_000, 5, 1), ("i", "f", 4, 6_000, 6, 1), ("i", "f", 5, 11_000, 6, 1)], "instance string, relpath string, seq int, observed_ms long, size long, mtime_ms long")
    got = {r["seq"]: r["ready"] for r in ready.ready_by_stability(o).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True}
    assert {r["seq"]: r["ready"] for r in ready.ready_by_stability(o, 0).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}


@pytest.mark.parametrize(("n", "cap"), [(1, 1_000), (2, 2_000), (11, 900_000), (34, 900_000), (10**6, 900_000)])
def test_backoff_cap(spark, n, cap):
    assert one(spark, retry.backoff_cap(F.lit(n), F.lit(1_000), F.lit(900_000))) == cap


def test_unknown_state_is_an_error(spark):
    with pytest.raises(Exception, match="unknown item state"):
        spark.createDataFrame([("odd",)], "s string").select(ledger.checked_state(F.col("s"))).collect()


MIB = 1 << 20


@pytest.mark.parametrize(("size", "mode", "part", "n"), [(0, "single", 0, 1), (16 * MIB, "single", 16 * MIB, 1), (17 * MIB, "multipart", 16 * MIB, 2), (200_000 * MIB, "multipart", 20 * MIB * 1, 10_000)])
def test_part_plans(spark, size, mode, part, n):
    plan = parts.plan_parts(spark.createDataFrame([(1, size)], "object int, size long"))
    assert tuple(plan.first())[2:] == (mode, part, n)
    total = parts.explode_parts(plan).agg(F.sum("len"), F.count("*")).first()
    assert tuple(total) == (size, n)


def test_bytes_committed_do_not_lay_out_or_broadcast_the_plan(spark):
    objects = spark.createDataFrame([(1, 40 << 20), (2, 5), (3, 0), (4, 100 << 20)], "object long, size long")
    uploaded = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (1, 4), (1, 0), (2, 1), (3, 1), (9, 1)], "object long, part long")
    got = parts.bytes_committed(parts.plan_parts(objects, "s3"), uploaded)
    assert {tuple(r) for r in got.collect()} == {(1, 24 << 20), (2, 5), (3, 0)}
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan


def test_crc32c_and_its_combination(spark):
    assert integrity.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(1)
    for _ in range(20):
        a, b = rng.randbytes(rng.randrange(1, 300)), rng.randbytes(rng.randrange(1, 300))
        assert integrity.combine_crc32c(integrity.crc32c(a), integrity.crc32c(b), len(b)) == integrity.crc32c(a + b)


def test_files_are_listed_copied_checked_and_archived(spark, tmp_path):
    src, rng = tmp_path / "src", random.Random(2)
    body = {"a/x.bin": rng.randbytes(70_000), "a/b/y.bin": b"q", "z.bin": rng.randbytes(5)}
    for k, v in body.items():
        (src / k).parent.mkdir(parents=True, exist_ok=True)
        (src / k).write_bytes(v)
    listed = files.scan_manifest(spark, {"i": str(src)})
    assert {r["relpath"]: r["size"] for r in listed.collect()} == {k: len(v) for k, v in body.items()}
    dst = str(tmp_path / "dst")
    got = {r["key"]: r for r in files.copy_files(listed.withColumn("key", F.col("relpath")), dst).collect()}
    assert {k: r["hex"] for k, r in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in body.items()}
    sums = {r["path"]: r["hex"] for r in integrity.checksum_files(listed, "crc32c", part=30_000).collect()}
    assert sums == {str(src / k): f"{integrity.crc32c(v):08x}" for k, v in body.items()}
    big = listed.where("relpath = 'a/x.bin'").select("path", F.lit("big").alias("key"), "size").withColumn("object", F.col("key"))
    plan = parts.plan_parts(big, "http", 16_384)
    ranges = parts.explode_parts(plan)
    assert {r["sent"] for r in files.copy_large(ranges, dst).collect()} == {True}
    done = files.copy_large(ranges, dst)
    assert {r["sent"] for r in done.collect()} == {False}
    assert files.assemble(done, plan, dst).first()["committed"] and open(os.path.join(dst, "big"), "rb").read() == body["a/x.bin"]
    plan = listed.select("path", F.when(F.col("relpath") == "z.bin", "delete").otherwise("archive").alias("action"), F.concat(F.lit(str(tmp_path / "arch") + "/"), "relpath").alias("target"), (F.col("relpath") != "a/b/y.bin").alias("verified"), "size").collect()
    plan = [(*r, hashlib.sha256(body[os.path.relpath(r["path"], src)]).hexdigest()) for r in plan]
    plan = spark.createDataFrame(plan, "path string, action string, target string, verified boolean, size long, hex string")
    for job in ("first", "again"):
        acts = files.apply_actions(plan, Scratch(spark, job))
        for _ in range(2):
            assert {os.path.basename(r["path"]): r["outcome"] for r in acts.collect()} == {"x.bin": "moved", "y.bin": "unverified", "z.bin": "deleted"}
    assert (tmp_path / "arch/a/x.bin").read_bytes() == body["a/x.bin"] and (src / "a/b/y.bin").exists() and not (src / "z.bin").exists()
    (tmp_path / "arch/a/b").mkdir()
    (tmp_path / "arch/a/b/y.bin").write_bytes(b"archived before")
    got = files.apply_actions(plan.where("path like '%y.bin'").withColumn("verified", F.lit(True)), Scratch(spark, "third")).first()["outcome"]
    assert got == "taken" and (tmp_path / "arch/a/b/y.bin").read_bytes() == b"archived before" and (src / "a/b/y.bin").exists()


def test_arrivals_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.txt").write_text("1")
    q = files.stream_manifest(spark, {"i": str(src)}, shares=1).drop("mtime_ms").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["instance"], r["relpath"], r["size"]) for r in spark.sql("select * from arrivals").collect()] == [("i", "one.txt", 1)]


def test_daylight_saving_fires(spark):
    s = spark.createDataFrame([("ny", "America/New_York", [0], [2], None, None, None), ("ch", "America/Chicago", [30], [1], None, None, None)], "schedule string, tz string, minutes array<int>, hours array<int>, doms array<int>, months array<int>, dows array<int>")

    def ms(text):
        return spark.sql(f"select unix_millis(timestamp'{text}Z')").first()[0]

    spring = {r["fire_ms"] for r in schedule.expand_fires(s, ms("2026-03-08 00:00:00"), ms("2026-03-09 00:00:00")).where("schedule = 'ny'").collect()}
    assert spring == {ms("2026-03-08 06:59:59")}
    autumn = {r["fire_ms"] for r in schedule.expand_fires(s, ms("2026-11-01 00:00:00"), ms("2026-11-02 00:00:00")).where("schedule = 'ch'").collect()}
    assert autumn == {ms("2026-11-01 06:30:00")}


def test_window_edges_are_half_open(spark):
    w = spark.createDataFrame([("s", 1_000, 2_000)], "schedule string, open_ms long, close_ms long")
    p = spark.createDataFrame([("s", 999), ("s", 1_000), ("s", 1_999), ("s", 2_000)], "schedule string, t_ms long")
    got = {r["t_ms"]: (r["open"], r["until"], r["opens_at"]) for r in schedule.window_state(p, w).collect()}
    assert got == {999: (False, None, 1_000), 1_000: (True, 2_000, None), 1_999: (True, 2_000, None), 2_000: (False, None, None)}


def test_throttle_equals_replay(spark):
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(400):
        t += rng.randrange(0, 900)
        rows.append((t, i, rng.randrange(0, 5_000)))
    got = {r["seq"]: r["wait_ms"] for r in throttle.throttle_accounting(spark.createDataFrame(rows, "t_ms long, seq long, bytes long"), [], 3, 3_000, bucket_ms=5_000).collect()}
    tokens, last = 3_000.0, rows[0][0]
    for t, i, n in rows:
        tokens = min(3_000.0, tokens + (t - last) * 3) - n
        last = t
        assert abs(got[i] - max(0.0, -tokens) / 3) < 1e-6


DESTS = "instance string, relpath string, dest string, phase string, attempts long, next_attempt_at long, last_error string"


def test_an_item_is_verified_only_when_every_configured_destination_is(spark):
    items = spark.createDataFrame([("i", f, 2) for f in ("half", "all", "none", "bad", "alien")], "instance string, relpath string, attempts long")
    egress = spark.createDataFrame([("i", "a"), ("i", "b")], "instance string, dest string")
    rows = [("i", "half", "a"), ("i", "all", "a"), ("i", "all", "b"), ("i", "alien", "a"), ("i", "alien", "gone")]
    states = spark.createDataFrame([(*r, "verified", 1, 0, None) for r in rows] + [("i", "bad", "a", "exhausted", 9, 0, "no"), ("i", "bad", "b", "pending", 3, 77, "e")], DESTS)
    got = {r["relpath"]: (r["state"], r["attempts"], r["next_attempt_at"], r["last_error"]) for r in retry.rollup_items(items, egress, states).collect()}
    assert got == {"half": ("failed", 3, 0, None), "all": ("verified", 2, 0, None), "none": ("failed", 3, 0, None), "bad": ("exhausted", 9, 0, "a: no"), "alien": ("failed", 3, 0, None)}


def test_recovery_completes_only_what_verifies_at_every_configured_destination(spark):
    ledger_ = spark.createDataFrame([("i", "bare", "verified"), ("i", "half", "verified"), ("i", "all", "verified"), ("i", "busy", "in_progress"), ("i", "out", "exhausted"), ("j", "lost", "verified")], "instance string, relpath string, state string")
    egress = spark.createDataFrame([("i", "a"), ("i", "b")], "instance string, dest string")
    states = spark.createDataFrame([("i", "half", "a", "verified", 0, 0, None), ("i", "busy", "a", "verified", 0, 0, None), ("i", "all", "a", "verified", 0, 0, None)], DESTS)
    checks = spark.createDataFrame([("i", "half", "a", True), ("i", "all", "a", True), ("i", "all", "b", True), ("i", "busy", "a", False)], "instance string, relpath string, dest string, ok boolean")
    got = {r["relpath"]: (r["action"], r["confirmed"], r["demoted"]) for r in retry.recovery_plan(ledger_, egress, states, checks).collect()}
    assert got == {"bare": ("ready", 0, 2), "half": ("ready", 1, 1), "all": ("complete", 2, 0), "busy": ("ready", 0, 1), "out": ("finish", 0, 0), "lost": ("ready", 0, 0)}


def test_retries_of_an_instance_without_policy_take_the_built_in_values(spark):
    a = spark.createDataFrame([("x", "f", "d", 2, False, 0)], "instance string, relpath string, dest string, attempts long, permanent boolean, discovered_at long")
    none = spark.createDataFrame([], "instance string, base_ms long, max_ms long, max_attempts long, give_up_after_ms long")
    r = retry.retry_decision(a, none, 1_000).first()
    assert (r["decision"], r["new_attempts"], r["delay_cap_ms"]) == ("retry", 3, 4_000)


def test_gaps_of_any_length_resolve_to_just_before_them(spark):
    def ms(local, tz):
        return spark.sql(f"select timestamp_ntz'{local}' as t").select(schedule.local_to_ms(F.col("t").cast("timestamp"), F.lit(tz)).alias("x")).first()["x"]

    def utc(text):
        return spark.sql(f"select unix_millis(timestamp'{text}Z')").first()[0]

    assert ms("2011-12-30 12:00:00", "Pacific/Apia") == utc("2011-12-30 09:59:59")
    assert ms("2026-03-08 02:30:00", "America/New_York") == utc("2026-03-08 06:59:59")
    assert ms("2026-10-04 02:15:00", "Australia/Lord_Howe") == utc("2026-10-03 15:29:59")


def test_crc32c_in_lanes_is_the_plain_one():
    rng = random.Random(9)
    for n in (4_095, 4_096, 5_001, 65_537, 300_000):
        d = rng.randbytes(n)
        assert integrity.crc32c(d, 7) == integrity._plain(d, 7 ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def test_each_instance_has_its_own_strategy_patterns_and_suffix(spark):
    m = spark.createDataFrame([(i, f) for i in "abcde" for f in ("x.csv", "x.csv.ok", "y.txt", "y.txt.done")], "instance string, relpath string")
    pol = spark.createDataFrame([("a", "marker", ".ok"), ("b", "marker", None), ("c", "glob", None), ("d", "glob", None)], "instance string, strategy string, suffix string")
    stable = spark.createDataFrame([("e", "y.txt"), ("a", "y.txt")], "instance string, relpath string")
    got = {(r["instance"], r["relpath"]) for r in select.is_ready(m, pol, stable, {"c": (["*.csv"], [])}).collect()}
    assert got == {("a", "x.csv"), ("b", "y.txt"), ("c", "x.csv"), ("e", "y.txt")} | {("d", f) for f in ("x.csv", "x.csv.ok", "y.txt", "y.txt.done")}


@pytest.mark.parametrize(
    "text, base, zone, malformed",
    [
        ('{"global":{"defaults":{"timezone":"UTC","retry":{"baseDelayMs":7.9}}}}', 7, "UTC", False),
        ('{"global":{"defaults":{"timezone":"UTC","retry":{"baseDelayMs":"7"}}}}', None, None, True),
        ('{"global":{"defaults":{"timezone":1,"retry":{"baseDelayMs":7}}}}', None, None, True),
        ('{"global":{"defaults":{"timezone":null,"retry":{"baseDelayMs":-7}}}}', 0, None, False),
        ('{"global":[1]}', None, None, True),
        ('{"instances":[]}', None, None, False),
        ("{", None, None, True),
        (None, None, None, False),
    ],
)
def test_a_malformed_global_block_sets_nothing(spark, text, base, zone, malformed):
    r = policy.load_globals(spark.createDataFrame([(1, text)], "device int, json string")).first()
    assert (r["base_ms"], r["timezone"], r["malformed"]) == (base, zone, malformed)


def test_ten_thousand_instances_with_patterns_of_their_own(spark):
    n = 10_000
    patterns = {f"i{k}": ([f"a{k % 7}/*.csv", "b/**"], ["b/x?"] if k % 2 else []) for k in range(n)}
    names = ["a3/q.csv", "b/y", "b/x1", "c"]
    m = spark.range(n).selectExpr("concat('i', id) as instance", "explode(array('a3/q.csv', 'b/y', 'b/x1', 'c')) as relpath")
    policies = spark.range(n + 1).selectExpr("concat('i', id) as instance", "'glob' as strategy")
    more = m.unionByName(spark.createDataFrame([(f"i{n}", "c"), ("none", "c")], "instance string, relpath string"))
    want = sum(f == "b/y" or f == "b/x1" and not k % 2 or f == "a3/q.csv" and k % 7 == 3 for k in range(n) for f in names)
    ready = select.is_ready(more, policies, spark.createDataFrame([("none", "c")], "instance string, relpath string"), patterns)
    assert ready.count() == want + 2
    assert select.select_by_table(more, select.pattern_table(spark, patterns)).count() == want + 2
    one = select.select_globs(m.where("instance = 'i3'"), *patterns["i3"]).collect()
    assert {r.relpath for r in one} == {r.relpath for r in select.select_by_table(m.where("instance = 'i3'"), select.pattern_table(spark, patterns)).collect()} == {"a3/q.csv", "b/y"}


def test_states_by_events_and_where_the_ledger_disagrees(spark):
    ev = [
        ("i", "a", "x", "replication-completed", 1, 1), ("i", "a", "y", "replication-completed", 2, 2), ("i", "a", None, "file-archived", 3, 3),
        ("i", "b", None, "file-discovered", 1, 1), ("i", "b", "x", "replication-failed", 2, 2), ("i", "b", "x", "replication-completed", 3, 3), ("i", "b", "gone", "retries-exhausted", 9, 9),
        ("i", "c", "x", "replication-completed", 1, 1), ("i", "c", "y", "replication-progress", 2, 2), ("i", "d", None, "file-ready", 1, 1),
        ("i", "e", None, "file-quarantined", 1, 1), ("i", "e", "x", "replication-started", 2, 2), ("j", "f", "x", "retries-exhausted", 2, 2), (None, "g", None, "file-ready", 1, 1),
    ]
    events = spark.createDataFrame(ev, "instance string, path string, dest string, event string, ts long, seq long")
    egress = spark.createDataFrame([("i", "x"), ("i", "y"), ("j", "x")], "instance string, dest string")
    items = status.items_from_events(events, egress)
    assert {r.relpath: r.state for r in items.collect()} == {"a": "completed", "b": "ready", "c": "in_progress", "d": "ready", "e": "in_progress", "f": "exhausted", "g": "ready"}
    led = spark.createDataFrame([("i", "a", "completed"), ("i", "b", "verified"), ("i", "c", "in_progress"), ("i", "z", "ready"), (None, "g", "ready")], "instance string, relpath string, state string")
    got = {(r.instance, r.relpath, r.by_events, r.by_ledger) for r in status.item_disagreements(items, led).collect()}
    assert got == {("i", "b", "ready", "verified"), ("i", "d", "ready", None), ("i", "e", "in_progress", None), ("i", "z", None, "ready"), ("j", "f", "exhausted", None)}
    got = {(r.instance, r.measure, r.by_events, r.by_ledger) for r in status.status_disagreements(items, led).collect()}
    assert got == {("i", "awaiting", 2, 1), ("i", "in_progress", 2, 1), ("i", "replicated", 1, 2), ("j", "failed", 1, 0)}
