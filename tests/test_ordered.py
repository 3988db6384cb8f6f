"""Ranks, sums and last values over ranges equal those of windows, also where one key holds all rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferry.operators import ledger, ordered, schedule, throttle
from ferry.plans.scratch import Scratch


def rows(spark, n=400, keys="abc", seed=1):
    rng = random.Random(seed)
    data = [(rng.choice([*keys, "a", None]), rng.choice([None, 1, 2, 3, 500]), i, rng.choice([None, 1, 2, 7])) for i in range(n)]
    return spark.createDataFrame(data, "k string, t long, seq long, v long")


def test_ranges_equal_windows(spark):
    df, w = rows(spark), Window.partitionBy("k").orderBy("t", "seq")
    s = Scratch(spark, "ordered")
    for blocks in (1, 7, 40):
        got = ordered.rank(df, ["k"], ["t", "seq"], s, "n", blocks)
        assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("n", F.row_number().over(w).cast("long")).collect()))
        got = ordered.running_sum(df, ["k"], ["t", "seq"], F.col("v"), s, "sum", blocks)
        want = df.withColumn("sum", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        got = ordered.last_before(df, ["k"], ["t", "seq"], F.col("v"), s, "last", blocks)
        want = df.withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordered.rank(df.limit(0), ["k"], ["t", "seq"], s, "n").count() == 0


def test_a_key_with_all_rows_is_spread(spark):
    df = spark.range(2_000).selectExpr("'a' as instance", "concat('f', id) as relpath", "'ready' as state", "id % 3 as discovered_at", "0L as next_attempt_at")
    s = Scratch(spark, "spread")
    got = ledger.drain(df, 1, 7, s, blocks=8)
    held = spark.read.parquet(s.path("rank-_n"))
    sizes = [r["count"] for r in held.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    assert "Window" in got._jdf.queryExecution().executedPlan().toString() and "_block" in str(got._jdf.queryExecution().analyzed().toString())
    order = {r.relpath: i for i, r in enumerate(df.orderBy("discovered_at", "relpath").collect())}
    assert all(r.batch == order[r.relpath] // 7 + 1 for r in got.collect())


def test_transitions_over_ranges(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(50), i, rng.choice(["windowed", "triggered", "none"])) for i in range(300)]
    df = spark.createDataFrame(data, "instance string, ts long, seq long, kind string")
    want, is_open = [], {}
    for i, t, q, kind in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        if kind == "triggered":
            want.append((i, q, "triggered"))
        elif (kind == "windowed") != is_open.get(i, False):
            want.append((i, q, "opened" if kind == "windowed" else "closed"))
            is_open[i] = kind == "windowed"
    for blocks in (1, 9):
        got = schedule.schedule_transitions(df, Scratch(spark, "edges"), blocks)
        assert sorted((r.instance, r.seq, r.edge) for r in got.collect()) == sorted(want)


def test_first_after_and_reached(spark):
    df, s = rows(spark), Scratch(spark, "after")
    w = Window.partitionBy("k").orderBy(F.asc_nulls_first("t"), "seq")
    want = df.withColumn("next", F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    for blocks in (1, 9):
        assert sorted(map(str, ordered.first_after(df, ["k"], ["t", "seq"], F.col("v"), s, "next", blocks).collect())) == sorted(map(str, want.collect()))
    chain = spark.createDataFrame([(i, i + 3) for i in range(100)], "id long, next long")
    got = {r.id for r in ordered.reached(chain, spark.createDataFrame([(0,), (50,)], "id long"), s).collect()}
    assert got == set(range(0, 103, 3)) | set(range(50, 103, 3))
    try:
        ordered.reached(spark.createDataFrame([(1, 1)], "id long, next long"), spark.createDataFrame([(1,)], "id long"), s, "loop", most=5)
        raise AssertionError("a circle has no end")
    except ValueError:
        pass


def replay(data, relog):
    out, last = [], {}
    for i, scope, kind, t, q, rec in sorted(data, key=lambda r: (r[3], r[4])):
        if rec:
            last = {k: v for k, v in last.items() if k[:2] != (i, scope)}
        elif (i, scope, kind) not in last or t - last[i, scope, kind] >= relog:
            last[i, scope, kind] = t
            out.append(q)
    return sorted(out)


def test_log_once_over_ranges_equals_the_replay(spark):
    rng = random.Random(8)
    schema = "instance string, scope string, kind string, ts_ms long, seq long, recovered boolean"
    for scopes, recover, blocks in (("ab", 0.05, None), ("a", 0.0, 12), ("a", 0.01, 5)):
        data = [("i", rng.choice(scopes), rng.choice("xxy") if recover else "x", rng.randrange(60_000), q, rng.random() < recover) for q in range(1_500)]
        df = spark.createDataFrame(data, schema)
        s = Scratch(spark, "once")
        assert sorted(r.seq for r in throttle.log_once(df, 700, s, blocks).collect()) == replay(data, 700)
        if blocks == 12:  # one island holds all rows: it is dealt into ranges
            sizes = [r["count"] for r in spark.read.parquet(s.path("spaced")).groupBy("_block").count().collect()]
            assert len(sizes) == 12 and max(sizes) < 300
    df = spark.createDataFrame(data, schema)
    assert throttle.log_once(df, 0).count() == df.where("not recovered").count() and throttle.log_once(df.limit(0), 700).count() == 0
