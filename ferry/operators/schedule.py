"""Schedules as tables: fires, windows, and what they admit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.operators.ordered import last_before
from ferry.plans.scratch import Scratch

DAY = 86_400_000


def local_to_ms(local: Column, tz: Column) -> Column:
    """Unix milliseconds of a wall-clock time. The repeated hour of autumn takes the earlier offset; a time that a change
    of the clock leaves out resolves to just before that gap, one second short of it, however long the gap is and
    wherever in the hour it begins.

    The gap begins after the last of the minutes before that still have the offset of two days ago; only times inside a
    gap are looked up that way.
    """
    micros = F.unix_micros(F.to_utc_timestamp(local, tz))
    moved = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), tz)) - F.unix_micros(local)
    minute = 60_000_000

    def offset(at):
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), tz)) - at

    start = micros - F.lit(2 * 1440 * minute) - micros % F.lit(minute)
    kept = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2 * 1440).cast("long")), lambda m: offset(start + m * F.lit(minute)) == offset(start))
    edge = start + (F.array_max(kept) + F.lit(1)) * F.lit(minute) - F.lit(1_000_000)
    return F.when(moved > 0, F.floor(edge / 1000)).otherwise(F.floor(micros / 1000)).cast("long")


def expand_fires(schedules: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """H1. Every fire (schedule, fire_ms) in [from, to) of recurrence rows.

    ``schedules``(schedule, tz, minutes, hours, doms, months, dows): arrays of numbers; dows run from 0 for Sunday. Null
    doms, months or dows stand for all of them. Days are generated once and filtered by the sets before hours and minutes
    are laid out, in local time, so the rows stay near the result's size.
    """
    first, last = from_ms // DAY - 1, to_ms // DAY + 1
    days = schedules.withColumn("_d", F.explode(F.expr(f"sequence(date_add(date'1970-01-01', {first}), date_add(date'1970-01-01', {last}))")))
    ok = F.coalesce(F.array_contains("doms", F.dayofmonth("_d")), F.lit(True)) & F.coalesce(F.array_contains("months", F.month("_d")), F.lit(True)) & F.coalesce(F.array_contains("dows", F.dayofweek("_d") - 1), F.lit(True))
    at = days.where(ok).withColumn("_h", F.explode("hours")).withColumn("_m", F.explode("minutes"))
    local = F.timestamp_micros(F.datediff("_d", F.lit("1970-01-01").cast("date")).cast("long") * F.lit(86_400_000_000) + F.col("_h").cast("long") * F.lit(3_600_000_000) + F.col("_m").cast("long") * F.lit(60_000_000))
    out = at.select("schedule", local_to_ms(local, F.col("tz")).alias("fire_ms")).distinct()
    return out.where((F.col("fire_ms") >= from_ms) & (F.col("fire_ms") < to_ms))


def expand_windows(opens: DataFrame, closes: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """H2. [open_ms, close_ms) of each opening fire: up to the first closing fire at or after it, or for the schedule's
    duration in real time."""
    if durations is not None:
        return opens.join(durations.select("schedule", "duration_ms"), "schedule").select("schedule", F.col("fire_ms").alias("open_ms"), (F.col("fire_ms") + F.col("duration_ms")).alias("close_ms"))
    both = opens.select("schedule", F.col("fire_ms").alias("t"), F.lit(1).alias("side")).unionByName(closes.select("schedule", F.col("fire_ms").alias("t"), F.lit(0).alias("side")))
    w = Window.partitionBy("schedule").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("close_ms", F.min(F.when(F.col("side") == 0, F.col("t"))).over(w)).where("side = 1 and close_ms is not null").select("schedule", F.col("t").alias("open_ms"), "close_ms")


def next_wake(fires: DataFrame, now_ms: int) -> DataFrame:
    """H3. The next fire or edge of each schedule after now."""
    return fires.where(F.col("fire_ms") > now_ms).groupBy("schedule").agg(F.min("fire_ms").alias("wake_ms"))


def _days(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / DAY), F.floor(hi / DAY)))


def window_state(probes: DataFrame, windows: DataFrame, time: str = "t_ms") -> DataFrame:
    """C9. Adds ``open``, ``until`` and ``opens_at`` to probe rows with (schedule, time).

    As a fire that opens again takes over from the one before, a window reaches at most to the next opening. Windows are
    exploded to the days they touch and meet the probes of a day by equality; the closed ones' next opening is looked up
    forward over days, of which a schedule has few. Half-open: at the closing instant it is closed.
    """
    nxt = F.lead("open_ms").over(Window.partitionBy("schedule").orderBy("open_ms"))
    w = windows.withColumn("_next", nxt).withColumn("_end", F.least("close_ms", F.coalesce("_next", F.col("close_ms")))).where("_end > open_ms")
    spans = w.select("schedule", "open_ms", "close_ms", "_end", _days(F.col("open_ms"), F.col("_end") - 1).alias("_day"))
    p = probes.withColumn("_day", F.floor(F.col(time) / DAY)).withColumn("_id", F.monotonically_increasing_id())
    hit = p.alias("p").join(spans.alias("s"), (F.col("p.schedule") == F.col("s.schedule")) & (F.col("p._day") == F.col("s._day")) & (F.col("open_ms") <= F.col(time)) & (F.col(time) < F.col("_end")), "left").select("p.*", F.col("close_ms").alias("until"))
    hit = hit.groupBy(*p.columns).agg(F.max("until").alias("until"))
    by_day = windows.select("schedule", F.floor(F.col("open_ms") / DAY).alias("_day"), "open_ms").groupBy("schedule", "_day").agg(F.array_sort(F.collect_set("open_ms")).alias("_opens"))
    span = hit.select("schedule", "_day").distinct()
    later = span.unionByName(by_day.select("schedule", "_day")).distinct().join(by_day, ["schedule", "_day"], "left")
    ahead = Window.partitionBy("schedule").orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    later = later.withColumn("_after", F.min(F.element_at("_opens", 1)).over(ahead))
    out = hit.join(later, ["schedule", "_day"], "left")
    today = F.array_min(F.filter("_opens", lambda o: o >= F.col(time)))
    is_open = F.col("until").isNotNull()
    return out.select(*probes.columns, is_open.alias("open"), "until", F.when(~is_open, F.coalesce(today, "_after")).alias("opens_at"))


def release_at_fire(items: DataFrame, fires: DataFrame, start_ms: int) -> DataFrame:
    """C10. The fire that releases each ready item: the first at or after it is ready and after the run's start.

    Items meet the fires of their own day by equality; where that day has none later, the next day's first fire takes
    its place, found over the few days of a schedule.
    """
    f = fires.where(F.col("fire_ms") > start_ms).withColumn("_day", F.floor(F.col("fire_ms") / DAY))
    by_day = f.groupBy("schedule", "_day").agg(F.array_sort(F.collect_set("fire_ms")).alias("_fires"))
    i = items.withColumn("_day", F.floor(F.col("ready_ms") / DAY))
    days = i.select("schedule", "_day").distinct().unionByName(by_day.select("schedule", "_day")).distinct().join(by_day, ["schedule", "_day"], "left")
    ahead = Window.partitionBy("schedule").orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    days = days.withColumn("_after", F.min(F.element_at("_fires", 1)).over(ahead))
    out = i.join(days, ["schedule", "_day"], "left")
    return out.select(*items.columns, F.coalesce(F.array_min(F.filter("_fires", lambda x: x >= F.col("ready_ms"))), "_after").alias("fire_ms"))


def window_crossings(transfers: DataFrame, windows: DataFrame, on_close: str = "pauseResume") -> DataFrame:
    """C11. Transfers (schedule, start_ms, end_ms, resumes) in flight at a close, and the state they go to.

    With pauseResume a transfer pauses (ready) when every destination can resume; else it finishes. Each transfer and
    close meet on the days that the transfer touches; its first close counts.
    """
    closes = windows.select("schedule", "close_ms", F.floor(F.col("close_ms") / DAY).alias("_day")).distinct()
    t = transfers.withColumn("_id", F.monotonically_increasing_id()).withColumn("_day", _days(F.col("start_ms"), F.col("end_ms")))
    j = t.join(closes, ["schedule", "_day"]).where("start_ms < close_ms and end_ms > close_ms")
    g = j.groupBy("_id", *transfers.columns).agg(F.min("close_ms").alias("close_ms")).drop("_id")
    pause = F.lit(on_close == "pauseResume") & F.col("resumes")
    return g.withColumn("action", F.when(pause, "pause").otherwise("finish")).withColumn("state", F.when(pause, "ready").otherwise("in_progress"))


def admission(items: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """H4. all, none or windowed (with its close) for each item.

    ``states``(instance, mode, active, fired, open, until). An inactive instance admits nothing, a forced pass everything
    else.
    """
    j = items.join(states, "instance", "left")
    gate = F.when(~F.coalesce("active", F.lit(True)), "none").when(F.lit(force), "all").when(F.col("mode") == "cron", F.when(F.coalesce("fired", F.lit(False)), "all").otherwise("none")).when(F.col("mode") == "window", F.when(F.coalesce("open", F.lit(False)), "windowed").otherwise("none")).otherwise("all")
    return j.withColumn("admission", gate).select(*items.columns, "admission", F.when(F.col("admission") == "windowed", F.col("until")).alias("close_ms"))


def invalid_schedules(schedules: DataFrame, fires: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """H5. Schedules that can't work, with the reason. ``fires`` is H1 over nine years, which holds every leap day."""
    fired = fires.select("schedule", F.lit(True).alias("_fires")).distinct()
    j = schedules.join(fired, "schedule", "left")
    both = F.col("has_close") & F.col("duration_ms").isNotNull()
    neither = ~F.col("has_close") & F.col("duration_ms").isNull()
    known = F.col("tz").isin(*zones) if zones else F.lit(True)
    why = F.when(~known, "unknown zone").when((F.col("mode") == "window") & both, "both close and duration").when((F.col("mode") == "window") & neither, "neither close nor duration").when(F.col("duration_ms") <= 0, "zero duration").when(F.col("_fires").isNull(), "never fires")
    return j.select("schedule", why.alias("reason")).where("reason is not null")


def schedule_transitions(decisions: DataFrame, scratch: Scratch | None = None, blocks: int | None = None) -> DataFrame:
    """E16. opened, closed and triggered edges of (instance, ts, seq, kind): kind is windowed, triggered, or anything else.
    Decisions of one instant go in order of ``seq``. The window's state is carried over ranges of an instance's decisions."""
    # a trigger leaves the window flag alone, so the state before is the last other decision
    is_open = F.when(F.col("kind") != "triggered", F.col("kind") == "windowed")
    known = last_before(decisions, ["instance"], ["ts", "seq"], is_open, scratch or Scratch(decisions.sparkSession, "transitions"), "_open", blocks)
    before = F.coalesce("_open", F.lit(False))
    edge = F.when(F.col("kind") == "triggered", "triggered").when((F.col("kind") == "windowed") & ~before, "opened").when((F.col("kind") != "windowed") & before, "closed")
    return known.withColumn("edge", edge).where("edge is not null").drop("_open")
