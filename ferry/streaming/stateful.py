"""Streams whose state has timers and an end: arrivals, releases, log-once and progress filters, running totals.

Those with timers use ``transformWithState``, for which a query needs the RocksDB state store; :func:`rocksdb` sets it. A key's rows are
taken in order of time within a batch, and batches as they come; rows older than the watermark are dropped by Spark.

A call for a group of rows costs milliseconds, whatever it holds. Where keys are as many as files, the state is kept by buckets
of keys: the rows of a bucket and what is held of its keys, an Arrow table in one value, are taken together, column by column.
A batch reads and writes the buckets that its rows fall into. :data:`BUCKETS` stays the same for the life of a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def event_timed(df: DataFrame, ms: str, late: str) -> DataFrame:
    return df.withColumn("_ts", F.timestamp_millis(ms)).withWatermark("_ts", late)


def _in_order(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


BUCKETS = 1024
KEY = ["instance", "relpath"]


def bucketed(df: DataFrame):
    """Rows grouped by a hash of their key."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS))).groupBy("_bucket")


def pack(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(held: Any) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_pandas()


def behind_held(held: Any, got: pd.DataFrame, columns: dict[str, str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A bucket's rows, in the order they have, behind what is held of their keys: (rows, key by key, whether a row is the
    first of its key, whether it is the last). ``columns`` names the columns of a row as they are held; ``_row`` is the place
    of a row in ``got`` and -1 where it is held."""
    rows = got[[*KEY, *columns]].rename(columns=columns)
    rows["_row"] = np.arange(len(got))
    if held is not None:
        before = unpack(held)
        before["_row"] = -1
        rows = pd.concat([before, rows], ignore_index=True)
    key = rows.groupby(KEY, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key) + 1, dtype=bool)
    new[1:-1] = key[1:] != key[:-1]
    return rows.iloc[order].reset_index(drop=True), new[:-1], new[1:]


def stands(rows: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    """Whether a row begins a new stand of its file: the first of its key, or of another size or time than the one before."""
    size, mtime = (rows[c].to_numpy(dtype=np.int64) for c in ("size", "mtime_ms"))
    begins = first.copy()
    begins[1:] |= (size[1:] != size[:-1]) | (mtime[1:] != mtime[:-1])
    return begins


class _Release(StatefulProcessor):
    """State of a bucket: of each path (size, mtime, since, released, seen), and when its timer is due. The timer is set to
    the first end of a quiet time or eviction, or before it; when it comes, all that the clock has passed is done."""

    COLUMNS = ["instance", "relpath", "size", "mtime_ms", "since", "ready_ms"]
    HELD = [*KEY, "size", "mtime_ms", "since", "released", "seen"]

    def __init__(self, quiet_ms: int, evict_ms: int | None, clock: str) -> None:
        self.quiet, self.evict, self.event = quiet_ms, evict_ms, clock == "event"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "wake long, held binary")

    def _out(self, stood: pd.DataFrame) -> pd.DataFrame:
        return stood.assign(ready_ms=stood["since"] + self.quiet)[self.COLUMNS]

    def _update(self, held: pd.DataFrame, wake: int | None) -> None:
        if held.empty:
            self.state.clear()
            return
        due = held["since"].where(~held["released"]) + self.quiet
        if self.evict:
            due = due.fillna(held["seen"] + self.evict)
        if due.notna().any() and (wake is None or due.min() < wake):
            if wake is not None:
                self.handle.deleteTimer(wake)
            wake = int(due.min())
            self.handle.registerTimer(wake)
        self.state.update((wake, pack(held[self.HELD])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, "observed_ms", "seq")
        got["at"] = got["observed_ms"] if self.event else timerValues.getCurrentProcessingTimeInMs()
        wake, held = tuple(self.state.get()) if self.state.exists() else (None, None)
        new = got.assign(since=got["at"], released=False)
        both, first, last = behind_held(held, new, {"size": "size", "mtime_ms": "mtime_ms", "since": "since", "released": "released", "at": "seen"})
        at = both["seen"].to_numpy(dtype=np.int64)
        begin = np.flatnonzero(stands(both, first))
        # the last sight of a stand that is not its first, and the first sight of the next one
        again = at.copy()
        least = np.iinfo(np.int64).min
        again[begin] = least
        again = np.maximum.reduceat(again, begin)
        end = np.r_[begin[1:], len(both)] - 1
        after = np.where(last[end], least, at[np.minimum(end + 1, len(both) - 1)])
        stood = both.iloc[begin].assign(seen=at[end])
        # up to and with the end of the quiet time a change begins anew; after it the stand before was complete
        ready = stood["since"].to_numpy(dtype=np.int64) + self.quiet
        released = stood["released"].to_numpy(dtype=bool)
        now = ~released & ((again >= ready) | (after > ready))
        stood["released"] = released | now
        self._update(stood[last[end]], wake)
        yield self._out(stood[now])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            yield pd.DataFrame(columns=self.COLUMNS)
            return
        held = unpack(self.state.get()[1])
        now = timerValues.getCurrentWatermarkInMs() if self.event else timerValues.getCurrentProcessingTimeInMs()
        due = ~held["released"] & (held["since"] + self.quiet < now)
        held["released"] |= due
        gone = held["released"] & (held["seen"] + self.evict < now) if self.evict else held["released"] & False
        self._update(held[~gone], None)
        yield self._out(held[due])

    def close(self) -> None:
        pass


def stream_release(observations: DataFrame, quiet_ms: int = 5_000, evict_ms: int | None = None, clock: str = "event", late: str = "0 seconds") -> DataFrame:
    """S1, D10. Files as they become ready: (instance, relpath, size, mtime_ms, since, ready_ms), once for each size and time
    that stood for ``quiet_ms``, whether or not the file is observed again.

    A timer at the end of the quiet time releases the file when the watermark of ``observed_ms`` passes it, or with
    ``clock="processing"`` when the wall clock does, which then also gives the times. A released path that is not observed for
    ``evict_ms`` is forgotten; seen again it counts as new. State and timers are kept by buckets of paths.
    """
    keyed = observations.select("instance", "relpath", "size", "mtime_ms", "observed_ms", "seq")
    keyed = event_timed(keyed, "observed_ms", late) if clock == "event" else keyed
    mode = "EventTime" if clock == "event" else "ProcessingTime"
    return bucketed(keyed).transformWithStateInPandas(_Release(quiet_ms, evict_ms, clock), "instance string, relpath string, size long, mtime_ms long, since long, ready_ms long", "Append", mode)


def new_or_changed(listing: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A2. Of repeated listings (instance, relpath, size, mtime_ms, sweep, ...) the rows whose file is new or has changed
    since it was listed last. A path that no listing names for ``keep_ms`` is forgotten.

    Every file of every sweep passes here, so the state travels with the rows (``applyInPandasWithState``), a bucket of paths
    at a time.
    """
    columns = listing.columns

    def run(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, now = state.get[0] if state.exists else None, state.getCurrentProcessingTimeMs()
        held = fresh(held, now, keep_ms)
        if state.hasTimedOut:
            settle(state, held, keep_ms)
            return
        got = _in_order(frames, "sweep").assign(at=now)
        both, first, last = behind_held(held, got, {"size": "size", "mtime_ms": "mtime_ms", "at": "seen"})
        settle(state, pack(both[last].drop(columns="_row")), keep_ms)
        keep = both["_row"].to_numpy()[stands(both, first)]
        keep = keep[keep >= 0]
        if len(keep):
            yield got[columns].iloc[np.sort(keep)]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return bucketed(listing).applyInPandasWithState(run, listing.schema, "held binary", "append", timeout)


def fresh(held: Any, now: int, keep_ms: int | None) -> Any:
    """What is held of the paths that were seen in the last ``keep_ms``."""
    if held is None or not keep_ms:
        return held
    table = unpack(held)
    table = table[table["seen"] + keep_ms > now]
    return pack(table) if len(table) else None


def settle(state: GroupState, held: Any, keep_ms: int | None) -> None:
    """Keeps what is held of a bucket, and looks at it again after ``keep_ms`` without rows."""
    if held is None:
        if state.exists:
            state.remove()
        return
    state.update((held,))
    if keep_ms:
        state.setTimeoutDuration(keep_ms)


class _LogOnce(StatefulProcessor):
    """State of a scope: by kind, when it was last logged. It is dropped when it can no longer hold anything back."""

    def __init__(self, relog_ms: int, columns: list[str]) -> None:
        self.relog, self.columns = relog_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logged = handle.getMapState("logged", "kind string", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got, keep = _in_order(rows, "ts_ms", "seq"), []
        logged = {k[0]: v[0] for k, v in self.logged.iterator()} if self.logged.exists() else {}
        before = dict(logged)
        for kind, at, recovered in zip(got["kind"], got["ts_ms"], got["recovered"], strict=True):
            due = not recovered and (kind not in logged or at - logged[kind] >= self.relog)
            if recovered:
                logged.clear()
            elif due:
                logged[kind] = int(at)
            keep.append(due)
        for kind in before.keys() - logged.keys():
            self.logged.removeKey((kind,))
        for kind, at in logged.items():
            if before.get(kind) != at:
                self.logged.updateValue((kind,), (at,))
                self.handle.registerTimer(at + self.relog)
        yield got.loc[keep, self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.logged.exists():
            until = expiredTimerInfo.getExpiryTimeInMs() - self.relog
            for kind in [k for k, v in self.logged.iterator() if v[0] <= until]:
                self.logged.removeKey(kind)
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def stream_log_once(issues: DataFrame, relog_ms: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """S4. E15 as a stream: the first sighting of a kind in a scope, then once every ``relog_ms``; a recovery re-arms all.

    A kind's state goes ``relog_ms`` after it was logged, when the watermark is past: from then on any sighting is logged.
    """
    return event_timed(issues, "ts_ms", late).groupBy("instance", "scope").transformWithStateInPandas(_LogOnce(relog_ms, issues.columns), issues.schema, "Append", "EventTime")


class _Progress(StatefulProcessor):
    """State of a transfer: percent and time of the last tick kept. It is dropped when it can no longer hold a tick back."""

    def __init__(self, step: int, interval_ms: int, columns: list[str]) -> None:
        self.step, self.interval, self.columns = step, interval_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "percent long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got, keep = _in_order(rows, "now_ms", "tick"), []
        last, at = tuple(self.kept.get()) if self.kept.exists() else (-1, None)
        for p, t in zip(got["percent"], got["now_ms"], strict=True):
            due = last < 0 and p <= 0 or p >= 100 or p - last >= self.step or t - (at or 0) >= self.interval
            if due:
                last, at = int(p), int(t)
            keep.append(bool(due))
        if at is not None:
            self.kept.update((last, at))
            self.handle.registerTimer(at + self.interval)
        yield got.loc[keep, self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.kept.exists() and self.kept.get()[1] + self.interval <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def stream_progress(ticks: DataFrame, step: int = 10, interval_ms: int = 5_000, late: str = "0 seconds") -> DataFrame:
    """S4. E14 as a stream. A transfer's state goes ``interval_ms`` after its last tick kept: from then on any tick is kept
    for the time that has passed. ``now_ms`` counts from an epoch more than an interval ago."""
    return event_timed(ticks, "now_ms", late).groupBy("transfer").transformWithStateInPandas(_Progress(max(1, step), max(0, interval_ms), ticks.columns), ticks.schema, "Append", "EventTime")


class _Totals(StatefulProcessor):
    """State of a key: the running sums."""

    def __init__(self, order: str, deltas: list[str], totals: list[str], columns: list[str]) -> None:
        self.order, self.deltas, self.totals, self.columns = order, deltas, totals, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{t} long" for t in self.totals))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, self.order)
        before = tuple(self.sums.get()) if self.sums.exists() else (0,) * len(self.totals)
        for delta, total, old in zip(self.deltas, self.totals, before, strict=True):
            got[total] = got[delta].cumsum() + old
        self.sums.update(tuple(int(got[t].iloc[-1]) for t in self.totals))
        yield got[self.columns]

    def close(self) -> None:
        pass


def running_totals(windows: DataFrame, key: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Adds running totals ({total: delta}) of the rows of each key to a stream of closed windows, which come in order of
    time: the state is one row of sums a key, however long the stream."""
    schema = T.StructType([*windows.schema.fields, *[T.StructField(total, T.LongType()) for total in sums]])
    return windows.groupBy(*key).transformWithStateInPandas(_Totals(order, list(sums.values()), list(sums), schema.names), schema, "Append", "None")


QUEUED = ("ready", "in_progress", "failed", "exhausted")


class _Moves(StatefulProcessor):
    """State of a bucket: of each item its state and size as last logged."""

    COLUMNS = ["instance", "moved_at", *[f"d_{s}" for s in QUEUED], "d_bytes"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("bucket", "held binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, "ts_ms", "seq")
        held = self.last.get()[0] if self.last.exists() else None
        both, first, last = behind_held(held, got, {"state": "state", "size": "size"})
        self.last.update((pack(both[last].drop(columns="_row")),))
        place, size = both["_row"].to_numpy(), both["size"].to_numpy(dtype=np.int64)

        def before(x: np.ndarray, none: Any) -> np.ndarray:
            return np.where(first, none, np.roll(x, 1))

        state = pd.factorize(both["state"])[0]
        moved = (place >= 0) & ((state != before(state, -1)) | (size != before(size, 0)))
        out = {"instance": both["instance"], "moved_at": pd.to_datetime(got["ts_ms"].to_numpy()[place], unit="ms", utc=True)}
        for s in QUEUED:
            there = (both["state"] == s).to_numpy(dtype=np.int64)
            out[f"d_{s}"] = there - before(there, 0)
        queued = (both["state"] == "ready").to_numpy(dtype=np.int64) * size
        out["d_bytes"] = queued - before(queued, 0)
        yield pd.DataFrame(out)[moved][self.COLUMNS]

    def close(self) -> None:
        pass


def queue_moves(log: DataFrame, late: str) -> DataFrame:
    """What each change of an item adds to and takes from its instance's queue: (instance, moved_at, d_ready, ..., d_bytes)."""
    rows = event_timed(log.select("instance", "relpath", "state", "size", "ts_ms", "seq"), "ts_ms", late)
    schema = "instance string, moved_at timestamp, " + ", ".join(f"d_{s} long" for s in QUEUED) + ", d_bytes long"
    return bucketed(rows).transformWithStateInPandas(_Moves(), schema, "Append", "EventTime", eventTimeColumnName="moved_at")
