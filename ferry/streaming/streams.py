"""The operators that make sense as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferry.operators import metrics
from ferry.streaming.stateful import QUEUED, behind_held, bucketed, event_timed, fresh, pack, queue_moves, running_totals, settle, stands


def stream_readiness(observations: DataFrame, quiet_ms: int = 5_000, evict_ms: int | None = None) -> DataFrame:
    """S1. E1 as a stream: observations that find their file settled. A path not seen for ``evict_ms`` of
    processing time is forgotten; leave that out for runs that end (a pending timeout keeps them going).

    What is held of a path is (size, mtime, since, seen), a bucket of paths at a time. A batch's rows of a path are taken in
    order of time.
    """

    def run(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, now = state.get[0] if state.exists else None, state.getCurrentProcessingTimeMs()
        held = fresh(held, now, evict_ms)
        if state.hasTimedOut:
            settle(state, held, evict_ms)
            return
        got = pd.concat(list(frames)).sort_values(["observed_ms", "seq"], kind="stable").assign(since=lambda x: x["observed_ms"], seen=now)
        both, first, last = behind_held(held, got, {"size": "size", "mtime_ms": "mtime_ms", "since": "since", "seen": "seen"})
        place, at, begins = both["_row"].to_numpy(), both["since"].to_numpy(dtype=np.int64), stands(both, first)
        begin = np.flatnonzero(begins)
        since = np.repeat(at[begin], np.diff(np.r_[begin, len(both)]))
        settle(state, pack(both.assign(since=since)[last].drop(columns="_row")), evict_ms)
        ready = np.where(begins, first & (quiet_ms == 0), at - since >= quiet_ms)
        yield got[columns].iloc[np.sort(place[ready & (place >= 0)])]

    columns = observations.columns
    return bucketed(observations).applyInPandasWithState(run, observations.schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout if evict_ms else GroupStateTimeout.NoTimeout)


def stream_ledger(log: DataFrame) -> DataFrame:
    """S2. D1 as a stream (update mode): the last row of each item so far."""
    rest = [c for c in log.columns if c not in ("instance", "relpath")]
    last = log.groupBy("instance", "relpath").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_r"))
    return last.select("instance", "relpath", *[F.col(f"_r.{c}").alias(c) for c in rest])


def stream_metrics(events: DataFrame, late: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """S3. Transfer counts by tumbling interval and instance (append mode); later rows than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "instance", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return w.select(F.unix_millis("window.start").alias("interval_ms"), "instance", "kind", "n", "bytes")


GROUPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "discovery": metrics.metrics_discovery,
    "transfer": metrics.metrics_transfer,
    "destination": metrics.metrics_destination,
    "schedule": metrics.metrics_schedule,
    "compat": metrics.compat_deltas,
}


def stream_group(rows: DataFrame, group: str, late: str = "10 minutes") -> DataFrame:
    """S3. A metric group of D11 and D13 to D16 over a stream with ``ts_ms``, in append mode: an interval is given out once,
    when the watermark has passed it, and rows that are later than that are dropped.

    The groups are those of the batch operators. ``destination`` keeps the last link state of each interval by time, whatever
    the order of arrival; ``compat`` chains the running totals to the closed intervals, with a row of sums as the state of an
    instance. Neither holds more than its open intervals beside that.
    """
    if group not in GROUPS:
        raise ValueError(f"unknown group {group}: {sorted(GROUPS)}")
    got = GROUPS[group](event_timed(rows, "ts_ms", late))
    if group != "compat":
        return got
    return running_totals(got, ["instance"], "interval_ms", {f"{c}_total": f"{c}_delta" for c in metrics.TOTALS})


def stream_queue(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """S3. D12 as a stream of the ledger's log (instance, relpath, state, size, ts_ms, seq): depths by state, bytes queued,
    retry backlog and active workers of each instance at the end of every interval in which they changed.

    Three stateful steps: an item's last state turns its log into what it adds and takes, intervals sum that up, and running
    totals make gauges of the sums. The age of the oldest item is left to the batch operator: it cannot be kept by sums.
    """
    moves = queue_moves(log, late)
    sums = moves.groupBy(F.window("moved_at", f"{metrics.INTERVAL_MS} milliseconds"), "instance").agg(*[F.sum(c).alias(c) for c in moves.columns if c not in ("instance", "moved_at")])
    sums = sums.select("instance", F.unix_millis("window.start").alias("interval_ms"), *[f"d_{s}" for s in QUEUED], "d_bytes")
    got = running_totals(sums, ["instance"], "interval_ms", {**{s: f"d_{s}" for s in QUEUED}, "bytes_queued": "d_bytes"})
    return got.select("instance", "interval_ms", *QUEUED, "bytes_queued", F.col("failed").alias("retry_backlog"), F.col("in_progress").alias("active_workers"))


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], done: Callable[[str, int], bool], mark: Callable[[str, int], None], checkpoint: str):
    """A6, S5. One input to many sinks, each tracked on its own.

    A sink gets ``(rows, batch_id)``. ``done(sink, batch_id)`` says whether it has that batch already and ``mark`` records
    it, so a batch that comes again after a failure goes only where it is missing. The rows are kept while they are
    written; when a sink fails the others still get theirs and the batch fails in the end.
    """

    def one(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        failed = None
        try:
            for name, write in sinks.items():
                if done(name, batch_id):
                    continue
                try:
                    write(rows, batch_id)
                    mark(name, batch_id)
                except Exception as e:  # noqa: BLE001
                    failed = failed or e
        finally:
            rows.unpersist()
        if failed:
            raise failed

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out_to_folders(stream: DataFrame, folders: dict[str, str], checkpoint: str):
    """S5. :func:`fan_out` to Parquet folders. A batch goes to a sub-folder of its own, written by overwrite, and its
    ``_SUCCESS`` file is the record that it is there: exactly once per sink."""
    jvm, conf = stream.sparkSession.sparkContext._jvm, stream.sparkSession.sparkContext._jsc.hadoopConfiguration()

    def there(name: str, batch: int) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{folders[name]}/batch={batch}/_SUCCESS")
        return path.getFileSystem(conf).exists(path)

    def sink(name: str) -> Callable[[DataFrame, int], None]:
        return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folders[name]}/batch={batch}")

    return fan_out(stream, {n: sink(n) for n in folders}, there, lambda *_: None, checkpoint)
