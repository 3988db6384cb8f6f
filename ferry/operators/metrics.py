"""Metric groups: windows of 60 seconds, bounded dimensions, sums that combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL_MS = 60_000


def interval(ms: Column, width: int = INTERVAL_MS) -> Column:
    """Start of the interval that holds an instant."""
    return F.floor(ms / width).cast("long") * width


def _grouped(df: DataFrame, keys: list, aggs: list[Column]) -> DataFrame:
    """Aggregates by interval and keys; of a stream, whose event time is ``_ts``, over its event-time windows."""
    if not df.isStreaming:
        return df.groupBy(interval(F.col("ts_ms")).alias("interval_ms"), *keys).agg(*aggs)
    got = df.groupBy(F.window("_ts", f"{INTERVAL_MS} milliseconds"), *keys).agg(*aggs)
    return got.select(F.unix_millis("window.start").alias("interval_ms"), *[c for c in got.columns if c != "window"])


def scan_report(listing: DataFrame, issues: DataFrame) -> DataFrame:
    """D9. discovered, ready, ignored, errors and permission_denied by instance and strategy.

    ``listing``(instance, strategy, ready, ignored), ``issues``(instance, strategy, kind).
    """
    a = listing.groupBy("instance", "strategy").agg(F.count("*").alias("discovered"), F.count_if("ready").alias("ready"), F.count_if("ignored").alias("ignored"))
    b = issues.groupBy("instance", "strategy").agg(F.count("*").alias("errors"), F.count_if(F.col("kind") == "PermissionDenied").alias("permission_denied"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("discovered", "ready", "ignored", "errors", "permission_denied")]
    return a.join(b, ["instance", "strategy"], "full_outer").select("instance", "strategy", *zero)


def metrics_discovery(scans: DataFrame) -> DataFrame:
    """D11. Scans (instance, strategy, ts_ms, duration_ms, discovered, ready, ignored, errors, denied) by interval."""
    sums = [F.sum(c).alias(c) for c in ("duration_ms", "discovered", "ready", "ignored", "errors", "denied")]
    return _grouped(scans, ["instance", "strategy"], [F.count("*").alias("scans"), *sums])


def metrics_queue(ledger: DataFrame, now_ms: int) -> DataFrame:
    """D12. Depths by state, age of the oldest queued item, bytes queued, backlog and active workers by instance."""
    ready = F.col("state") == "ready"

    def depth(s):
        return F.count_if(F.col("state") == s)

    age = F.coalesce(F.max(F.when(ready, F.greatest(F.lit(0), now_ms - F.col("discovered_at")))), F.lit(0))
    return ledger.groupBy("instance").agg(
        depth("ready").alias("ready"), depth("in_progress").alias("in_progress"), depth("failed").alias("failed"), depth("exhausted").alias("exhausted"), age.alias("oldest_age_ms"),
        F.coalesce(F.sum(F.when(ready, F.col("size"))), F.lit(0)).alias("bytes_queued"), depth("failed").alias("retry_backlog"), depth("in_progress").alias("active_workers"),
    )


def metrics_transfer(attempts: DataFrame) -> DataFrame:
    """D13. Attempts (instance, dest_type, ts_ms, result, bytes, duration_ms, retry, resumed, item_level) by interval.

    ``peak_bytes_per_sec`` is the most of any attempt, each its bytes by its seconds and its bytes where it took no time. Rows
    about a whole item of an instance with several destinations have the type ``multi``.
    """
    several = F.col("item_level") & (F.col("dest_count") > 1)
    kind = F.when(several, "multi").otherwise(F.col("dest_type")).alias("destination_type")
    good = F.col("result") == "replicated"
    rate = F.when(good, F.when(F.col("duration_ms") > 0, F.col("bytes") * 1000 / F.col("duration_ms")).otherwise(F.col("bytes").cast("double")))
    return _grouped(attempts, ["instance", kind, "result"], [
        F.count("*").alias("files"), F.sum(F.when(good, F.col("bytes")).otherwise(0)).alias("bytes_replicated"), F.sum("duration_ms").alias("duration_ms"), F.max(rate).alias("peak_bytes_per_sec"),
        F.count_if("retry").alias("retries"), F.count_if(F.col("result") == "verification-failed").alias("verification_failures"), F.count_if("resumed").alias("resume_recoveries"),
    ])


def metrics_destination(links: DataFrame) -> DataFrame:
    """D14. Last link state, failures by bucket, throttle delay and limit by interval, instance and destination type."""
    def bucket(name):
        return F.count_if(F.col("bucket") == name)

    return _grouped(links, ["instance", "dest_type"], [
        F.max_by("link", F.struct("ts_ms", "seq")).alias("link_connected"), bucket("connectFailures").alias("connect_failures"), bucket("authFailures").alias("auth_failures"),
        bucket("writeFailures").alias("write_failures"), F.sum("throttle_ms").alias("throttle_delay_ms"), F.max("limit_bps").alias("limit_bytes_per_sec"),
    ])


def metrics_schedule(decisions: DataFrame) -> DataFrame:
    """D15. Decisions (instance, mode, ts_ms, active, open, triggered, admitted, backlog, released) by interval."""
    none = ~F.col("admitted")
    return _grouped(decisions, ["instance", "mode"], [
        F.max(F.col("active").cast("int")).alias("active"), F.count_if("open").alias("window_open"), F.count_if("triggered").alias("triggers"), F.count_if(none).alias("skipped"),
        F.count_if(none & (F.col("backlog") > 0)).alias("blocked"), F.sum("released").alias("released"),
    ])


TOTALS = ("replicated", "bytes", "failed")


def compat_deltas(results: DataFrame) -> DataFrame:
    """Replicated and failed items and bytes by interval and instance."""
    good = F.col("result") == "replicated"
    aggs = [F.count_if(good).alias("replicated_delta"), F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes_delta"), F.count_if(F.col("result") == "failed").alias("failed_delta")]
    return _grouped(results, ["instance"], aggs).select("instance", "interval_ms", *[f"{c}_delta" for c in TOTALS])


def metrics_compat(results: DataFrame) -> DataFrame:
    """D16. Deltas of each interval and running totals beside them. The window runs over intervals, not rows."""
    d = compat_deltas(results)
    w = Window.partitionBy("instance").orderBy("interval_ms").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("*", *[F.sum(f"{c}_delta").over(w).alias(f"{c}_total") for c in TOTALS])
