"""Readiness by stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("instance", "relpath")


def ready_by_stability(observations: DataFrame, quiet_ms: int = 5_000) -> DataFrame:
    """E1. Adds ``since`` (when the file got its present size and time) and ``ready``.

    Ready when size and time have stood for ``quiet_ms`` or longer; the observation that starts a stand is never ready,
    unless no quiet time is asked for and it is the first of its path.
    """
    w = Window.partitionBy(*KEY).orderBy("observed_ms", "seq")
    seen = F.struct("size", "mtime_ms")
    o = observations.withColumn("_first", F.row_number().over(w) == 1).withColumn("_new", ~seen.eqNullSafe(F.lag(seen).over(w)) | F.col("_first"))
    o = o.withColumn("_stand", F.sum(F.col("_new").cast("int")).over(w))
    o = o.withColumn("since", F.min("observed_ms").over(Window.partitionBy(*KEY, "_stand")))
    ok = F.when(F.col("_new"), F.col("_first") & F.lit(quiet_ms == 0)).otherwise(F.col("observed_ms") - F.col("since") >= quiet_ms)
    return o.withColumn("ready", ok).drop("_first", "_new", "_stand")


def latest_stands(observations: DataFrame) -> DataFrame:
    """The stand each path is in after its last observation: (instance, relpath, since)."""
    got = ready_by_stability(observations)
    return got.groupBy(*KEY).agg(F.max_by("since", F.struct("observed_ms", "seq")).alias("since"))


def pending_recheck(observations: DataFrame, now_ms: int, quiet_ms: int = 5_000) -> DataFrame:
    """D10. Per instance, in how many milliseconds the first unsettled file can become ready."""
    at = F.col("since") + quiet_ms
    return latest_stands(observations).where(at > now_ms).groupBy("instance").agg((F.min(at) - now_ms).alias("recheck_in_ms"))
