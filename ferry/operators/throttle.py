"""Rate limits over tables of chunks, and filters whose decisions build on the last row kept."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.operators.ordered import running_sum, spaced
from ferry.plans.scratch import Scratch


def throttle_accounting(chunks: DataFrame, key: list[str], rate: Column | int, burst: Column | int, bucket_ms: int = 3_600_000, out: str = "wait_ms") -> DataFrame:
    """E12. The wait in milliseconds that each chunk owes under a token bucket with debt.

    ``chunks`` has the key, t_ms, seq and bytes; ``rate`` is in bytes per millisecond. With A the running sum of bytes the
    fill after chunk n is A_n - r t_n - min over k up to n of (A_(k-1) - r t_k), and the wait is what exceeds the burst.
    Both the sum and the minimum are carried over time buckets, so one key with all rows (the global limit) is spread:
    only a row per bucket meets in one place.
    """
    rate, burst = (F.lit(x) if isinstance(x, int) else x for x in (rate, burst))
    c = chunks.withColumn("_r", rate).withColumn("_cap", burst).withColumn("_b", F.floor(F.col("t_ms") / bucket_ms))
    inside = Window.partitionBy(*key, "_b").orderBy("t_ms", "seq")
    c = c.withColumn("_a", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_v", F.col("_a") - F.col("bytes") - F.col("_r") * F.col("t_ms"))
    c = c.withColumn("_m", F.min("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    past = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = c.groupBy(*key, "_b").agg(F.sum("bytes").alias("_sum"), F.min("_v").alias("_low"))
    per = per.withColumn("_off", F.coalesce(F.sum("_sum").over(past), F.lit(0)))
    per = per.withColumn("_before", F.min(F.col("_low") + F.col("_off")).over(past)).select(*key, "_b", "_off", "_before")
    j = c.join(per, [*key, "_b"])
    low = F.least(F.col("_m") + F.col("_off"), F.coalesce("_before", F.col("_m") + F.col("_off")))
    fill = F.col("_a") + F.col("_off") - F.col("_r") * F.col("t_ms") - low
    return j.withColumn(out, F.when(F.col("_r") > 0, F.greatest(F.lit(0), fill - F.col("_cap")) / F.col("_r")).otherwise(0.0)).select(*chunks.columns, out)


def effective_limit(own: Column, shared: Column) -> Column:
    """E13. The smaller of two limits of which 0 is none."""
    none = F.lit(None).cast("long")
    return F.coalesce(F.least(F.when(own != 0, own).otherwise(none), F.when(shared != 0, shared).otherwise(none)), F.lit(0))


def throttle_progress(ticks: DataFrame, step: int = 10, interval_ms: int = 5_000) -> DataFrame:
    """E14. Ticks worth reporting: the first at 0 %, any at 100 %, ``step`` points or ``interval_ms`` after the last one kept.

    ``ticks`` has (transfer, tick, percent, now_ms). Each decision builds on the last row kept, so a transfer's ticks are
    replayed in order in one task; a transfer has few.
    """
    step, interval_ms = max(1, step), max(0, interval_ms)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["now_ms", "tick"])
        last, at, keep = -1, 0, []
        for p, t in zip(pdf["percent"], pdf["now_ms"], strict=True):
            k = (last < 0 and p <= 0) or p >= 100 or p - last >= step or t - at >= interval_ms
            if k:
                last, at = p, t
            keep.append(bool(k))
        return pdf[keep]

    return ticks.groupBy("transfer").applyInPandas(run, ticks.schema)


def log_once(issues: DataFrame, relog_ms: int = 3_600_000, scratch: Scratch | None = None, blocks: int | None = None) -> DataFrame:
    """E15. Issues worth logging: the first sighting, then once every ``relog_ms`` while it lasts.

    ``issues`` has (instance, scope, kind, ts_ms, seq, recovered); scope is a path or a destination. A recovered row
    re-arms all kinds of its scope and is not logged. Islands between recoveries are a running sum, and within an island the
    logged rows are reached by pointers of at least ``relog_ms``; both go over ranges of the time, so that a scope, or an
    island, may hold all rows. Without a spacing every sighting is logged.
    """
    scratch = scratch or Scratch(issues.sparkSession, "log-once")
    told = running_sum(issues, ["instance", "scope"], ["ts_ms", "seq"], F.col("recovered").cast("int"), scratch, "_i", blocks)
    return spaced(told.where("not recovered"), ["instance", "scope", "kind", "_i"], "ts_ms", "seq", relog_ms, scratch, blocks).select(*issues.columns)
