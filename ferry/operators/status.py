"""Status documents of instances, devices and fleets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = 100


def percent(done: Column, size: Column) -> Column:
    """Percent with one decimal; an empty file is 0 until a byte landed."""
    p = F.round(done / size * 1000) / 10
    return F.when(size == 0, F.when(done == 0, 0.0).otherwise(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)))


def status_by_instance(ledger: DataFrame, stats: DataFrame, activation: DataFrame, now_ms: int, listed: int = LISTED) -> DataFrame:
    """D17. One nested document per instance. Lists hold the oldest ``listed`` items, counts are exact.

    Rows are ranked within instance and section first, so that no more than the listed ones are ever collected.
    """
    section = F.when(F.col("state").isin("ready"), "awaiting").when(F.col("state") == "in_progress", "in_progress").when(F.col("state").isin("failed", "exhausted", "quarantined"), "failed")
    rows = ledger.withColumn("section", section).where("section is not null")
    counts = rows.groupBy("instance").agg(F.count_if(F.col("section") == "awaiting").alias("awaiting_count"), F.coalesce(F.sum(F.when(F.col("section") == "awaiting", F.col("size"))), F.lit(0)).alias("awaiting_bytes"), F.count_if(F.col("section") == "failed").alias("failed_count"))
    w = Window.partitionBy("instance", "section").orderBy("discovered_at", "relpath")
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= listed)

    def items(name, *fields):
        one = F.when(F.col("section") == name, F.struct("_n", *fields))
        return F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("_n")).alias(name)

    path = F.col("relpath").alias("path")
    lists = top.groupBy("instance").agg(
        items("awaiting", path, "size", F.expr(f"greatest(0, ({now_ms} - discovered_at) div 1000)").alias("age_secs")),
        items("in_progress", path, "size", "bytes_done", percent(F.col("bytes_done"), F.col("size")).alias("percent"), (F.col("attempts") + 1).alias("attempt")),
        items("failed", path, "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"), "state", F.when(F.col("state") == "quarantined", F.col("updated_at")).alias("quarantined_at")),
    )
    j = activation.join(counts, "instance", "left").join(lists, "instance", "left").join(stats, "instance", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("awaiting_count", "awaiting_bytes", "failed_count", "replicated", "bytes")]
    j = j.select("instance", "active", *zero, "awaiting", "in_progress", "failed")
    return j.select("instance", "active", F.struct(F.col("awaiting_count").alias("count"), F.col("awaiting_bytes").alias("bytes"), F.col("awaiting").alias("files")).alias("awaiting"), "in_progress", F.struct(F.col("replicated").alias("count"), "bytes").alias("replicated"), F.struct(F.col("failed_count").alias("count"), F.col("failed").alias("items")).alias("failed"))


def status_roster(statuses: DataFrame, disabled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D18. (documents of live and disabled instances, summary by device)."""
    docs = statuses.withColumn("disabled", F.lit(False)).unionByName(disabled.withColumn("disabled", F.lit(True)), allowMissingColumns=True)
    summary = docs.groupBy("device").agg(F.count("*").alias("instances"), F.count_if(F.coalesce("active", F.lit(False)) & ~F.col("disabled")).alias("active"), F.count_if("disabled").alias("disabled"))
    return docs, summary


def fleet_rollup(statuses: DataFrame, by: list[str]) -> DataFrame:
    """D19. Totals over every prefix of the given tags, and of all."""
    return statuses.rollup(*by).agg(F.count("*").alias("instances"), F.sum("awaiting_count").alias("awaiting"), F.sum("failed_count").alias("failed"), F.sum("replicated").alias("replicated"), F.sum("bytes").alias("bytes"))


def _state_of(e: Column) -> Column:
    return (
        F.when(e == "replication-failed", "failed").when(e == "retries-exhausted", "exhausted").when(e.isin("replication-started", "replication-progress"), "in_progress").when(e == "replication-completed", "verified")
        .when(e == "file-quarantined", "quarantined").when(e.isin("file-archived", "file-deleted"), "completed").otherwise("ready")
    )


def view_from_events(events: DataFrame) -> DataFrame:
    """D20. State of each file and destination from the event stream alone: its last event by time."""
    last = events.groupBy("instance", "path", "dest").agg(F.max_by(F.struct("event", "percent", "bytes_done"), F.struct("ts", "seq")).alias("_r"))
    return last.select("instance", "path", "dest", _state_of(F.col("_r.event")).alias("state"), F.col("_r.percent").alias("percent"), F.col("_r.bytes_done").alias("bytes_done"))


def items_from_events(events: DataFrame, egress: DataFrame) -> DataFrame:
    """D20. State of each item (instance, relpath) from the event stream alone.

    ``events`` has (instance, path, dest, event, ts, seq), ``dest`` null in those about the whole item; ``egress``(instance,
    dest) are the configured destinations, others do not count. The last event about the item holds when no destination
    has one after it. Else the item is exhausted, in progress or failed when a destination is, in that order; verified when
    every configured destination is; and ready while there are some of which nothing was heard.
    """
    at = F.struct("ts", "seq")
    last = events.groupBy("instance", "path", "dest").agg(F.max_by("event", at).alias("event"), F.max(at).alias("_at"))
    asked = egress.select("instance", "dest").distinct()
    wanted = asked.groupBy("instance").agg(F.count("*").alias("_wanted"))
    l, a = last.alias("l"), asked.alias("a")
    known = l.join(a, (F.col("l.instance") == F.col("a.instance")) & (F.col("l.dest") == F.col("a.dest")), "left").where("l.dest is null or a.dest is not null").select("l.*")
    whole, state = F.col("dest").isNull(), _state_of(F.col("event"))
    g = known.groupBy("instance", "path").agg(
        F.max(F.when(whole, F.col("_at"))).alias("_own"), F.max(F.when(~whole, F.col("_at"))).alias("_each"), F.max_by(state, F.when(whole, F.col("_at"))).alias("_whole"),
        *[F.count_if(~whole & (state == s)).alias(f"_{s}") for s in ("exhausted", "in_progress", "failed", "verified")],
    )
    own = F.col("_own").isNotNull() & (F.col("_each").isNull() | (F.col("_own") > F.col("_each")))
    out = F.when(own, F.col("_whole")).when(F.col("_exhausted") > 0, "exhausted").when(F.col("_in_progress") > 0, "in_progress").when(F.col("_failed") > 0, "failed")
    return g.join(wanted, "instance", "left").select("instance", F.col("path").alias("relpath"), out.when(F.col("_verified") >= F.col("_wanted"), "verified").otherwise("ready").alias("state"))


#: What is counted of an instance, by state.
MEASURES = {"awaiting": ("ready",), "in_progress": ("in_progress",), "failed": ("failed", "exhausted", "quarantined"), "replicated": ("verified", "completed")}


def status_counts(items: DataFrame) -> DataFrame:
    """D17, D20. Items of each instance by section, of the ledger or of :func:`items_from_events`."""
    return items.groupBy("instance").agg(*[F.count_if(F.col("state").isin(*states)).alias(name) for name, states in MEASURES.items()])


def item_disagreements(by_events: DataFrame, by_ledger: DataFrame) -> DataFrame:
    """D20. Items whose state by the events is not that of the ledger, or that only one of them has: (instance, relpath,
    by_events, by_ledger)."""
    e, b = by_events.alias("e"), by_ledger.alias("b")
    j = e.join(b, F.col("e.instance").eqNullSafe(F.col("b.instance")) & F.col("e.relpath").eqNullSafe(F.col("b.relpath")), "full_outer")
    j = j.select(F.coalesce("e.instance", "b.instance").alias("instance"), F.coalesce("e.relpath", "b.relpath").alias("relpath"), F.col("e.state").alias("by_events"), F.col("b.state").alias("by_ledger"))
    return j.where(~F.col("by_events").eqNullSafe(F.col("by_ledger")))


def status_disagreements(by_events: DataFrame, by_ledger: DataFrame) -> DataFrame:
    """D20. Counts of :func:`status_counts` that differ: (instance, measure, by_events, by_ledger); an instance that only
    one side has counts as zero on the other."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return status_counts(df).unpivot(["instance"], list(MEASURES), "measure", name)

    e, b = long(by_events, "by_events").alias("e"), long(by_ledger, "by_ledger").alias("b")
    j = e.join(b, F.col("e.instance").eqNullSafe(F.col("b.instance")) & (F.col("e.measure") == F.col("b.measure")), "full_outer")
    j = j.select(F.coalesce("e.instance", "b.instance").alias("instance"), F.coalesce("e.measure", "b.measure").alias("measure"), F.coalesce("by_events", F.lit(0)).alias("by_events"), F.coalesce("by_ledger", F.lit(0)).alias("by_ledger"))
    return j.where("by_events <> by_ledger")
