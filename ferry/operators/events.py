"""Events: what they are on the wire, and deriving them from the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"replication-failed": "warning", "retries-exhausted": "critical", "file-quarantined": "critical", "disconnected": "critical", "reconnected": "critical", "permission-denied": "critical", "file-discovered": "debug"}
#: Field that becomes the message, by type.
MESSAGE = {"replication-failed": "error", "retries-exhausted": "lastError", "file-quarantined": "lastError", "permission-denied": "error"}


def enrich_events(events: DataFrame, fields: list[str]) -> DataFrame:
    """L1. Adds severity, wire type, message, alarm and the context document to (event, ..., fields).

    The error text is promoted to the message and left out of the context; null fields are left out too. A
    ``next_attempt_at`` in milliseconds goes in as RFC 3339. A link that is down or up again shares one type.
    """
    e = F.col("event")

    def pick(table, other):
        out = other
        for k, v in table.items():
            out = F.when(e == k, v).otherwise(out)
        return out

    message = pick({k: F.col("error" if v == "error" else "last_error") for k, v in MESSAGE.items()}, F.lit(None).cast("string"))
    shown = [F.col(c) for c in fields if c not in ("error", "last_error", "next_attempt_at")]
    if "next_attempt_at" in fields:
        shown.append(F.date_format(F.timestamp_millis("next_attempt_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("nextAttemptAt"))
    return events.select(
        "*", pick(SEVERITY, F.lit("info")).alias("severity"), F.when(e == "reconnected", "disconnected").otherwise(e).alias("type"), message.alias("message"),
        F.when(e == "disconnected", True).when(e == "reconnected", False).alias("alarm"), F.to_json(F.struct(*shown)).alias("context"),
    )


def lifecycle_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """L2. Events that follow from two snapshots of the ledger (instance, relpath, state, attempts, action)."""
    b = before.select("instance", "relpath", F.col("state").alias("_from"), F.col("attempts").alias("_had"))
    j = after.join(b, ["instance", "relpath"], "left")
    old, new = F.coalesce("_from", F.lit("-")), F.col("state")
    moved = old != new

    def ev(cond, name):
        return F.when(cond, F.lit(name))

    done = moved & (new == "completed")
    many = F.array(
        ev(old == "-", "file-discovered"), ev(moved & (new == "ready"), "file-ready"), ev(moved & (new == "in_progress"), "replication-started"),
        ev(done | (moved & (new == "verified") & (old != "completed")), "replication-completed"), ev((new == "failed") & (moved | (F.col("attempts") > F.coalesce("_had", F.lit(0)))), "replication-failed"),
        ev(moved & new.isin("exhausted", "quarantined", "retained") & (old != "exhausted"), "retries-exhausted"), ev(done & (F.col("action") == "archive"), "file-archived"), ev(done & (F.col("action") == "delete"), "file-deleted"),
        ev(moved & (new == "quarantined"), "file-quarantined"),
    )
    return j.select("instance", "relpath", F.explode(F.array_compact(many)).alias("event"))


def scan_complete(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """L2. The event at a scan's end: files seen and files waiting, by instance."""
    seen = manifest.groupBy("instance").agg(F.count("*").alias("discovered"))
    wait = ledger.where("state in ('ready', 'failed')").groupBy("instance").agg(F.count("*").alias("awaiting"))
    return seen.join(wait, "instance", "left").select("instance", F.lit("scan-complete").alias("event"), "discovered", F.coalesce("awaiting", F.lit(0)).alias("awaiting"))
