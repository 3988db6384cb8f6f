"""Classification of failures, retry decisions, fan-out roll-up and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.functions.keys import dest_key
from ferry.operators.policy import BASE_MS, GIVE_UP_MS, MAX_MS

KEY = ["instance", "relpath"]

# Error codes by destination kind, as each service names them.
S3_PERMANENT = (
    "NoSuchBucket", "NoSuchKey", "AccessDenied", "AccessDeniedException", "AllAccessDisabled", "InvalidAccessKeyId", "SignatureDoesNotMatch", "InvalidRequest",
    "InvalidArgument", "InvalidBucketName", "EntityTooLarge", "EntityTooSmall", "MethodNotAllowed", "PreconditionFailed", "KMS.DisabledException", "KMSInvalidStateException",
)
S3_TRANSIENT = (
    "SlowDown", "RequestTimeout", "RequestTimeTooSkewed", "Throttling", "ThrottlingException", "RequestLimitExceeded", "TooManyRequests", "ServiceUnavailable",
    "InternalError", "BadDigest", "XAmzContentChecksumMismatch", "XAmzContentSHA256Mismatch",
)
FTPS_PERMANENT = (530, 532, 550, 551, 552, 553)
SFTP_PERMANENT = ("auth", "host_key_mismatch", "no_such_file", "bad_message", "op_unsupported")
# Words of a message about failed authentication.
AUTH_NEEDLES = ("accessdenied", "access denied", "invalidaccesskeyid", "signaturedoesnotmatch", "signature mismatch", "auth", "authentication", "unauthorized", "forbidden", "401", "403")


def error_class(kind: Column, code: Column, status: Column, transport: Column) -> Column:
    """B9. permanent, transient, permission or integrity, by destination kind; the first rule that holds."""
    http = F.when(transport, "transient").when((status >= 500) | status.isin(429, 408), "transient").when(status >= 400, "permanent").otherwise("transient")
    s3 = (
        F.when(transport, "transient").when(code.isin(*S3_PERMANENT), "permanent").when(code.isin(*S3_TRANSIENT), "transient")
        .when((status >= 500) | (status == 429), "transient").when(status >= 400, "permanent").when(code.isNotNull(), "permanent").otherwise("transient")
    )
    ftps = F.when(transport, "transient").when(status.isin(*FTPS_PERMANENT), "permanent").otherwise("transient")
    sftp = F.when(transport, "transient").when(code == "permission_denied", "permission").when(code.isin(*SFTP_PERMANENT), "permanent").otherwise("transient")
    local = F.when(code == "PermissionDenied", "permission").when(code == "NotFound", "permanent").otherwise("transient")
    return (
        F.when(code == "integrity", "integrity").when(kind.isin("http", "gcs", "azure"), http).when(kind == "s3", s3).when(kind == "ftps", ftps).when(kind == "sftp", sftp).otherwise(local)
    )


def classify_errors(attempts: DataFrame) -> DataFrame:
    """B9. Adds ``error_class`` and ``permanent`` to failed attempts (kind, code, status, transport)."""
    out = attempts.withColumn("error_class", error_class(F.col("kind"), F.col("code"), F.col("status"), F.coalesce("transport", F.lit(False))))
    return out.withColumn("permanent", F.col("error_class").isin("permanent", "permission"))


def failure_bucket(message: Column, cls: Column) -> Column:
    """B10. authFailures, connectFailures or writeFailures."""
    auth = F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(AUTH_NEEDLES)) | (cls == "permission")
    return F.when(auth, "authFailures").when(cls.isin("transient", "integrity"), "connectFailures").otherwise("writeFailures")


def backoff_cap(attempts: Column, base_ms: Column, max_ms: Column) -> Column:
    """E6. Upper bound of the delay after the n-th failure. Decimal arithmetic, so that the doubling can't overflow."""
    shift = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(32)).cast("int")
    grown = base_ms.cast("decimal(20,0)") * F.element_at(F.array(*[F.lit(1 << k) for k in range(33)]), shift + 1).cast("decimal(12,0)")
    return F.greatest(F.lit(1), F.least(grown, max_ms.cast("decimal(33,0)"))).cast("long")


def backoff(attempts: Column, base_ms: Column, max_ms: Column, *key: str, seed: int = 0) -> Column:
    """E6. The delay: spread evenly over 0 to the cap by a hash of the key, so that a rerun decides alike."""
    return F.pmod(F.xxhash64(*key, attempts, F.lit(seed)), backoff_cap(attempts, base_ms, max_ms) + 1)


def retry_decision(attempts: DataFrame, policies: DataFrame, now_ms: int) -> DataFrame:
    """E5. give_up or retry for each failed attempt, with the reason, the new count and the cap of the delay.

    Attempts are counted per destination, the time budget runs from the file's discovery. ``policies`` has (instance,
    base_ms, max_ms, max_attempts, give_up_after_ms), resolved; an instance without a row takes the built-in values, which
    set no limit to attempts.
    """
    held = policies.select("instance", *[F.col(c).alias(f"_{c}") for c in ("base_ms", "max_ms", "max_attempts", "give_up_after_ms")])
    a = attempts.join(held, "instance", "left")
    base, most, age = F.coalesce("_base_ms", F.lit(BASE_MS)), F.coalesce("_max_ms", F.lit(MAX_MS)), F.coalesce("_give_up_after_ms", F.lit(GIVE_UP_MS))
    n = F.col("attempts") + 1
    reason = F.when(F.col("permanent"), "permanent").when(n >= F.col("_max_attempts"), "max_attempts").when(now_ms - F.col("discovered_at") >= age, "too_old")
    cap = backoff_cap(n, base, most)
    wait = backoff(n, base, most, *KEY, "dest")
    out = a.select(*attempts.columns, n.alias("new_attempts"), reason.alias("reason"), cap.alias("_cap"), wait.alias("_wait"))
    go = F.col("reason").isNull()
    return out.withColumn("decision", F.when(go, "retry").otherwise("give_up")).withColumn("delay_cap_ms", F.when(go, F.col("_cap"))).withColumn("next_attempt_at", F.when(go, now_ms + F.col("_wait"))).drop("_cap", "_wait")


def pending_dests(items: DataFrame, egress: DataFrame, dest_states: DataFrame, now_ms: int) -> DataFrame:
    """C13. Every configured destination of each item: verified, exhausted, due, or not due yet. A destination without a
    row is pending with no attempts."""
    d = items.select(*KEY).join(egress.select("instance", "dest"), "instance").join(dest_states, [*KEY, "dest"], "left")
    d = d.withColumn("phase", F.coalesce("phase", F.lit("pending"))).withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("next_attempt_at", F.coalesce("next_attempt_at", F.lit(0)))
    return d.withColumn("standing", F.when(F.col("phase") != "pending", F.col("phase")).when(F.col("next_attempt_at") <= now_ms, "due").otherwise("not_due"))


def rollup_items(items: DataFrame, egress: DataFrame, dest_states: DataFrame) -> DataFrame:
    """D8. State of each item (instance, relpath, attempts) from all its configured destinations.

    ``egress``(instance, dest) are the destinations; ``dest_states`` has (instance, relpath, dest, phase, attempts,
    next_attempt_at, last_error). A destination without a row is pending and due at once, so an item is verified only when
    every configured destination is; rows of destinations that are not configured don't count. Exhausted when any is, with
    their errors joined and the most attempts; else failed, one attempt more, gated at the earliest gate of what is
    pending, with the error of the greatest label that has one. An item of an instance without destinations is failed.
    """
    had = items.select(*KEY, F.col("attempts").alias("item_attempts")).join(egress.select("instance", "dest").distinct(), "instance", "left")
    d = dest_states.select(*KEY, "dest", "phase", "attempts", "next_attempt_at", "last_error")
    dest_rows = had.join(d, [*KEY, "dest"], "left").withColumn("phase", F.coalesce("phase", F.lit("pending"))).withColumn("next_attempt_at", F.coalesce("next_attempt_at", F.lit(0)))
    out = F.col("phase") == "exhausted"
    pend = F.col("phase") == "pending"
    g = dest_rows.groupBy(*KEY).agg(
        F.bool_and(F.col("phase") == "verified").alias("_all"), F.bool_or(out).alias("_out"),
        F.max(F.when(out, F.col("attempts"))).alias("_most"), F.max("item_attempts").alias("_had"), F.min(F.when(pend, F.col("next_attempt_at"))).alias("_gate"),
        F.array_join(F.array_sort(F.collect_list(F.when(out, F.concat("dest", F.lit(": "), F.coalesce("last_error", F.lit("")))))), "; ").alias("_errors"),
        F.max_by("last_error", F.when(pend & F.col("last_error").isNotNull(), F.col("dest"))).alias("_one"),
    )
    state = F.when(F.col("_out"), "exhausted").when(F.col("_all"), "verified").otherwise("failed")
    failed = ~F.col("_out") & ~F.col("_all")
    return g.select(*KEY, state.alias("state"), F.when(F.col("_out"), F.col("_most")).when(failed, F.col("_had") + 1).otherwise(F.col("_had")).alias("attempts"), F.when(failed, F.col("_gate")).otherwise(0).alias("next_attempt_at"), F.when(F.col("_out"), F.col("_errors")).when(failed, F.col("_one")).alias("last_error"))


def completion_plan(items: DataFrame, policies: DataFrame) -> DataFrame:
    """E7. What happens to the source of each verified item; archiving without a folder leaves it in place."""
    p = items.where("state = 'verified'").join(policies.select("instance", "on_success", "archive_dir"), "instance", "left")
    keep = F.col("archive_dir").isNull() & (F.coalesce("on_success", F.lit("archive")) != "delete")
    action = F.when(F.col("on_success") == "delete", "delete").when(keep, "leave").otherwise("archive")
    return p.select(*items.columns, action.alias("action"), F.when(action == "archive", F.concat(F.regexp_replace("archive_dir", "/+$", ""), F.lit("/"), dest_key("", F.col("relpath")))).alias("target"))


def exhausted_plan(items: DataFrame, policies: DataFrame) -> DataFrame:
    """E8. Quarantine or retain each exhausted item: its terminal state and, with a folder, where it goes."""
    p = items.where("state = 'exhausted'").join(policies.select("instance", "on_exhausted", "failed_dir"), "instance", "left")
    q = F.col("on_exhausted") == "quarantine"
    target = F.when(q & F.col("failed_dir").isNotNull(), F.concat(F.regexp_replace("failed_dir", "/+$", ""), F.lit("/"), dest_key("", F.col("relpath"))))
    return p.select(*items.columns, F.when(q, "quarantined").otherwise("retained").alias("final_state"), target.alias("target"))


def cleanup_plan(items: DataFrame, dest_rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """E9. Transfers to abort: pending destinations of exhausted items that hold a checkpoint. Verified copies stay."""
    gone = items.where("state = 'exhausted'").select(*KEY)
    return dest_rows.where("phase = 'pending'").join(gone, KEY, "left_semi").join(checkpoints.select(*KEY, "dest"), [*KEY, "dest"], "left_semi")


def recovery_plan(ledger: DataFrame, egress: DataFrame, dest_states: DataFrame, checks: DataFrame) -> DataFrame:
    """E10. What a restart does with each unfinished item.

    ``checks``(instance, relpath, dest, ok) says which copies verify again. A verified item completes only if every
    configured destination (``egress``: instance, dest) verifies again, one without a row or a check included, and is ready
    otherwise. Items in progress are ready, after those of their destinations that were verified are checked. Exhausted
    ones finish. ``confirmed`` and ``demoted`` count the destinations that verify again and those that are pending again.
    Nothing is removed over a copy that is not verified.
    """
    todo = ledger.where(F.col("state").isin("verified", "in_progress", "exhausted")).select(*KEY, "state")
    due = todo.join(egress.select("instance", "dest").distinct(), "instance").join(dest_states.select(*KEY, "dest", "phase"), [*KEY, "dest"], "left").join(checks.select(*KEY, "dest", "ok"), [*KEY, "dest"], "left")
    due = due.where((F.col("state") == "verified") | ((F.col("state") == "in_progress") & (F.col("phase") == "verified")))
    ok = F.coalesce("ok", F.lit(False))
    got = due.groupBy(*KEY).agg(F.count_if(~ok).alias("demoted"), F.count_if(ok).alias("confirmed"))
    j = todo.join(got, KEY, "left").withColumn("demoted", F.coalesce("demoted", F.lit(0))).withColumn("confirmed", F.coalesce("confirmed", F.lit(0)))
    clean = (F.col("demoted") == 0) & (F.col("confirmed") > 0)
    action = F.when(F.col("state") == "exhausted", "finish").when((F.col("state") == "verified") & clean, "complete").otherwise("ready")
    return j.select(*KEY, "state", action.alias("action"), "demoted", "confirmed")
