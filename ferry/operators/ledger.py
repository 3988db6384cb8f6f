"""The ledger of items: folding its logs, updating it from listings, claiming from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.operators.ordered import rank
from ferry.plans.scratch import Scratch

KEY = ["instance", "relpath"]
STATES = ("ready", "in_progress", "verified", "completed", "failed", "exhausted", "quarantined", "retained")
TERMINAL = ("completed", "quarantined", "retained")

#: Legal moves between item states; every state may stay as it is, and a changed file begins anew from a terminal one.
LEGAL = (
    ("ready", "in_progress"), ("in_progress", "verified"), ("in_progress", "failed"), ("in_progress", "exhausted"), ("in_progress", "ready"),
    ("verified", "completed"), ("verified", "ready"), ("failed", "ready"), ("exhausted", "quarantined"), ("exhausted", "retained"),
    ("completed", "ready"), ("quarantined", "ready"), ("retained", "ready"),
)


def checked_state(c):
    """The state, or an error for a token that is none."""
    return F.when(c.isin(*STATES) | c.isNull(), c).otherwise(F.raise_error(F.concat(F.lit("unknown item state: "), c)))


def _last(column: str, *order: str):
    return F.max_by(column, F.struct(*order))


def fold_ledger(log: DataFrame) -> DataFrame:
    """D1. Present state of each item from its log (instance, relpath, ts, seq, state, ...): the last row of each."""
    rest = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_r"))
    return last.select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fold_attempts(log: DataFrame) -> DataFrame:
    """D2. Attempt count, last error and phase of each destination from classified attempts.

    ``log`` has (instance, relpath, dest, now_ms, seq, outcome, error): outcome ok, failed, gave_up or progress.
    """
    end = F.col("outcome") != "progress"
    bad = F.col("outcome").isin("failed", "gave_up")
    order = F.struct("now_ms", "seq")
    g = log.groupBy(*KEY, "dest").agg(
        F.count_if(bad).alias("attempts"),
        F.max_by(F.when(bad, F.col("error")), F.when(bad, order)).alias("last_error"),
        F.max_by(F.when(bad, F.col("now_ms")), F.when(bad, order)).alias("last_failure_ms"),
        F.max_by(F.when(end, F.col("outcome")), F.when(end, order)).alias("_o"),
    )
    phase = F.when(F.col("_o") == "ok", "verified").when(F.col("_o") == "gave_up", "exhausted").otherwise("pending")
    return g.withColumn("phase", phase).drop("_o")


def fold_progress(log: DataFrame) -> DataFrame:
    """D3. Bytes done of each item by its last report; a restarted attempt may report fewer than before."""
    return log.groupBy(*KEY).agg(_last("bytes", "now_ms", "seq").alias("bytes_done"))


def fold_checkpoints(log: DataFrame) -> DataFrame:
    """D4. Latest checkpoint per destination. ``op`` is save, clear (one destination) or clear_all (the item)."""
    order = F.struct("now_ms", "seq")
    per = log.where("op <> 'clear_all'").groupBy(*KEY, "dest").agg(F.max(order).alias("_at"), F.max_by(F.struct("op", "bytes_committed"), order).alias("_r"))
    wiped = log.where("op = 'clear_all'").groupBy(*KEY).agg(F.max(order).alias("_wipe"))
    live = per.join(wiped, KEY, "left").where("_r.op = 'save' and (_wipe is null or _wipe < _at)")
    return live.select(*KEY, "dest", F.col("_r.bytes_committed").alias("bytes_committed"))


def effective_activation(log: DataFrame, policies: DataFrame) -> DataFrame:
    """D5. Whether each instance is active: persisted override, else configured, else on. ``op`` is set or reset; rows
    that are not persistent do not survive a restart and don't count."""
    last = log.where("persistent or op = 'reset'").groupBy("instance").agg(F.max_by(F.struct("op", "active"), F.struct("now_ms", "seq")).alias("_r"))
    override = F.when(F.col("_r.op") == "set", F.col("_r.active"))
    out = policies.join(last, "instance", "left")
    source = F.when(override.isNotNull(), "override").when(F.col("enabled").isNotNull(), "config").otherwise("default")
    return out.select("instance", F.coalesce(override, "enabled", F.lit(True)).alias("active"), source.alias("source"))


def lifetime_stats(log: DataFrame) -> DataFrame:
    """D6. Replicated, failed and bytes of each instance; ``log`` has (instance, result, bytes)."""
    good = F.col("result") == "replicated"
    return log.groupBy("instance").agg(F.count_if(good).alias("replicated"), F.count_if(F.col("result") == "failed").alias("failed"), F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"))


def count_failures_once(log: DataFrame) -> DataFrame:
    """D7. Files that failed: an item counts in the round in which a destination newly exhausts, once per file version.

    ``log`` has (instance, relpath, dest, version, round, exhausted).
    """
    first = log.where("exhausted").groupBy(*KEY, "dest", "version").agg(F.min("round").alias("round"))
    return first.select(*KEY, "version", "round").distinct().groupBy("instance").agg(F.count("*").alias("files_failed"))


def new_files(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """C2. Listed files that the ledger does not know."""
    return manifest.join(ledger.select(*KEY), KEY, "left_anti")


def upsert_ready(ledger: DataFrame, manifest: DataFrame, now_ms: int) -> DataFrame:
    """C3. The ledger after a listing.

    New files come in ready. A terminal row whose size or time changed becomes ready again with counts, gate, error and
    bytes wiped and a new discovery time (``reset``). Other rows keep their state and take size and time. Rows that are
    not listed stay as they are.
    """
    lg, m = ledger.alias("l"), manifest.select(*KEY, "size", "mtime_ms").alias("m")
    j = lg.join(m, KEY, "full_outer")
    new, listed = F.col("l.state").isNull(), F.col("m.size").isNotNull()
    changed = ~F.struct("l.size", "l.mtime_ms").eqNullSafe(F.struct("m.size", "m.mtime_ms"))
    reset = ~new & listed & F.col("l.state").isin(*TERMINAL) & changed
    fresh = new | reset

    def kept(c, wiped):
        return F.when(fresh, wiped).otherwise(F.col(f"l.{c}")).alias(c)

    return j.select(
        *KEY, kept("state", F.lit("ready")), F.coalesce("m.size", "l.size").alias("size"), F.coalesce("m.mtime_ms", "l.mtime_ms").alias("mtime_ms"),
        kept("discovered_at", F.lit(now_ms)), kept("attempts", F.lit(0)), kept("next_attempt_at", F.lit(0)), kept("last_error", F.lit(None).cast("string")), kept("bytes_done", F.lit(0)),
        F.when(listed, F.lit(now_ms)).otherwise(F.col("l.updated_at")).alias("updated_at"), F.coalesce(reset, F.lit(False)).alias("reset"),
    )


def reset_cascade(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """C4. Destination states or checkpoints without those of reset items."""
    return rows.join(resets.where("reset").select(*KEY), KEY, "left_anti")


def claim_ready(ledger: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """T1. The oldest due ready items of each instance, at most ``limit``, as in progress. Ties go by path."""
    due = ledger.where((F.col("state") == "ready") & (F.col("next_attempt_at") <= now_ms))
    w = Window.partitionBy("instance").orderBy("discovered_at", "relpath")
    return due.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n").withColumn("state", F.lit("in_progress")).withColumn("updated_at", F.lit(now_ms))


def promote_due(ledger: DataFrame, now_ms: int) -> DataFrame:
    """T2. Failed items whose gate has passed become ready; the gate stays."""
    due = (F.col("state") == "failed") & (F.col("next_attempt_at") <= now_ms)
    return ledger.withColumn("updated_at", F.when(due, F.lit(now_ms)).otherwise(F.col("updated_at"))).withColumn("state", F.when(due, F.lit("ready")).otherwise(F.col("state")))


def drain(ledger: DataFrame, now_ms: int, limit: int, scratch: Scratch | None = None, blocks: int | None = None) -> DataFrame:
    """T3. The batch in which each due ready item is claimed when claiming goes on until nothing is left. An instance's
    backlog is ranked in ranges of its order, a task each."""
    due = ledger.where((F.col("state") == "ready") & (F.col("next_attempt_at") <= now_ms))
    ranked = rank(due, ["instance"], ["discovered_at", "relpath"], scratch or Scratch(ledger.sparkSession, "drain"), "_n", blocks)
    return ranked.withColumn("batch", F.ceil(F.col("_n") / limit).cast("long")).drop("_n")


def admission_order(waiters: DataFrame, permits: int, by: str | None = None) -> DataFrame:
    """T4. The first ``permits`` waiters, lowest priority number first and first come first served, of all or of each
    value of ``by``."""
    if by is None:
        return waiters.orderBy("priority", "seq").limit(permits)
    w = Window.partitionBy(by).orderBy("priority", "seq")
    return waiters.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= permits).drop("_n")


def list_by_state(ledger: DataFrame, *states: str) -> DataFrame:
    """T5. Items in the given states, oldest first."""
    return ledger.where(F.col("state").isin(*states)).orderBy("discovered_at", *KEY)


def transition_audit(log: DataFrame) -> DataFrame:
    """E11. Log rows whose move from the state before is not legal. The first row of an item has to be ready."""
    w = Window.partitionBy(*KEY).orderBy("ts", "seq")
    moved = log.withColumn("from_state", F.lag("state").over(w))
    pair = F.concat_ws(">", "from_state", "state")
    legal = F.when(F.col("from_state").isNull(), F.col("state") == "ready").otherwise((F.col("from_state") == F.col("state")) | pair.isin(*[f"{a}>{b}" for a, b in LEGAL]))
    return moved.where(~legal)
