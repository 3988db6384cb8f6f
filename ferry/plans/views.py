"""Views over the driver's tables that stand in for listings, logs and policies, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that plays "now": inside the events' range.
NOW = 1_705_000_000_000
START = 1_704_067_200_000

SQL = {
    "manifest": f"""SELECT doc_id, 'inst-' || (doc_id % 4) AS instance, lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') ||
        CASE doc_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.tmp' WHEN 2 THEN '.csv.done' ELSE '.txt' END AS relpath,
        CAST(strlen(text) AS BIGINT) AS size, {START} + doc_id * 61000 AS mtime_ms FROM documents""",
    "attempts": """SELECT event_id AS seq, epoch_us(ts) // 1000 AS now_ms, 'inst-' || (user_id % 4) AS instance, 'u' || user_id || '/f' || (event_id % 37) AS relpath,
        (['local', 's3', 'http'])[1 + event_id % 3] AS dest,
        CASE event_type WHEN 'error' THEN 'http' WHEN 'signup' THEN 'integrity' WHEN 'view' THEN 'progress' ELSE 'ok' END AS kind,
        CASE WHEN event_type = 'error' THEN ([408, 429, 500, 503, 403, 404])[1 + CAST(props->>'$.k' AS BIGINT) % 6] END AS status,
        CAST(round(value * 100) AS BIGINT) AS bytes FROM events""",
    "outcomes": """SELECT *, CASE kind WHEN 'ok' THEN 'ok' WHEN 'progress' THEN 'progress' ELSE CASE WHEN status IN (403, 404) THEN 'gave_up' ELSE 'failed' END END AS outcome,
        CASE kind WHEN 'http' THEN 'http ' || status WHEN 'integrity' THEN 'checksum mismatch' END AS error FROM attempts""",
    "ledger": f"""SELECT doc_id, instance, relpath, (['ready', 'in_progress', 'verified', 'completed', 'failed', 'exhausted', 'quarantined', 'retained'])[1 + doc_id % 8] AS state,
        size - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS size, mtime_ms, {START} + (doc_id * 7919) % 1000003 * 1000 AS discovered_at, doc_id % 5 AS attempts,
        CASE WHEN doc_id % 3 = 0 THEN {NOW} + 1000 ELSE 0 END AS next_attempt_at, CASE WHEN doc_id % 8 IN (4, 5, 6) THEN 'err ' || (doc_id % 7) END AS last_error,
        (size * (doc_id % 11)) // 10 AS bytes_done, {START} + doc_id * 1000 AS updated_at FROM manifest WHERE doc_id % 13 <> 0""",
    "dest_states": """SELECT l.instance, l.relpath, d.dest, CASE (l.doc_id + d.n) % 4 WHEN 0 THEN 'pending' WHEN 3 THEN CASE WHEN l.doc_id % 5 = 0 THEN 'exhausted' ELSE 'verified' END ELSE 'verified' END AS phase,
        (l.doc_id + d.n) % 6 AS attempts, 1704900000000 + (l.doc_id * d.n) % 1000 * 1000000 AS next_attempt_at,
        CASE WHEN (l.doc_id + d.n) % 4 IN (0, 3) THEN 'e' || (l.doc_id % 3) END AS last_error, l.attempts AS item_attempts
        FROM ledger l CROSS JOIN (VALUES ('local', 1), ('s3', 2), ('http', 3)) d(dest, n) WHERE (l.doc_id * d.n) % 7 <> 1""",
    "objects": "SELECT o_orderkey AS object, CAST(floor(o_totalprice * 1024) AS BIGINT) AS size FROM orders",
    "uploaded": "SELECT DISTINCT l_orderkey AS object, CAST(l_linenumber AS BIGINT) AS part FROM lineitem",
    "observations": """SELECT instance, 'u' || user_id AS relpath, event_id AS seq, epoch_us(ts) // 1000 AS observed_ms, CAST(floor(value / 40) AS BIGINT) AS size, CAST(floor(value / 40) AS BIGINT) * 1000 AS mtime_ms
        FROM (SELECT *, 'inst-' || (user_id % 4) AS instance FROM events)""",
    "replica": """SELECT doc_id, CAST(strlen(text) AS BIGINT) + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE sha256(text || CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE '' END) END AS checksum
        FROM documents WHERE doc_id % 17 <> 0""",
    "windows": f"SELECT 'night' AS schedule, {START} + d * 86400000 - 7200000 AS open_ms, {START} + d * 86400000 + 21600000 AS close_ms FROM range(0, 41) t(d)",
    "probes": "SELECT 'night' AS schedule, event_id, user_id, epoch_us(ts) // 1000 AS t_ms FROM events",
    "chunks": "SELECT instance, seq, now_ms AS t_ms, bytes * 4000 AS bytes FROM attempts",
    "progress": """SELECT conv_id AS transfer, turn AS tick, conv_id * 1000 + turn * 700 AS now_ms, CAST(done * 100 AS BIGINT) // CAST(greatest(size, 1) AS BIGINT) AS percent FROM (
        SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS done, sum(n) OVER (PARTITION BY conv_id) AS size
        FROM (SELECT conv_id, turn, max(CAST(strlen(text) AS BIGINT)) AS n FROM conversations GROUP BY conv_id, turn))""",
}
NEEDS = {"outcomes": ["attempts"], "ledger": ["manifest"], "dest_states": ["ledger"], "chunks": ["attempts"]}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the definitions of the views it names."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    defs = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{defs},\n{body[len(head):]}"
    return f"WITH {defs}\n{body}"


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def manifest(self, *more: str) -> DataFrame:
        """The listing, with further columns of its documents where they are named."""
        return self.table("documents").selectExpr(
            "doc_id", "concat('inst-', doc_id % 4) as instance",
            "concat(lang, '/', source, '/', lpad(cast(doc_id as string), 7, '0'), case doc_id % 5 when 0 then '.csv' when 1 then '.tmp' when 2 then '.csv.done' else '.txt' end) as relpath",
            "cast(octet_length(text) as bigint) as size", f"{START} + doc_id * 61000 as mtime_ms", *more,
        )

    def _events(self) -> DataFrame:
        return self.table("events").withColumn("ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    def attempts(self) -> DataFrame:
        return self._events().selectExpr(
            "event_id as seq", "ms as now_ms", "concat('inst-', user_id % 4) as instance", "concat('u', user_id, '/f', event_id % 37) as relpath", "element_at(array('local', 's3', 'http'), cast(1 + event_id % 3 as int)) as dest",
            "case event_type when 'error' then 'http' when 'signup' then 'integrity' when 'view' then 'progress' else 'ok' end as kind",
            "case when event_type = 'error' then element_at(array(408, 429, 500, 503, 403, 404), cast(1 + k % 6 as int)) end as status", "cast(round(value * 100) as bigint) as bytes",
        )

    def outcomes(self) -> DataFrame:
        return self.attempts().selectExpr("*", "case kind when 'ok' then 'ok' when 'progress' then 'progress' else case when status in (403, 404) then 'gave_up' else 'failed' end end as outcome", "case kind when 'http' then concat('http ', status) when 'integrity' then 'checksum mismatch' end as error")

    def ledger(self) -> DataFrame:
        return self.manifest().where("doc_id % 13 <> 0").selectExpr(
            "doc_id", "instance", "relpath", "element_at(array('ready', 'in_progress', 'verified', 'completed', 'failed', 'exhausted', 'quarantined', 'retained'), cast(1 + doc_id % 8 as int)) as state",
            "size - case when doc_id % 9 = 0 then 1 else 0 end as size", "mtime_ms", f"{START} + (doc_id * 7919) % 1000003 * 1000 as discovered_at", "doc_id % 5 as attempts",
            f"case when doc_id % 3 = 0 then {NOW} + 1000 else 0 end as next_attempt_at", "case when doc_id % 8 in (4, 5, 6) then concat('err ', doc_id % 7) end as last_error",
            "(size * (doc_id % 11)) div 10 as bytes_done", f"{START} + doc_id * 1000 as updated_at",
        )

    def dest_states(self) -> DataFrame:
        d = self.ledger().select("*", F.explode(F.expr("array(named_struct('dest', 'local', 'n', 1), named_struct('dest', 's3', 'n', 2), named_struct('dest', 'http', 'n', 3))")).alias("d")).select("*", "d.dest", "d.n")
        return d.where("(doc_id * n) % 7 <> 1").selectExpr(
            "instance", "relpath", "dest", "case (doc_id + n) % 4 when 0 then 'pending' when 3 then case when doc_id % 5 = 0 then 'exhausted' else 'verified' end else 'verified' end as phase",
            "(doc_id + n) % 6 as attempts", "1704900000000 + (doc_id * n) % 1000 * 1000000 as next_attempt_at", "case when (doc_id + n) % 4 in (0, 3) then concat('e', doc_id % 3) end as last_error", "attempts as item_attempts",
        )

    def objects(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey as object", "cast(floor(o_totalprice * 1024) as bigint) as size")

    def uploaded(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey as object", "cast(l_linenumber as bigint) as part").distinct()

    def observations(self) -> DataFrame:
        return self._events().selectExpr("concat('inst-', user_id % 4) as instance", "concat('u', user_id) as relpath", "event_id as seq", "ms as observed_ms", "cast(floor(value / 40) as bigint) as size", "cast(floor(value / 40) as bigint) * 1000 as mtime_ms")

    def replica(self) -> DataFrame:
        return self.table("documents").where("doc_id % 17 <> 0").selectExpr("doc_id", "cast(octet_length(text) as bigint) + case when doc_id % 19 = 0 then 1 else 0 end as size", "case when doc_id % 29 = 0 then null else sha2(concat(text, case when doc_id % 23 = 0 then 'x' else '' end), 256) end as checksum")

    def windows(self) -> DataFrame:
        return self.spark.range(41).selectExpr("'night' as schedule", f"{START} + id * 86400000 - 7200000 as open_ms", f"{START} + id * 86400000 + 21600000 as close_ms")

    def probes(self) -> DataFrame:
        return self._events().selectExpr("'night' as schedule", "event_id", "user_id", "ms as t_ms")

    def chunks(self) -> DataFrame:
        return self.attempts().selectExpr("instance", "seq", "now_ms as t_ms", "bytes * 4000 as bytes")

    def progress(self) -> DataFrame:
        c = self.table("conversations").groupBy("conv_id", "turn").agg(F.max(F.octet_length("text").cast("long")).alias("n"))
        return c.selectExpr("*", "sum(n) over (partition by conv_id order by turn rows unbounded preceding) as done", "sum(n) over (partition by conv_id) as size").selectExpr("conv_id as transfer", "turn as tick", "conv_id * 1000 + turn * 700 as now_ms", "(done * 100) div greatest(size, 1) as percent")
