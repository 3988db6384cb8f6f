"""Policies: reading a fleet's documents, resolving defaults, what violations mean, hiding secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.functions.keys import byte_rate, duration_ms

#: Built-in values: first delay, longest delay, time until giving up (7 days).
BASE_MS, MAX_MS, GIVE_UP_MS = 1_000, 900_000, 604_800_000
ENUMS = {"on_success": ("archive", "delete"), "on_exhausted": ("retainInPlace", "quarantine"), "verify": ("checksum", "size", "none"), "on_collision": ("suffix", "overwrite", "fail")}
PERMISSION = ("disableInstance", "fatal", "retain")


def lenient_long(text: Column) -> Column:
    """A whole number, also when it is written as a float with nothing after the point; null for anything else."""
    d = text.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("long"))


def load_policies(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K1. (accepted, rejected) instances of JSON documents (device, json).

    A document is an object with ``instances``, an array. An instance without an id, or one that isn't an object, is
    rejected with a reason and its neighbours live. Numbers may be floats, a word outside its set drops that field only,
    durations and rates become milliseconds and bytes per second.
    """
    items = documents.select("device", F.posexplode(F.from_json(F.get_json_object("json", "$.instances"), "array<string>")).alias("pos", "item"))

    def field(path):
        return F.get_json_object("item", f"$.{path}")

    def word(path, name):
        v = field(path)
        return F.when(v.isin(*ENUMS[name]), v).alias(name)

    rows = items.select(
        "device", "pos", "item", field("id").alias("instance"), lenient_long(field("priority")).alias("priority"), field("enabled").try_cast("boolean").alias("enabled"),
        duration_ms(field("retry.giveUpAfter")).alias("give_up_after_ms"), lenient_long(field("retry.baseDelayMs")).alias("base_ms"), lenient_long(field("retry.maxDelayMs")).alias("max_ms"), lenient_long(field("retry.maxAttempts")).alias("max_attempts"),
        byte_rate(field("limits.bandwidth")).alias("bytes_per_sec"), word("completion.onSuccess", "on_success"), word("completion.onExhausted", "on_exhausted"), word("completion.verify", "verify"), word("completion.onCollision", "on_collision"),
    )
    shape = F.trim(F.col("item")).startswith("{")
    bad = F.when(~shape | F.col("item").isNull(), "not an object").when(F.col("instance").isNull() | (F.col("instance") == ""), "no id")
    marked = rows.withColumn("reason", bad)
    return marked.where("reason is null").drop("reason", "item"), marked.where("reason is not null").select("device", "pos", "item", "reason")


def load_globals(documents: DataFrame) -> DataFrame:
    """K1. The defaults of a device's ``global`` block: (device, base_ms, max_ms, max_attempts, give_up_after, timezone,
    on_permission, max_concurrent, bytes_per_sec, malformed), as :func:`resolve_policies` takes them.

    A block with a part of the wrong type is malformed as a whole and sets nothing, and so is a document that isn't JSON;
    an absent block sets nothing either. Numbers may be floats, of which the whole part counts. An unknown word for
    ``onPermissionError`` drops that field only.
    """
    block = F.expr("try_variant_get(try_parse_json(json), '$.global', 'variant')")
    d = documents.select("device", block.alias("g"), (F.col("json").isNotNull() & F.expr("try_parse_json(json)").isNull()).alias("broken"))

    def value(path, kind):
        return F.try_variant_get("g", f"$.{path}", kind)

    def wrong(path, *kinds):
        at = F.col("g") if path == "" else value(path, "variant")
        return F.coalesce(~F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0).isin("VOID", *kinds), F.lit(False))

    numbers = ("defaults.retry.baseDelayMs", "defaults.retry.maxDelayMs", "defaults.retry.maxAttempts", "limits.maxConcurrentFiles")
    bad = F.col("broken")
    for path in ("", "defaults", "defaults.retry", "limits"):
        bad = bad | wrong(path, "OBJECT")
    for path in ("defaults.timezone", "defaults.retry.giveUpAfter", "limits.maxBandwidth"):
        bad = bad | wrong(path, "STRING")
    for path in numbers:
        bad = bad | wrong(path, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")

    def number(path):
        given = value(path, "double")
        return F.when(given.isNotNull(), F.greatest(F.lit(0), given)).cast("long")

    word = value("onPermissionError", "string")
    rate = byte_rate(value("limits.maxBandwidth", "string"))
    base, longest, most, at_once = (number(p) for p in numbers)
    fields = {
        "base_ms": base, "max_ms": longest, "max_attempts": most, "give_up_after": value("defaults.retry.giveUpAfter", "string"), "timezone": value("defaults.timezone", "string"),
        "on_permission": F.when(word.isin(*PERMISSION), word), "max_concurrent": at_once, "bytes_per_sec": rate,
    }
    return d.select("device", *[F.when(~bad, c).alias(n) for n, c in fields.items()], bad.alias("malformed"))


def resolve_policies(instances: DataFrame, globals_: DataFrame) -> DataFrame:
    """C12. Instance, else the device's default, else built in, field by field; the longest delay is no shorter than the
    first; a time to give up that can't be read is the built-in one."""
    g = globals_.select("device", *[F.col(c).alias(f"_{c}") for c in ("base_ms", "max_ms", "max_attempts", "give_up_after", "on_permission")])
    j = instances.join(g, "device", "left")
    base = F.greatest(F.lit(1), F.coalesce("base_ms", "_base_ms", F.lit(BASE_MS)))
    text = F.coalesce("give_up_after", "_give_up_after")
    return j.select("device", "instance", base.alias("base_ms"), F.greatest(base, F.coalesce("max_ms", "_max_ms", F.lit(MAX_MS))).alias("max_ms"), F.coalesce("max_attempts", "_max_attempts").alias("max_attempts"), F.coalesce(duration_ms(text), F.lit(GIVE_UP_MS)).alias("give_up_after_ms"), F.coalesce("on_permission", "_on_permission", F.lit("disableInstance")).alias("on_permission"))


def startup_outcome(violations: DataFrame, policies: DataFrame) -> DataFrame:
    """K3. start, skip or fatal for each instance, with the joined reason and the first role and path."""
    v = violations.groupBy("instance").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "msg"))), lambda x: x["msg"]), "; ").alias("reason"), F.min_by("role", "seq").alias("role"), F.min_by("path", "seq").alias("path"))
    j = policies.join(v, "instance", "left")
    bad = F.col("reason").isNotNull()
    out = F.when(bad & (F.col("on_permission") == "fatal"), "fatal").when(bad & (F.col("on_permission") == "disableInstance"), "skip").otherwise("start")
    return j.select("instance", out.alias("outcome"), "reason", "role", "path")


def _hider(field: str, mark: str):
    return lambda e: e.withField(field, F.when(e[field].isNotNull(), F.lit(mark)))


def redact(policies: DataFrame, secrets: list[str], mark: str = "***") -> DataFrame:
    """K4. Secret fields, also inside arrays of structs (``egress.password``), replaced by a mark where they are set."""
    out = policies
    for name in secrets:
        head, _, tail = name.partition(".")
        if not tail:
            out = out.withColumn(head, F.when(F.col(head).isNotNull(), F.lit(mark)))
        elif policies.schema[head].dataType.typeName() == "array":
            out = out.withColumn(head, F.transform(head, _hider(tail, mark)))
        else:
            out = out.withColumn(head, F.col(head).withField(tail, F.when(F.col(f"{head}.{tail}").isNotNull(), F.lit(mark))))
    return out
