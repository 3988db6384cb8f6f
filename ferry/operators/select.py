"""Which files of a listing count: patterns, markers, strategies, folders to leave out, names that collide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferry.functions.keys import matches, selected, selection_regex, split_name


def select_globs(manifest: DataFrame, include: list[str], exclude: list[str], path: str = "relpath") -> DataFrame:
    """B1. Rows that pass the pattern sets; both compile to one regular expression each at plan time."""
    return manifest.where(selected(F.col(path), include, exclude))


def pattern_table(spark: SparkSession, patterns: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(instance, pattern): the included and excluded patterns of each instance as one regular expression."""
    rows = [(instance, selection_regex(include, exclude)) for instance, (include, exclude) in patterns.items()]
    return spark.createDataFrame(rows, "instance string, pattern string")


def select_by_table(manifest: DataFrame, patterns: DataFrame, path: str = "relpath") -> DataFrame:
    """B1 for many instances: rows that pass the patterns of their own instance (``pattern_table``), one expression for all
    of them whatever their number. Rows of an instance without patterns pass. Each task sorts its rows by pattern, so that
    it compiles each pattern once; instances with equal patterns share it."""
    own = patterns.select("instance", F.col("pattern").alias("_pattern"))
    met = manifest.join(own, "instance", "left").sortWithinPartitions("_pattern")
    return met.where(F.col("_pattern").isNull() | matches(F.col(path), F.col("_pattern"))).select(*manifest.columns)


def prune_dirs(manifest: DataFrame, skip: DataFrame, path: str = "relpath") -> DataFrame:
    """A3. Leaves out whatever lies at or below a folder of its own instance in ``skip(instance, dir)``, by whole path
    components.

    The folders of an instance travel to its rows as one list, and a row's ancestors are looked up in it, so no path is
    taken apart into rows and the listing is not joined with itself.
    """
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = skip.groupBy("instance").agg(F.collect_set(F.regexp_replace("dir", "/+$", "")).alias("_dirs"))
    met = manifest.join(dirs, "instance", "left")
    return met.where(~F.coalesce(F.arrays_overlap(up, F.col("_dirs")), F.lit(False))).select(*manifest.columns)


def ready_by_marker(manifest: DataFrame, suffix: str = ".done") -> DataFrame:
    """C1. Rows for which a file named like them plus ``suffix`` is listed too."""
    marks = manifest.where(F.col("relpath").endswith(suffix)).select("instance", F.expr(f"left(relpath, length(relpath) - {len(suffix)})").alias("relpath"))
    return manifest.join(marks.distinct(), ["instance", "relpath"], "left_semi")


def ready_by_glob(manifest: DataFrame, ready: list[str], exclude: list[str]) -> DataFrame:
    """E3. Rows that match the ready patterns (all, when there are none) and are not excluded."""
    return select_globs(manifest, ready, exclude)


def is_ready(manifest: DataFrame, policies: DataFrame, stable: DataFrame, patterns: dict[str, tuple[list[str], list[str]]], suffix: str = ".done") -> DataFrame:
    """E4. Each instance's own strategy in one plan: stability, marker, glob or rename.

    ``policies``(instance, strategy[, suffix]); ``stable``(instance, relpath) are the paths that E1 calls settled;
    ``patterns`` holds the ready and the excluded patterns of each instance that has any, and becomes a table of one row an
    instance, so that the plan does not grow with their number. An instance without a policy takes stability, one without patterns has every listed file ready under glob, one without
    a suffix takes ``suffix``. The signals are joined once and a CASE picks the one that counts.
    """
    own = F.coalesce("suffix", F.lit(suffix)) if "suffix" in policies.columns else F.lit(suffix)
    held = policies.select("instance", "strategy", own.alias("_suffix"))
    made = pattern_table(manifest.sparkSession, patterns).withColumnRenamed("pattern", "_pattern")
    listed = manifest.join(held.join(made, "instance", "full_outer"), "instance", "left")
    marks = listed.where((F.col("strategy") == "marker") & F.col("relpath").endswith(F.col("_suffix")))
    marks = marks.select("instance", F.expr("left(relpath, length(relpath) - length(_suffix))").alias("relpath"), F.lit(True).alias("_marked")).distinct()
    settled = stable.select("instance", "relpath", F.lit(True).alias("_stable")).distinct()
    m = listed.join(marks, ["instance", "relpath"], "left").join(settled, ["instance", "relpath"], "left")
    s = F.coalesce("strategy", F.lit("stability"))
    wanted = F.col("_pattern").isNull() | matches(F.col("relpath"), F.col("_pattern"))
    ok = F.when(s == "rename", True).when(s == "marker", F.coalesce("_marked", F.lit(False))).when(s == "glob", wanted).otherwise(F.coalesce("_stable", F.lit(False)))
    return m.sortWithinPartitions("_pattern").where(ok).select(*manifest.columns)


def label_dests(egress: DataFrame) -> DataFrame:
    """B8. (instance, pos, kind) -> label: the kind, or kind#n in order where an instance has several of a kind."""
    same = Window.partitionBy("instance", "kind")
    n = F.row_number().over(same.orderBy("pos"))
    return egress.withColumn("label", F.when(F.count("*").over(same) == 1, F.col("kind")).otherwise(F.concat("kind", F.lit("#"), n)))


def resolve_collisions(plan: DataFrame, existing: DataFrame, policy: str = "suffix", limit: int = 10_000) -> DataFrame:
    """B7. Final names for (target, seq) requests, given ``existing``(path) names.

    Requests of one target go in order of ``seq``; the first takes the name itself if it is free. ``overwrite`` keeps
    every name, ``fail`` gives an error where it is taken, ``suffix`` gives the k-th request in need the k-th free
    ``stem.N.ext`` with N below ``limit``. Only numbers up to taken + wanted are candidates, so their count is linear.
    """
    here = existing.select(F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
    asked = plan.join(here, "target", "left").withColumn("_k", F.row_number().over(Window.partitionBy("target").orderBy("seq")))
    taken = F.coalesce("_there", F.lit(False))
    if policy == "overwrite":
        return asked.select(*plan.columns, F.col("target").alias("final"), F.lit(None).cast("string").alias("error"))
    if policy == "fail":
        free = ~taken & (F.col("_k") == 1)
        return asked.select(*plan.columns, F.when(free, F.col("target")).alias("final"), F.when(~free, F.concat(F.lit("destination already exists: "), F.col("target"))).alias("error"))
    asked = asked.withColumn("_need", F.when(taken, F.col("_k")).otherwise(F.col("_k") - 1))
    head, stem, ext = split_name(F.col("target"))
    want = asked.where("_need > 0").groupBy("target").agg(F.max("_need").alias("_wanted"))
    want = want.withColumn("_pre", F.concat(head, stem, F.lit("."))).withColumn("_ext", ext)
    # names of the form stem.N.ext that exist, met by equality on what stands around N
    numbered = existing.select(F.regexp_extract("path", r"^(.*\.)([1-9][0-9]{0,4})((?:\.[^./]*)?)$", 1).alias("_pre"), F.regexp_extract("path", r"^(.*\.)([1-9][0-9]{0,4})((?:\.[^./]*)?)$", 2).try_cast("int").alias("_n"), F.regexp_extract("path", r"^(.*\.)([1-9][0-9]{0,4})((?:\.[^./]*)?)$", 3).alias("_ext")).where("_n is not null")
    used = want.join(numbered, ["_pre", "_ext"]).select("target", "_n").distinct()
    counts = used.groupBy("target").agg(F.count("*").alias("_used"))
    cand = want.join(counts, "target", "left").select("target", "_pre", "_ext", F.explode(F.sequence(F.lit(1), F.least(F.lit(limit - 1), (F.col("_wanted") + F.coalesce("_used", F.lit(0))).cast("int")))).alias("_n"))
    free = cand.join(used, ["target", "_n"], "left_anti").withColumn("_need", F.row_number().over(Window.partitionBy("target").orderBy("_n"))).select("target", "_need", F.concat("_pre", "_n", "_ext").alias("_name"))
    out = asked.join(free, ["target", "_need"], "left")
    final = F.when(F.col("_need") == 0, F.col("target")).otherwise(F.col("_name"))
    return out.select(*plan.columns, final.alias("final"), F.when(final.isNull(), F.concat(F.lit("no free suffixed name for "), F.col("target"))).alias("error"))


def dedup_instances(policies: DataFrame) -> DataFrame:
    """U1. First occurrence of an id on a device wins: adds ``kept``."""
    return policies.withColumn("kept", F.row_number().over(Window.partitionBy("device", "instance").orderBy("pos")) == 1)


def evict_absent(state: DataFrame, present: DataFrame) -> DataFrame:
    """U2. Tracking rows whose path is still listed."""
    return state.join(present.select("instance", "relpath").distinct(), ["instance", "relpath"], "left_semi")
