"""Connected components over an edge table, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferry.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component), component being the smallest node reachable.

    Alternates large-star and small-star rounds, each a minimum per node and a join. Every round is written to the
    shared folder, so that a hub's rows meet the minima over two fresh exchanges (which AQE splits when they are skewed)
    and a lost executor costs one round. Nodes without links do not appear; self-links and repeats are ignored; an empty
    edge table gives an empty result.
    """
    cur = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-0"
    )
    seen = None
    for i in range(1, max_rounds + 1):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), f"cc-{i}-low")
        large = scratch.save(cur.join(low, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct(), f"cc-{i}-large")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"cc-{i}-least")
        linked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = scratch.save(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"cc-{i}")
        now = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        for name in (f"cc-{i}-low", f"cc-{i}-large", f"cc-{i}-least", f"cc-{i - 1}"):
            scratch.drop(name)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
