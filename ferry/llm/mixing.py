"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.llm.text import veiled, word_count
from ferry.plans.scratch import Scratch

FAR = 1e6


def _targets(hist: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: key, size, mean size and target.

    The weights repeat over the sources in code point order, null last. All sources together get ``share`` of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight, which is water
    filling: taking sources by how soon they are full, the level rises while full ones are set aside and falls once others
    are, so the largest of these levels is the one. One row per source is what these windows hold, however many documents
    there are.
    """
    src = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("_sq"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up, everywhere = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("_level", (share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    src = src.withColumn("_level", F.max("_level").over(everywhere))
    target = F.least("cap", F.col("_level") * F.col("weight"))
    mean = F.when(F.col("source_size") > 0, F.col("_sq") / F.col("source_size")).otherwise(F.lit(1.0))
    return src.select("source", "source_size", mean.alias("mean"), target.alias("target"))


def _solve(hist: DataFrame, sources: DataFrame, most: float, scratch: Scratch, tol: float = 1e-8, rounds: int = 60) -> DataFrame:
    """Newton's method on the convex dual, all sources at once: the tilt of each source.

    The rates nearest to one in relative entropy, under a source's token constraint and the bound ``most``, are
    min(most, exp(tilt * size / mean)). Each round sums value and slope per source over the histogram of sizes; steps are
    bounded and fall back to bisection, so that the clipped part cannot throw them off. An error where ``rounds`` do not
    bring every source within ``tol`` of its target.
    """
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = sources.select("*", F.when(F.col("target") <= 0, -FAR).when(full, FAR).otherwise(0.0).alias("tilt"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"), (full | (F.col("target") <= 0)).alias("done"))
    state = scratch.save(state, "tilt-0")
    for i in range(1, rounds + 1):
        open_ = state.where("not done")
        h, s = hist.where("size > 0").alias("h"), open_.alias("s")
        j = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select("s.*", (F.col("size") * F.col("n")).cast("double").alias("w"), (F.col("size") / F.col("mean")).alias("u"))
        j = j.withColumn("r", F.exp(F.col("tilt") * F.col("u")))
        keys = state.columns
        got = j.groupBy(*keys).agg(F.sum(F.col("w") * F.least(F.lit(float(most)), "r")).alias("f"), F.sum(F.when(F.col("r") < most, F.col("w") * F.col("u") * F.col("r")).otherwise(0.0)).alias("d"))
        gap = F.col("f") - F.col("target")
        got = got.withColumn("lo", F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi")))
        reach = F.greatest(F.lit(2.0), F.abs("tilt"))
        step = F.when(F.col("d") > 0, F.least(reach, F.greatest(-reach, -gap / F.col("d")))).otherwise(F.when(gap < 0, reach).otherwise(-reach))
        new = F.col("tilt") + step
        new = F.when((new > F.col("lo")) & (new < F.col("hi")), new).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.abs(gap) <= tol * F.col("target")
        got = got.select("source", "source_size", "mean", "target", F.when(done, F.col("tilt")).otherwise(new).alias("tilt"), "lo", "hi", done.alias("done"))
        nxt = scratch.save(got.unionByName(state.where("done")), f"tilt-{i}")
        scratch.drop(f"tilt-{i - 1}")
        state = nxt
        if not state.where("not done").limit(1).count():
            return state
    raise RuntimeError(f"the tilt of some source was not found in {rounds} rounds")


def _copies(hist: DataFrame, state: DataFrame, most: int, passes: int = 5) -> DataFrame:
    """(source, size, n, taken_docs): how many copies the documents of each source and size get together.

    Systematic rounding in order of size keeps each running count within one of its expectation. What is still missing or
    over then is settled from the largest sizes that fit, pass after pass, so that less than a small document remains.
    """
    h, s = hist.alias("h"), state.alias("s")
    c = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select("h.source", "size", "n", "target", (F.col("n") * F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))).alias("e"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    c = c.withColumn("_c", F.sum("e").over(down))
    m = F.floor(F.col("_c") + 0.5) - F.floor(F.col("_c") - F.col("e") + 0.5)
    c = c.withColumn("m", F.greatest(F.lit(0), F.least(m, most * F.col("n"))))
    for _ in range(passes):
        c = c.withColumn("_r", F.round(F.col("target") - F.sum(F.col("m") * F.col("size")).over(whole)).cast("long"))
        room = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("_r")), F.when(F.col("_r") > 0, most * F.col("n") - F.col("m")).otherwise(F.col("m"))).otherwise(0)
        c = c.withColumn("_k", room).withColumn("_s", F.sum(F.col("_k") * F.col("size")).over(down))
        left = F.abs("_r") - (F.col("_s") - F.col("_k") * F.col("size"))
        t = F.when(F.col("_k") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("_k"), F.floor(left / F.greatest(F.col("size"), F.lit(1))))))
        c = c.withColumn("m", F.col("m") + F.signum(F.col("_r").cast("double")).cast("long") * t)
    return c.select("source", "size", "n", F.col("m").cast("long").alias("m"))


def _ranked(docs: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, most: int, id_col: str, source_col: str, text_col: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(every row with its place in its class, the classes). A class is a source and a size: n rows that get m copies.

    Rows are (id, source, size, n, m, source_size, target, h, bk, rn, off): rank ``off + rn`` by bucket, then hash, then id.
    """
    base = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    hist = scratch.save(base.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = scratch.save(_targets(hist, weights, share, float(most)), "sources")
    state = _solve(hist, sources, float(most), scratch)
    st = state.select(F.col("source").alias("_src"), "source_size", "target")
    classes = _copies(hist, state, most)
    classes = scratch.save(classes.join(st, F.col("source").eqNullSafe(F.col("_src"))).drop("_src"), "classes")

    b, c = base.alias("b"), classes.alias("c")
    rows = b.join(c, (F.col("b.size") == F.col("c.size")) & F.col("b.source").eqNullSafe(F.col("c.source"))).select("b.*", "n", "m", "source_size", "target")
    rows = scratch.save(rows.withColumn("h", _spread(F.col("id"))).withColumn("bk", _bucket(F.col("h"), F.col("n"), bucket)), "dealt")
    counts = rows.groupBy("source", "size", "bk").agg(F.count("*").alias("k"))
    before = Window.partitionBy("source", "size").orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    off = scratch.save(counts.select("source", "size", "bk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off")), "offsets")
    in_bucket = Window.partitionBy("source", "size", "bk").orderBy("h", "id")
    ranked = rows.withColumn("rn", F.row_number().over(in_bucket)).withColumn("next_h", F.lead("h").over(in_bucket))
    r, o = ranked.alias("r"), off.alias("o")
    met = r.join(o, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r.bk") == F.col("o.bk"))).select("r.*", "off")
    return met, classes


def _spread(id_: Column) -> Column:
    return F.xxhash64(id_, F.lit(7))


def _bucket(h: Column, n: Column, bucket: int) -> Column:
    return F.pmod(h, F.greatest(F.lit(1), F.ceil(n / bucket)))


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket: int = 1024) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document.

    Size is the number of words. Everything about rates depends on source and size only, so the solver and the rounding
    work on the histogram of sizes per source (as many rows as there are distinct sizes). Within one source and size the
    copies go to documents in order of a hash of the id, ranked in buckets of about ``bucket`` rows, so that thousands of
    equal documents are spread; equal rows may swap places, which changes nothing. Null text has size 0; null source is a
    source of its own; documents of size 0 are taken as their rate says, with no words. Empty table: empty result.
    """
    out, _ = _ranked(docs, scratch, weights, share, most, id_col, source_col, text_col, bucket)
    copies = F.floor(F.col("m") / F.col("n")) + F.when(F.col("off") + F.col("rn") <= F.pmod(F.col("m"), F.col("n")), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.cast("long").alias("copies"))


def take_mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket: int = 1024) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` takes it, with all its columns.

    What travels is a row per source and size: the copies all its documents get and the place in the order of the hashes
    up to which they get one more. Each document's hash is compared with it in the scan, so no text is shuffled while that
    table is small enough for a broadcast, and AQE splits hot sizes where it is not. Where the place falls among rows of one hash (rows
    that repeat an id), these share what is due to them in an order of their columns; only where there are such rows do
    they meet.
    """
    ranked, classes = _ranked(docs, scratch, weights, share, most, id_col, source_col, text_col, bucket)
    last = ranked.where(F.col("off") + F.col("rn") == F.pmod(F.col("m"), F.col("n")))
    last = last.select(F.col("source").alias("_s1"), F.col("size").alias("_z1"), F.col("bk").alias("_cb"), F.col("h").alias("_ch"), F.coalesce(F.col("next_h") == F.col("h"), F.lit(False)).alias("_tied"), F.pmod(F.col("m"), F.col("n")).alias("_extra"), "off")
    last = scratch.save(last, "last")
    plan = classes.join(last, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("size") == F.col("_z1")), "left").where("m > 0")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.floor(F.col("m") / F.col("n")).alias("_each"), F.col("n").alias("_n"), "_cb", "_ch", F.coalesce("_tied", F.lit(False)).alias("_tied"), "_extra", F.col("off").alias("_off"))
    plan = scratch.save(plan, "plan")

    inner, names = veiled(docs)
    sized = inner.withColumn("_z0", word_count(F.col(names[text_col]))).withColumn("_h", _spread(F.col(names[id_col])))
    met = sized.join(plan, F.col(names[source_col]).eqNullSafe(F.col("_s")) & (F.col("_z0") == F.col("_z"))).withColumn("_b", _bucket(F.col("_h"), F.col("_n"), bucket))
    at_cut = F.coalesce((F.col("_b") == F.col("_cb")) & (F.col("_h") == F.col("_ch")), F.lit(False))
    within = F.coalesce((F.col("_b") < F.col("_cb")) | ((F.col("_b") == F.col("_cb")) & (F.col("_h") <= F.col("_ch"))), F.lit(False))
    tied = F.col("_tied") & at_cut
    taken = met.where(~tied).withColumn("_copies", (F.col("_each") + within.cast("int")).cast("int"))
    if plan.where("_tied").limit(1).count():
        # rows of the hash at the cut come after those of smaller hashes of their bucket
        smaller = ranked.join(plan.where("_tied").select("_s", "_z", F.col("_cb").alias("_b1"), F.col("_ch").alias("_h1")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("bk") == F.col("_b1")) & (F.col("h") < F.col("_h1")))
        smaller = scratch.save(smaller.groupBy(F.col("_s").alias("_s2"), F.col("_z").alias("_z2")).agg(F.count("*").alias("_under")), "under")
        ends = met.where(tied).join(smaller, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_z") == F.col("_z2")), "left")
        due = F.col("_extra") - F.col("_off") - F.coalesce("_under", F.lit(0))
        first = F.row_number().over(Window.partitionBy("_s", "_z").orderBy(names[id_col], F.xxhash64(*names.values())))
        taken = taken.unionByName(ends.withColumn("_copies", (F.col("_each") + (first <= due).cast("int")).cast("int")).drop("_s2", "_z2", "_under"))
    taken = taken.where("_copies > 0").withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(a).alias(c) for c, a in names.items()])
