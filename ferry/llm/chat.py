"""Chat formatting with cumulative-snapshot collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.plans.scratch import Scratch


def collapse_and_render(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 256) -> DataFrame:
    """Render the maximal conversations of a log: (conv_id, segment, n_turns, n_copies, rendered).

    A chat log often holds the same conversation again and again, each time with one more turn. A conversation goes when
    its turns are a proper prefix of a longer one; of conversations with the same turns the smallest id stays and
    ``n_copies`` counts them. Turns are compared by role and text in order of turn number; their rolling prefix hash is
    the running XOR of two 64-bit hashes of (position, role, text).

    Turns are dealt by (conversation, block of turn numbers) and positions and hashes carried over blocks, so that a
    conversation with a third of all rows is spread; the rendered text comes in segments of ``block`` turns for the same
    reason (one segment for shorter conversations). Null role or text counts as empty, null turn numbers come last,
    identical rows of one turn count once, rows without conversation id belong to none and go. Markers inside a text are
    broken up. An empty table gives an empty result; other columns are ignored.
    """
    t = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).where("c is not null").distinct()
    late = F.lit(2**62) + F.pmod(F.xxhash64("r", "x"), F.lit(1024))
    t = t.withColumn("b", F.coalesce(F.floor(F.col("t") / block), late))
    inside = Window.partitionBy("c", "b").orderBy("t", "r", "x")
    placed = scratch.save(t.withColumn("k", F.row_number().over(inside).cast("long")), "placed")

    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("c", "b").agg(F.count("*").alias("n"))
    sizes = scratch.save(sizes.select("c", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.sum("n").over(Window.partitionBy("c")).alias("total")), "sizes")
    at = placed.join(sizes, ["c", "b"]).withColumn("pos", F.col("off") + F.col("k"))

    h = [F.xxhash64(F.lit(s), "pos", "r", "x").alias(f"h{s}") for s in (1, 2)]
    upto = Window.partitionBy("c", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = at.select("c", "b", "k", "pos", "total", *h).select("c", "b", "pos", "total", *[F.bit_xor(f"h{s}").over(upto).alias(f"x{s}") for s in (1, 2)])
    rolled = scratch.save(rolled, "rolled")
    ends = rolled.groupBy("c", "b").agg(*[F.max_by(f"x{s}", "pos").alias(f"e{s}") for s in (1, 2)])
    carried = scratch.save(ends.select("c", "b", *[F.coalesce(F.bit_xor(f"e{s}").over(before), F.lit(0)).alias(f"g{s}") for s in (1, 2)]), "carried")
    prefix = rolled.join(carried, ["c", "b"]).select("c", "pos", "total", *[F.col(f"x{s}").bitwiseXOR(F.col(f"g{s}")).alias(f"p{s}") for s in (1, 2)])
    prefix = scratch.save(prefix, "prefix")

    key = ["pos", "p1", "p2"]
    whole = prefix.where("pos = total").groupBy(*key).agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    begun = prefix.where("pos < total").select(*key).distinct()
    maximal = scratch.save(whole.join(begun, key, "left_anti").select("c", F.col("pos").alias("turns"), "copies"), "maximal")

    def broken(c):
        return F.replace(c, F.lit("<|"), F.lit("<​|"))

    piece = F.concat(F.lit("<|im_start|>"), broken(F.col("r")), F.lit("\n"), broken(F.col("x")), F.lit("<|im_end|>\n"))
    parts = at.join(maximal, "c").select("c", "turns", "copies", F.floor((F.col("pos") - 1) / block).alias("segment"), "pos", piece.alias("piece"))
    done = parts.groupBy("c", "segment").agg(F.first("turns").alias("n_turns"), F.first("copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("ps"))
    return done.select(F.col("c").alias(conv), "segment", "n_turns", "n_copies", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("rendered"))
