"""Exact duplicates by progressive refinement: length, then prefix hash, then hash of the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferry.llm.text import ascii_lower
from ferry.plans.scratch import Scratch

#: Bits of the maps of lengths and of prefixes that occur more than once: 128 KB and 1 MB, whatever the data.
LENGTH_BITS, PREFIX_BITS = 1 << 20, 1 << 23


def _bitmap(keys: DataFrame, place: Column, bits: int, scratch: Scratch, name: str) -> DataFrame:
    """One row with the map of the places of ``keys``, as an array of longs."""
    word = keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_p") % 64).cast("int"))).alias("_w"))
    whole = keys.sparkSession.range(bits // 64).join(word, "id", "left").select("id", F.coalesce("_w", F.lit(0).cast("long")).alias("_w"))
    return scratch.save(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_w"))), lambda x: x["_w"]).alias("map")), name)


def _held(bitmap: DataFrame, place: Column) -> Column:
    word = F.get(bitmap.scalar(), F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


class Refinement:
    """The three steps over one table. Each reads what is left by the one before it.

    ``alike_length``: the text's length occurs more than once. ``alike_prefix``: so does its length with the hash of its
    first characters, which are hashed for texts of such lengths only. ``full``: the hash of the whole text where both
    hold, else null. What occurs more than once is kept in maps of a fixed number of bits, which travel with the query
    and are looked up in the scan; two keys at one place let through a text too many, which the next step sorts out, and
    never lose one. So every step is the same at any number of keys, and no text travels.
    """

    def __init__(self, docs: DataFrame, text_col: str, prefix_chars: int, scratch: Scratch) -> None:
        text = F.coalesce(F.col(text_col), F.lit(""))
        size = F.octet_length(text).cast("long")
        twice = docs.groupBy(size.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
        self.alike_length = _held(_bitmap(twice, F.pmod("_k", F.lit(LENGTH_BITS)), LENGTH_BITS, scratch, "lengths"), F.pmod(size, F.lit(LENGTH_BITS)))
        prefix = F.xxhash64(size, ascii_lower(F.substring(text, 1, prefix_chars)))
        twice = docs.where(self.alike_length).groupBy(prefix.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
        held = _held(_bitmap(twice, F.pmod("_k", F.lit(PREFIX_BITS)), PREFIX_BITS, scratch, "prefixes"), F.pmod(prefix, F.lit(PREFIX_BITS)))
        self.alike_prefix = F.when(self.alike_length, held).otherwise(F.lit(False))
        self.full = F.when(self.alike_prefix, F.sha2(ascii_lower(text), 256))


def _groups(docs: DataFrame, id_col: str, full: Column, scratch: Scratch) -> DataFrame:
    """Texts that occur more than once: (_full, _keep, _same, _size): the largest id, the rows that have it, all rows."""
    ids = docs.select(F.col(id_col).alias("_id"), full.alias("_full")).where("_full is not null").groupBy("_full", "_id").agg(F.count("*").alias("_c"))
    found = ids.groupBy("_full").agg(F.max(F.struct("_id", "_c")).alias("_b"), F.sum("_c").alias("_size")).where("_size > 1")
    return scratch.save(found.select("_full", F.col("_b._id").alias("_keep"), F.col("_b._c").alias("_same"), "_size"), "groups")


def _judged(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows alone in what their refinement reached, the other rows with their group and ``_kept``). Rows have (_id, _full).

    Of rows that repeat the largest id of their group one is kept; only where there are such rows do they meet, those of a
    text and a partition first.
    """
    met = rows.where("_full is not null").join(groups, "_full", "left")
    is_best = F.col("_id").eqNullSafe(F.col("_keep")) | F.col("_size").isNull()
    many = F.col("_id").eqNullSafe(F.col("_keep")) & (F.coalesce("_same", F.lit(1)) > 1)
    if groups.where("_same > 1").limit(1).count():
        # one row of each partition first, then one of these, so that no task sees all rows of a text
        again = met.where(many).withColumn("_at", F.spark_partition_id())
        again = again.withColumn("_n", F.row_number().over(Window.partitionBy("_full", "_at").orderBy("_id")))
        again = again.withColumn("_among", F.when(F.col("_n") == 1, -1).otherwise(F.col("_at")))
        first = F.row_number().over(Window.partitionBy("_full", "_among").orderBy("_at")) == 1
        again = again.withColumn("_kept", (F.col("_n") == 1) & first).drop("_at", "_n", "_among")
        met = met.where(~many).withColumn("_kept", is_best).unionByName(again)
    else:
        met = met.withColumn("_kept", is_best)
    return rows.where("_full is null"), met


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = (), prefix_chars: int = 256) -> DataFrame:
    """One row per input row: id, the carried columns, keep_id, group_size, kept.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; of rows that also share the id, exactly one. Only rows whose length and prefix hash occur more than
    once have their whole text hashed (see :class:`Refinement`), and no text is shuffled. A hot group is counted map-side
    and met by a join that AQE may split. An empty table gives an empty result. Columns other than id and text are
    ignored, whatever their name.
    """
    full = Refinement(docs, text_col, prefix_chars, scratch).full
    groups = _groups(docs, id_col, full, scratch)
    rows = docs.select(F.col(id_col).alias("_id"), *carry, full.alias("_full"))
    extra = [c for c in rows.columns if c not in ("_id", "_full")]
    alone, met = _judged(rows, groups)
    alone = alone.select(F.col("_id").alias(id_col), *extra, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return alone.unionByName(met.select(F.col("_id").alias(id_col), *extra, keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).alias("group_size"), F.col("_kept").alias("kept")))


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Same rules as :func:`exact_dedup`.

    Nothing but the groups is written. Rows that are alone go from the scan to the result.
    """
    full = Refinement(docs, text_col, prefix_chars, scratch).full
    groups = _groups(docs, id_col, full, scratch)
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(a) for c, a in inner.items()], F.col(id_col).alias("_id"), full.alias("_full"))
    alone, met = _judged(rows, groups)
    columns = [F.col(a).alias(c) for c, a in inner.items()]
    return alone.select(*columns).unionByName(met.where("_kept").select(*columns))
