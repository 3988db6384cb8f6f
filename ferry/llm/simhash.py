"""SimHash near-duplicates, found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.components import components
from ferry.plans.scratch import Scratch

BITS, HALF = 64, 32


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at the six ASCII white-space bytes only, which is just
    what is wanted here. A bit is 1 if it is set in over half the shingle hashes; a text without words gives 0.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        rolled = [b" ".join(words)]
    else:
        rolled = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(s, seed) for s in rolled), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _bucket_links(fps: np.ndarray, where: int, half: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever the links inside one bucket connect: at most one less than it has members.

    A search in breadth: each fingerprint is compared once, with those that no tree holds yet. A pair whose segment is
    equal meets in every wildcard bucket; it counts in the first one only.
    """
    out: list[tuple[int, int]] = []
    bit = (fps >> np.uint64(where + HALF * half)) & np.uint64(1)
    if where and (bit == bit[0]).all():
        return out
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= max_bits
            if where:
                near &= bit[left] != bit[i]
            if near.any():
                met = left[near]
                out += [(int(fps[i]), int(fps[j])) for j in met]
                queue += met.tolist()
                left = left[~near]
    return out


def near_links(prints: DataFrame, scratch: Scratch, max_bits: int = 3, bucket: int = 512, work: int = 1 << 26) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all those at ``max_bits`` (3 at most) or fewer bits.

    Two fingerprints that differ in at most three bits differ in at most one bit of one of their two halves. Each half is
    indexed 32 times, each time with another bit wiped out; equal variants meet. Buckets of two and three are verified by
    built-in functions; larger ones in tasks dealt by the comparisons they take (about ``work`` each), that return a
    spanning forest and never all pairs. Where a bucket has more than ``bucket`` members, comparing variants of the other
    half, whose 16-bit quarters are treated alike, costs less than comparing members: they are indexed once more, and at
    most 2^18 fingerprints can then share a bucket, whatever the data. Both ways give the same components.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves hold for 0 to 3 bits")
    fp = F.col("fp")

    def variant(half, bit):
        part = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))
        wiped = part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
        return F.lit((half * HALF + bit) << 32).bitwiseOR(wiped)

    index = prints.select("fp", F.explode(F.array(*[variant(h, b) for h in (0, 1) for b in range(HALF)])).alias("key"))
    counted = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")).where("n > 1")
    counted = scratch.save(counted, "buckets")
    third = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("x"))

    def apart(a, b):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    threes = counted.where("n = 3").select("a", "b", third.alias("c"))
    few = counted.where("n = 2").select("a", "b").unionByName(threes.select("a", "b"))
    few = few.unionByName(threes.select("a", F.col("c").alias("b"))).unionByName(threes.select("b", F.col("c").alias("a"))).where(apart("a", "b"))
    many = counted.where("n > 3").select("key", "n")
    full = scratch.save(index.join(many, "key").select("key", "n", "fp"), "full")

    second = []
    for quarter in (0, 1):
        # the half that the first key does not cover, in quarters of 16 bits, one of which differs in one bit at most
        other = F.when(F.col("key") >= F.lit(HALF << 32), fp).otherwise(F.shiftrightunsigned(fp, 32))
        part = (F.shiftrightunsigned(other, 16) if quarter else other).bitwiseAND(F.lit(0xFFFF))
        second += [F.concat_ws(":", "key", F.lit(f"{quarter}-{b}"), part.bitwiseAND(F.lit(0xFFFF ^ (1 << b)))) for b in range(16)]
    small = full.where(F.col("n") <= bucket).select("key", F.col("key").cast("string").alias("sub"), "fp")
    large = full.where(F.col("n") > bucket).select("key", F.explode(F.array(*second)).alias("sub"), "fp")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["key"].iloc[0]) >> 32
        fps = np.unique(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        links = np.array(_bucket_links(fps, at % HALF, at // HALF, max_bits), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    cost = many.agg(F.sum(F.least("n", F.lit(bucket)).cast("double") * F.col("n") * F.when(F.col("n") > bucket, 32).otherwise(1))).first()[0] or 0
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(cost / work) + 1)
    dense = small.unionByName(large).repartition(tasks, "sub").groupBy("sub").applyInPandas(forest, "a long, b long")
    return scratch.save(few.unionByName(dense).distinct(), "links")


def simhash_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the near-duplicate group of every row, named by its smallest id.

    Documents with the same fingerprint are one node; nodes link at ``max_bits`` or fewer differing bits. Texts without
    words (null, empty, blank) have fingerprint zero and link like any other. Repeated rows each give a row; a null id
    groups like any other row and never names a group unless all its ids are null. Other columns are ignored. An empty
    table gives an empty result.
    """
    prints = scratch.save(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comp = components(near_links(nodes.select("fp"), scratch, max_bits), scratch)
    named = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    named = scratch.save(named, "named")
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_fp = scratch.save(named.join(names, "comp").select("fp", "component_id"), "of-fp")
    return prints.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their group, with all their columns: one document of each group.

    Only ids travel to the rows; of rows that repeat an id all stay or none does. Rows without id stay.
    """
    groups = simhash_groups(docs, scratch, id_col, text_col, shingle, max_bits)
    gone = scratch.save(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


# --- similar texts: wide fingerprints, of which some segments are indexed

LANES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _lanes(hashes: np.ndarray, words: int) -> np.ndarray:
    """[shingles, words]: independent 64-bit values of each shingle, mixed from its hash."""
    h = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64)[None, :] * LANES[0]
    h = (h ^ (h >> np.uint64(30))) * LANES[1]
    h = (h ^ (h >> np.uint64(27))) * LANES[2]
    return (h ^ (h >> np.uint64(31))) * LANES[3]


def wide_fingerprint(text: str | None, words: int, shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of ``words`` 64-bit words, how far each bit is from tipping over). A bit is 1 if it is set for over
    half the distinct shingles; a text without words has none set."""
    got = (text or "").encode("utf-8").lower().split()
    if not got:
        return np.zeros(words, dtype=np.uint64), np.zeros(words * 64, dtype=np.int32)
    rolled = [b" ".join(got)] if len(got) < shingle else map(b" ".join, zip(*(got[i:] for i in range(shingle)), strict=False))
    of = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((of(s, seed) for s in rolled), dtype=np.uint64))
    ones = np.zeros(words * 64, dtype=np.int32)
    for i in range(0, len(hashes), 255):  # a byte holds the sum of 255 bits
        lanes = np.ascontiguousarray(_lanes(hashes[i : i + 255], words)).view(np.uint8)
        ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    tip = 2 * ones - len(hashes)
    return np.packbits(tip > 0, bitorder="little").view(np.uint64), np.abs(tip)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets of equal size have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_plan(n: int, similarity: float, recall: float, wipe: int | None = None) -> tuple[int, int, int, int]:
    """(words, width, wipe, most differing bits) for ``n`` documents.

    A segment is the low ``width`` bits of half a word: 22 up to 2^18 documents and four more than log2 n beyond, up to 32,
    which keeps unrelated documents apart. The number of segments follows from the odds that one of them differs
    in at most one bit (of two that differ in one, three in four are taken to wipe out that bit). Wider segments are more,
    and have more of their bits wiped out in turn, so that the share of pairs that meet does not fall as tables grow: of
    1,000 planted pairs from 0.8 to 0.86 it is 0.95 or more with the plans of 10^4, 2^24 and 2^30 documents (tested), and
    higher for pairs that are nearer. Two fingerprints are near when they differ in no more bits than 97.7% of the pairs at
    ``similarity`` do.
    """
    width = int(min(32, max(22, np.ceil(np.log2(max(2, n))) + 4)))
    wipe = wipe or round(width / 4.4)
    p = differing_share(similarity)
    meet = (1 - p) ** width + 0.75 * width * p * (1 - p) ** (width - 1)
    words = int(np.ceil(np.log(1 - recall) / np.log(1 - meet) / 2))
    words = max(words, 16)  # fewer bits would tell similarities apart less well
    return words, width, wipe, int(np.ceil(64 * words * p + 2 * np.sqrt(64 * words * p * (1 - p))))


def wide_index(docs: DataFrame, words: int, width: int, wipe: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp, weak): the fingerprint, and the places of the ``wipe`` bits of each segment that are next to tipping over,
    a byte each."""
    at = np.arange(2 * words)
    take = (at[:, None] // 2 * 64 + at[:, None] % 2 * 32) + np.arange(width)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = np.zeros((part.num_rows, words), dtype=np.uint64)
                weak = np.zeros((part.num_rows, 2 * words, wipe), dtype=np.int8)
                for r, t in enumerate(part.column(1)):
                    fps[r], tip = wide_fingerprint(t.as_py(), words, shingle)
                    weak[r] = np.argsort(tip[take], axis=1, kind="stable")[:, :wipe]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x[0].size, dtype=np.int32)), pa.array(x.ravel())) for x in (fps.view(np.int64), weak)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "fp", "weak"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp array<long>, weak array<byte>")


def _turned(x: Column, by: int) -> Column:
    return F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, 64 - by))


def wide_variants(prints: DataFrame, width: int, wipe: int, first: int = 0, segments: int | None = None) -> DataFrame:
    """(id, key): the deletion variants of a fingerprint: each segment, or ``segments`` of them from ``first`` on, with one of
    its weak bits wiped out, as a long of segment, place and value."""
    weak = F.col("weak") if segments is None else F.slice("weak", first * wipe + 1, segments * wipe)
    v = prints.select("id", "fp", F.posexplode(weak).alias("i", "bit"))
    v = v.select("id", (F.floor(F.col("i") / wipe) + first).cast("int").alias("seg"), F.col("bit").cast("int").alias("bit"), "fp")
    word = F.get("fp", F.floor(F.col("seg") / 2).cast("int"))
    value = F.when(F.col("seg") % 2 == 1, F.shiftrightunsigned(word, 32)).otherwise(word).bitwiseAND(F.lit((1 << width) - 1))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    head = F.shiftleft(F.col("seg").cast("long"), 38).bitwiseOR(F.shiftleft(F.col("bit").cast("long"), 32))
    return v.select("id", head.bitwiseOR(value.bitwiseAND(F.bitwise_not(place))).alias("key"))


def _wide_forest(fps: np.ndarray, comps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links between members of different components that connect whatever all near pairs of them connect. The largest
    component begins; each member is compared with those that no tree holds yet, and a component is reached as a whole."""
    out: list[tuple[int, int]] = []
    comp = np.unique(comps, return_inverse=True)[1]
    sizes = np.bincount(comp)
    left = np.lexsort((comp, -sizes[comp]))
    while len(left):
        start = comp[left] == comp[left[0]]
        queue, left = left[start].tolist(), left[~start]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]).sum(axis=1, dtype=np.int32) <= most
            if near.any():
                out += [(i, int(j)) for j in left[near]]
                reached = np.isin(comp[left], comp[left[near]])
                queue += left[reached].tolist()
                left = left[~reached]
    return out


def _rest_links(members: DataFrame, links: DataFrame, fps: DataFrame, verified, most: int, scratch: Scratch, few: int, block: int) -> DataFrame | None:
    """Links between members of a bucket (key, n, id) that ``links`` leave in different components; None where there are no
    such buckets.

    A bucket within one component has nothing to add, and buckets of the same members are one. All pairs of different
    components are compared: of up to ``few`` members by a join, of more in tasks over pairs of blocks of ``block`` members,
    which return spanning forests.
    """
    comp = components(links, Scratch(scratch.spark, "wide-comp"))
    many = members.where("n > 3").select("key", "id")
    many = many.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    h = F.xxhash64("id")
    mixed = many.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y"))
    mixed = mixed.where("lo <> hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    rest = scratch.save(many.join(mixed, "key").select("key", "n", "id", "c").distinct(), "wide-rest")
    if not rest.limit(1).count():
        return None
    small = rest.where(F.col("n") <= few).select("key", "id", "c")
    pairs = small.toDF("key", "a", "ca").join(small.toDF("key", "b", "cb"), "key").where("a < b and ca <> cb").select("a", "b").distinct()
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = rest.where(F.col("n") > few).withColumn("i", F.pmod(F.xxhash64("key", "id"), blocks).cast("int"))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).join(fps, "id")
    large = large.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "c", "fp")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        met = _wide_forest(np.stack(pdf["fp"].to_numpy()).view(np.uint64), pdf["c"].to_numpy(), most)
        met = ids[np.array(met, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": met.min(axis=1), "b": met.max(axis=1)})

    dense = large.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long").distinct()
    return scratch.save(verified(pairs).unionByName(dense), "wide-rest-links")


def similar_links(
    docs: DataFrame, scratch: Scratch, similarity: float = 0.8, recall: float = 0.97, wipe: int | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, few: int = 32, block: int = 2048, work: int = 1 << 22
) -> DataFrame:
    """Links (a, b) of ids of documents whose wide fingerprints are as near as those of texts of this similarity. They connect
    whatever all near pairs of the buckets connect.

    Of rows that repeat an id with other texts each is indexed, and the least fingerprint stands for the id when links are
    verified, so reruns agree. Variants meet by equality, a few segments at a time: some ``work`` variants, or an eighth of all.

    First every member of a bucket is verified against two members of it, the first and the last in an order of the ids that
    four kinds of buckets turn each in its own way. That costs two rows a member, and leaves most buckets within one component.
    In the others all pairs of members of different components are compared (:func:`_rest_links`). Rows without id take no
    part. An empty table has no links.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    n = docs.count()
    words, width, wipe, most = wide_plan(n, similarity, recall, wipe)
    prints = scratch.save(wide_index(docs, words, width, wipe, id_col, text_col, shingle), "wide")
    kind = F.pmod(F.shiftrightunsigned("key", 38), F.lit(4))
    salt = F.element_at(F.array(*[F.lit(int(x >> np.uint64(1))) for x in LANES]), (kind + 1).cast("int"))
    order = _turned(F.col("id").bitwiseXOR(salt), 17)
    step = -(-2 * words // max(1, min(8, -(-n * 2 * words * wipe // work))))
    members = None
    for first in range(0, 2 * words, step):
        index = wide_variants(prints, width, wipe, first, min(step, 2 * words - first))
        ends = index.select("key", order.alias("o")).groupBy("key").agg(F.min("o").alias("a"), F.max("o").alias("b"), F.count("*").alias("n")).where("a <> b")
        ends = scratch.save(ends.select("key", "n", *[_turned(F.col(c), 47).bitwiseXOR(salt).alias(c) for c in "ab"]), f"wide-buckets-{first}")
        met = scratch.save(index.join(ends, "key").select("key", "n", "id", "a", "b"), f"wide-members-{first}")
        scratch.drop(f"wide-buckets-{first}")
        members = met if members is None else members.unionByName(met)
    fps = prints.groupBy("id").agg(F.min("fp").alias("fp"))
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(fps.select(F.col("id").alias("a"), F.col("fp").alias("x")), "a").join(fps.select(F.col("id").alias("b"), F.col("fp").alias("y")), "b")
        return met.where(differ <= most).select("a", "b")

    pairs = members.select("id", F.explode(F.array("a", "b")).alias("other")).where("id <> other")
    pairs = scratch.save(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "wide-pairs")
    links = scratch.save(verified(pairs), "wide-links")
    rest = _rest_links(members, links, fps, verified, most, scratch, few, block)
    for first in range(0, 2 * words, step):
        scratch.drop(f"wide-members-{first}")
    return links if rest is None else scratch.save(links.unionByName(rest).distinct(), "wide-all-links")


def drop_similar(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for documents that are linked, directly or over others, to one of
    a smaller id by a similarity of five-word shingles of ``similarity`` or more.

    Similarity is told by wide fingerprints (see :func:`wide_plan`), whatever the texts' length; texts without words are
    all alike. Of rows that repeat an id all stay or none does. Rows without id stay. An empty table stays empty. Only ids
    travel to the rows.
    """
    comp = components(similar_links(docs, scratch, similarity, id_col=id_col, text_col=text_col, shingle=shingle, **options), scratch)
    gone = scratch.save(comp.where("node <> component").select(F.col("node").alias("_gone")), "wide-gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
