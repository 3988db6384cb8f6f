"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.llm.components import components
from ferry.plans.scratch import Scratch

#: Bits of a vector's sketch; the sketch, not the vector, travels while the graph is refined.
BITS = 256
WORDS = [f"s{i}" for i in range(BITS // 64)]
SKETCH = ", ".join(f"{w} long" for w in WORDS)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _stack(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([17, dims]).standard_normal((dims, BITS))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(vector length, rows of the batch that have it)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield int(n), np.nonzero(lengths == n)[0]


def _words(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(WORDS))]).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, over the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def sketches(reps: DataFrame) -> DataFrame:
    """(id, g, s0, s1, ...): the signs of random projections, and the vector's length as ``g``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(WORDS)), dtype=np.int64)
            for n, at in _by_length(batch.column(1)):
                x = _unit(_stack(batch.column(1).take(pa.array(at))))
                out[at] = np.packbits(x @ _planes(n) > 0, axis=1, bitorder="little").view(np.int64)
            g = batch.column(1).value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), g, *[pa.array(out[:, i].copy()) for i in range(len(WORDS))]], names=["id", "g", *WORDS])

    return reps.select("id", "v").mapInArrow(run, f"id long, g int, {SKETCH}")


def limit_bits(threshold: float) -> int:
    """Differing bits that a pair at the threshold stays within, but for four standard deviations."""
    p = math.acos(threshold) / math.pi
    return min(BITS, math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p))))


def seed_lists(nodes: DataFrame, n: int, orders: range, k: int, block: int = 128) -> DataFrame:
    """First neighbour lists (a, b, d, same, new) from a few orders of the sketches.

    ``nodes`` has (id, g, sketch, comp). In each order the bits of the sketch are permuted and rows are sorted by them over
    range partitions, which is a projection tree that is as deep as the data are dense; rows are compared within blocks of
    that order that overlap by half. Work is linear in the rows, and no dense place sits in one task. Neighbours in another
    component only, as those in the own one are counted apart.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(_words(batch, 2)).view(np.uint8), axis=1, bitorder="little")
            for t in orders:
                pick = np.random.default_rng([29, t]).permutation(BITS)[:63]
                key = bits[:, pick].astype(np.int64) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, dtype=np.int32)), pa.array(key), *batch.columns], names=["t", "key", *batch.schema.names])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, held = block // 2, None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), _words(batch, 4), batch.column(8).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(p) for p in zip(held, now, strict=True)]
            lo = 0
            while len(held[0]) - lo >= block:
                yield best(*[p[lo : lo + block] for p in held])
                lo += half
            held = [p[lo:] for p in held]
        if held is not None and len(held[0]) > 1:
            yield best(*held)

    def best(t, ids, g, words, comp) -> pa.RecordBatch:
        d = _apart(words[:, None], words[None, :])
        d[(ids[:, None] == ids[None, :]) | (g[:, None] != g[None, :]) | (comp[:, None] == comp[None, :])] = BITS + 1
        m = min(k, len(ids) - 1)
        top = np.argpartition(d, m - 1, axis=1)[:, :m].ravel()
        a = np.repeat(np.arange(len(ids)), m)
        ok = d[a, top] <= BITS // 2
        a, top = a[ok], top[ok]
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[top]), pa.array(d[a, top].astype(np.int32))], names=["a", "b", "d"])

    spread = nodes.select("id", "g", *WORDS, "comp").mapInArrow(deal, f"t int, key long, id long, g int, {SKETCH}, comp long")
    parts = max(1, -(-n * len(orders) // 50_000))
    found = spread.repartitionByRange(parts, "t", "key").sortWithinPartitions("t", "key", "id").mapInArrow(near, "a long, b long, d int")
    return keep_best(found.select("*", F.lit(False).alias("same"), F.lit(True).alias("new")), k)


def keep_best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each vector in its own component and the ``k`` nearest elsewhere. An entry is new until it has
    been through a round. One exchange, on the vector, serves both steps."""
    one = found.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.bool_or("same").alias("same"), F.bool_and("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a", "same").orderBy("d", "b"))
    return one.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def local_join(lists: DataFrame, nodes: DataFrame, k: int, round_: int) -> DataFrame:
    """Neighbours of neighbours (a, b, d): the members of each list, and up to ``k`` of those that list its owner, are
    compared with each other unless both were there in the round before. Only what would improve a list comes back."""
    rev = lists.select(F.col("b").alias("host"), F.col("a").alias("id"), "new")
    pick = Window.partitionBy("host").orderBy(F.col("new").desc(), F.xxhash64("host", "id", F.lit(round_)))
    rev = rev.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= k).drop("_r")
    met = lists.select(F.col("a").alias("host"), F.col("b").alias("id"), "new").unionByName(rev)
    live = met.where("new").select("host").distinct()
    met = met.join(live, "host", "left_semi").groupBy("host", "id").agg(F.bool_or("new").alias("new"))
    worst = lists.where(~F.col("same")).groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).alias("worst"))
    known = nodes.select("id", *WORDS, "comp").join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(BITS // 2 + 1)))
    met = met.join(known, "id").groupBy("host").agg(F.collect_list(F.struct("id", "new", "worst", "comp", *WORDS)).alias("m"))
    met = met.where("size(m) > 1 and exists(m, x -> x.new)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                m = batch.column(0).slice(lo, 256)
                sizes = m.value_lengths().to_numpy(zero_copy_only=False)
                flat = m.flatten()
                row = np.repeat(np.arange(len(sizes)), sizes)
                col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                wide = int(sizes.max(initial=1))

                def laid(values, fill, dtype, row=row, col=col, shape=(len(sizes), wide)):
                    out = np.full((*shape, *values.shape[1:]), fill, dtype=dtype)
                    out[row, col] = values
                    return out

                ids = laid(flat.field("id").to_numpy(zero_copy_only=False), -1, np.int64)
                new = laid(flat.field("new").to_numpy(zero_copy_only=False), False, bool)
                worst = laid(flat.field("worst").to_numpy(zero_copy_only=False), 0, np.int32)
                comp = laid(flat.field("comp").to_numpy(zero_copy_only=False), -1, np.int64)
                there = laid(np.ones(len(row), dtype=bool), False, bool)
                words = laid(np.column_stack([flat.field(w).to_numpy(zero_copy_only=False) for w in WORDS]).view(np.uint64), 0, np.uint64)
                d = _apart(words[:, :, None], words[:, None, :]).astype(np.int32)
                ok = (new[:, :, None] | new[:, None, :]) & there[:, None, :] & (d < worst[:, :, None]) & (comp[:, :, None] != comp[:, None, :])
                d[~ok] = BITS + 1
                if wide > k:  # of one list's proposals to one vector, the k nearest can enter its own list
                    cut = np.partition(d, k - 1, axis=2)[:, :, k - 1 : k]
                    ok &= d <= cut
                h, i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[h, i]), pa.array(ids[h, j]), pa.array(d[h, i, j])], names=["a", "b", "d"])

    return met.select("m").mapInArrow(run, "a long, b long, d int")


def refine(lists: DataFrame, nodes: DataFrame, limit: int, k: int, scratch: Scratch, name: str, rate: float = 0.1, max_rounds: int = 60) -> DataFrame:
    """The lists after rounds of neighbours-of-neighbours.

    All new entries are joined until fewer than ``rate`` of a round's entries are new and its pairs within ``limit`` bits
    grow by less than a hundredth. From then on only new pairs within ``limit`` are, until a round brings none.
    """
    count = [F.count("*"), F.count_if("new"), F.count_if(F.col("new") & (F.col("d") <= limit)), F.count_if(F.col("d") <= limit)]
    wide = True
    for r in range(max_rounds):
        found = local_join(lists, nodes, k, r).select("*", F.lit(False).alias("same"), F.lit(True).alias("new"))
        nxt = scratch.save(keep_best(lists.withColumn("new", F.lit(False)).unionByName(found), k), f"{name}-{r}")
        total, new, gained, links = nxt.agg(*count).first()
        if r:
            scratch.drop(f"{name}-{r - 1}")
        if wide and new <= rate * total and gained <= 0.01 * links:
            wide = False
        lists = nxt if wide else nxt.withColumn("new", F.col("new") & (F.col("d") <= limit))
        if not new or (not wide and not gained):
            return nxt
    raise RuntimeError(f"links were still found after {max_rounds} rounds")


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine, in double precision, is ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for _, at in _by_length(batch.column(2)):
                x, y = (_unit(_stack(batch.column(c).take(pa.array(at)))) for c in (2, 3))
                ok[at] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    v = reps.select("id", "v")
    met = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link_components(reps: DataFrame, n: int, scratch: Scratch, name: str, threshold: float, k: int, first: int, orders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(links, components): links that connect the vectors, each once, and the component (node, component) of their ends.

    A pass refines lists of ``k`` neighbours and verifies what is near. A list that then holds links only is saturated: it
    is enlarged by room for ``k`` neighbours outside its component, and another pass looks for these, until a pass links
    no two components. So lists stay short however dense a group is, and no link between two components is capped away.
    """
    limit = limit_bits(threshold)
    base = scratch.save(sketches(reps), f"{name}-sketches")
    nodes, links, comp, old, p = base.withColumn("comp", F.col("id")), None, None, None, 0
    while True:
        seeds = seed_lists(nodes, n, range(first + p * orders, first + (p + 1) * orders), k)
        if old is not None:
            seeds = keep_best(old.unionByName(seeds), k)
        lists = refine(scratch.save(seeds, f"{name}-{p}-seeds"), nodes, limit, k, scratch, f"{name}-{p}")
        near = lists.where((F.col("d") <= limit) & ~F.col("same")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        got = scratch.save(verified(near, reps, threshold), f"{name}-{p}-links")
        if not got.limit(1).count():
            break
        links = got if links is None else links.unionByName(got)
        comp = scratch.save(components(links, scratch), f"{name}-{p}-comp")
        both = got.unionByName(got.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("hit", F.lit(1))
        full = lists.where(~F.col("same")).join(both, ["a", "b"], "left").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.count("hit").alias("h")).where((F.col("n") >= k) & (F.col("h") == F.col("n"))).select("id")
        full = scratch.save(full, f"{name}-{p}-full")
        named = comp.withColumnsRenamed({"node": "id", "component": "comp"})
        nodes = scratch.save(base.join(full, "id", "left_semi").join(named, "id"), f"{name}-{p}-nodes")
        n = nodes.count()
        if n < 2:
            break
        ca, cb = nodes.select(F.col("id").alias("a"), F.col("comp").alias("ca")), nodes.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        old = lists.drop("same").join(ca, "a").join(cb, "b").select("a", "b", "d", (F.col("ca") == F.col("cb")).alias("same"), "new")
        p += 1
    if links is None:
        links = reps.sparkSession.createDataFrame([], "a long, b long")
        comp = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return links, comp


def count_links(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, others): for each vector the weight of the other vectors of its component that it links with.

    ``members`` has (comp, id, n, v). All links of a vector lie inside its component, whose members are dealt into blocks
    of about ``block``; each pair of blocks is compared in a task and gives one count per vector, never a pair.
    """
    sizes = members.groupBy("comp").agg(F.count("*").alias("_c"))
    m = members.join(sizes, "comp").withColumn("_k", F.ceil(F.col("_c") / block).cast("int")).withColumn("_b", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_k")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    m = m.select("comp", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).alias("right"), "id", "n", "v")
    m = m.groupBy("comp", "i", "j").agg(F.collect_list(F.struct("right", "id", "n", "v")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = [], []
            for r in range(batch.num_rows):
                got = batch.column(2)[r].values
                right, own, n = (got.field(c).to_numpy(zero_copy_only=False) for c in ("right", "id", "n"))
                x = _unit(_stack(got.field("v")))
                if batch.column(0)[r].as_py() == batch.column(1)[r].as_py():
                    s = (x @ x.T >= threshold) & (own[:, None] != own[None, :])
                    ids.append(own)
                    sums.append(s @ n)
                else:
                    s = x[~right] @ x[right].T >= threshold
                    ids += [own[~right], own[right]]
                    sums += [s @ n[right], s.T @ n[~right]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or [np.zeros(0, dtype=np.int64)])), pa.array(np.concatenate(sums or [np.zeros(0, dtype=np.int64)]))], names=["id", "others"])

    return m.select("i", "j", "m").mapInArrow(run, "id long, others long").groupBy("id").agg(F.sum("others").alias("others"))


def true_counts(reps: DataFrame, rows: list, threshold: float) -> dict[int, int]:
    """Weight of the links of a bounded number of vectors, as rows (id, v), with all vectors, by brute force."""
    shared = reps.sparkSession.sparkContext.broadcast([(r["id"], np.array(r["v"], dtype=np.float64)) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for size, at in _by_length(batch.column(2)):
                mine = [(i, v) for i, v in shared.value if len(v) == size]
                if not mine:
                    continue
                q, x = np.array([i for i, _ in mine], dtype=np.int64), _unit(np.stack([v for _, v in mine]))
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    s = (x @ _unit(_stack(batch.column(2).take(pa.array(part)))).T >= threshold) & (q[:, None] != ids[None, part])
                    for i, c in zip(q.tolist(), (s @ n[part]).tolist(), strict=True):
                        total[i] = total.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "c"])

    got = reps.select("id", "n", "v").mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))
    return {r["id"]: r["c"] for r in got.collect()}


def audit(counted: DataFrame, threshold: float, k: int, queries: int, rng: int) -> dict[str, float]:
    """Mean recall of a vector's links, apart for vectors with up to ``k`` links ("small") and more ("large").

    ``counted`` has (id, n, v, others). At most ``queries`` vectors of each stratum (no, few, many links found) are compared
    with all; each counts for its share of its stratum. A class of which no vector was drawn is left out.
    """
    laid = counted.withColumn("stratum", F.when(F.col("others") == 0, 0).when(F.col("others") <= k, 1).otherwise(2))
    sizes = {r["stratum"]: r["count"] for r in laid.groupBy("stratum").count().collect()}
    q = [r for s in sorted(sizes) for r in laid.where(F.col("stratum") == s).select("id", "v", "others").orderBy(F.xxhash64("id", F.lit(rng)), "id").limit(queries).collect()]
    if not q:
        return {}
    true, sums = true_counts(counted, q, threshold), {}
    for r in q:
        want, have = true.get(r["id"], 0), r["others"]
        if want:
            stratum = 0 if not have else 1 if have <= k else 2
            w = sizes[stratum] / min(queries, sizes[stratum])
            one = sums.setdefault("small" if want <= k else "large", [0.0, 0.0])
            one[0] += w * have / want
            one[1] += w
    return {c: a / b for c, (a, b) in sums.items()}


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.9, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, queries: int = 500, max_extra: int = 4) -> tuple[DataFrame, dict[str, float]]:
    """((vec_id, n_links, component_id, kept) of every row, recall): links of cosine ``threshold`` or more, and their
    components; recall is what the last audit measured, apart for vectors with few and with many links.

    Equal vectors are one class from the start, so thousands of copies cost one row. Sketches of 256 bits travel while
    lists are refined; vectors are read once to sketch them, once per pair that may link, and once per block of their
    component, in which links are counted exactly. The audit compares up to ``queries`` vectors of each stratum with brute
    force. While a class is below ``recall`` the whole search is run again from other seeds and its links are added; after
    ``max_extra`` such runs that did not help, an error tells the recall.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Vectors of different lengths are never compared. Repeated rows of an id count as copies of each other.
    Rows without id count as others' links but name no component unless all ids of their vector are null.
    An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("v"))
    zero = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 and 0.0 are one
    every = scratch.save(rows.select("vid", F.when(F.coalesce(sound, F.lit(False)), zero).alias("v")), "rows")
    classes = every.where("v is not null").groupBy("v").agg(F.min("vid").alias("id"), F.count("*").alias("n"))
    classes = scratch.save(classes.select("id", "n", "v"), "classes")
    reps = classes.where("id is not null")
    total = reps.count()
    links, measured = None, {}
    for run in range(max_extra + 1):
        found, comp = link_components(reps, total, scratch, f"run-{run}", threshold, k, 100 * run)
        if links is not None:
            found = links.unionByName(found)
            comp = scratch.save(components(found, scratch), f"run-{run}-all")
        links = found
        named = comp.withColumnsRenamed({"node": "id", "component": "comp"})
        others = count_links(reps.join(named, "id").select("comp", "id", "n", "v"), threshold)
        counted = reps.join(others, "id", "left").join(named, "id", "left").select("id", "n", "v", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("comp", "id").alias("comp"))
        counted = scratch.save(counted, f"run-{run}-counted")
        measured = audit(counted, threshold, k, queries, run)
        if all(x >= recall for x in measured.values()):
            break
    else:
        raise RuntimeError(f"recall of links by class: {measured}, below {recall}")
    logging.getLogger(__name__).info("recall of links by class: %s", measured)
    lone = every.where("v is null").select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    named = counted.select("v", (F.col("n") - 1 + F.col("others")).alias("n_links"), F.col("comp").alias("component_id"))
    named = named.unionByName(classes.where("id is null").select("v", (F.col("n") - 1).alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = every.where("v is not null").join(named, "v").select("vid", "n_links", "component_id").unionByName(lone)
    return out.select(F.col("vid").alias(id_col), "n_links", "component_id", F.col("vid").eqNullSafe(F.col("component_id")).alias("kept")), measured
