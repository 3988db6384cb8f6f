"""Best-fit packing of token sequences with a linear grouping scheme."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferry.plans.scratch import Scratch

END = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str, pattern: str, end_id: int = 50256):
    """The tokenizer of a rank file, one per Python worker. The end marker's text is its special id, as elsewhere."""
    if ranks_path not in _ENCODERS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: end_id})
    return _ENCODERS[ranks_path]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, numbered: bool = False) -> DataFrame:
    """Token pieces: (doc_id, piece, start, length, ids_crc32[, ids][, _task, _no]).

    A document is its token ids and then ``end_id``; null text has none but that. Longer documents are cut into pieces of
    ``capacity`` tokens, the first of which may be shorter. ``ids`` are little-endian numbers of 16 bits, or of 32 where the
    vocabulary or the end needs them: of as many bytes as ``ids`` has for each of its ``length`` tokens. ``numbered`` adds what
    :func:`_number` adds, in the same pass: a pass of its own would hold a second Python worker for each running task.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", _task long, _no long" * numbered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        small = "<u2" if max(enc.max_token_value, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple[int | None, int, int, int, int]] = []
                held: list[bytes] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = enc.encode(text.as_py() or "", allowed_special="all")
                    ids.append(end_id)
                    whole = np.array(ids, dtype="<u4")
                    n = -(-len(ids) // capacity)
                    cuts = [0, *range(len(ids) - (n - 1) * capacity, len(ids) + 1, capacity)]
                    rows += [(doc, k, a, b - a, zlib.crc32(whole[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                    if keep_ids:
                        held += [whole[a:b].astype(small).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
                if keep_ids:
                    cols.append(pa.array(held, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def run_numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _number(run(batches))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run_numbered if numbered else run, schema)


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, items per size): the cutting-stock linear programme by column generation, rounded down.

    The master problem's basis starts with one size per bin; each round prices a new configuration with an unbounded
    knapsack over the capacity and pivots it in, until none pays.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = sizes <= c
            value = np.where(fits, best[c - np.minimum(sizes, c)] + price, -1.0)
            i = int(value.argmax())
            best[c], choice[c] = (value[i], i) if value[i] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                new[choice[c]] += 1
                c -= int(sizes[choice[c]])
        way = np.linalg.solve(basis, new)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = new
    return [(int(t + 1e-9), basis[:, i].astype(int)) for i, t in enumerate(x) if int(t + 1e-9) > 0]


def plan_bins(histogram: dict[int, int], capacity: int = 1024, groups: int = 96, small: float = 1 / 8) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bin kinds that hold every item of a histogram of lengths.

    Lengths above ``small`` of the capacity are dealt, longest first, into ``groups`` groups of equal cardinality and
    rounded up to their group's longest. Configurations of these few sizes are optimised; then each group's slots get its
    real items, and all that remains goes best-fit, longest first, into the free room. The work depends on the number of
    distinct lengths and groups only, never on the number of items.
    """
    runs = sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True)
    if runs and (runs[0][0] > capacity or runs[-1][0] < 1):
        raise ValueError("lengths must be from 1 to the capacity")
    kinds: list[tuple[int, list[int]]] = [(c, [n]) for n, c in runs if n == capacity]
    large = [[n, c] for n, c in runs if capacity > n > capacity * small]
    rest: dict[int, int] = defaultdict(int, {n: c for n, c in runs if n <= capacity * small})
    total = sum(c for _, c in large)
    if total:
        each = -(-total // groups)
        held: list[list[list[int]]] = [[]]
        room = each
        for n, c in large:
            while c:
                t = min(c, room)
                held[-1].append([n, t])
                c, room = c - t, room - t
                if not room:
                    held.append([])
                    room = each
        held = [g for g in held if g]
        merged: list[list[list[int]]] = []
        for g in held:  # groups with the same rounded size are one
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        sizes = np.array([g[0][0] for g in merged])
        demand = np.array([sum(c for _, c in g) for g in merged], dtype=float)
        for times, wanted in _configurations(sizes, demand, capacity):
            slots = [(i, int(a)) for i, a in enumerate(wanted) if a]
            while times:
                heads = [merged[i][0][1] // a for i, a in slots]
                if min(heads) > 0:
                    t = min(times, *heads)
                    lengths = [merged[i][0][0] for i, a in slots for _ in range(a)]
                    for i, a in slots:
                        merged[i][0][1] -= a * t
                else:
                    t, lengths = 1, []
                    for i, a in slots:
                        for _ in range(a):
                            lengths.append(merged[i][0][0])
                            merged[i][0][1] -= 1
                            if not merged[i][0][1]:
                                merged[i].pop(0)
                for i, _ in slots:
                    while merged[i] and not merged[i][0][1]:
                        merged[i].pop(0)
                kinds.append((t, lengths))
                times -= t
        for g in merged:
            for n, c in g:
                rest[n] += c
    free: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for t, lengths in kinds:
        free[capacity - sum(lengths)].append((t, lengths))
    rooms = sorted(free)
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                per = min(capacity // n, c)
                t, have, lengths, room = c // per, per, [n] * per, capacity - per * n
            else:
                room, have = rooms[at], 1
                m, old = free[room].pop()
                t, lengths = min(c, m), [*old, n]
                if m > t:
                    free[room].append((m - t, old))
                if not free[room]:
                    rooms.pop(at)
                room -= n
            c -= t * have
            if not free[room] and (not rooms or room not in rooms):
                bisect.insort(rooms, room)
            free[room].append((t, lengths))
    return [k for r in free for k in free[r]]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds (_task, _no) inside a task: its number, and how many rows of a row's length it had before."""
    task, seen = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        length = batch.column(batch.schema.names.index("length")).to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        values, counts = np.unique(length, return_counts=True)
        no = np.empty(len(length), dtype=np.int64)
        no[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([seen[int(v)] for v in values], counts).astype(np.int64)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            seen[v] += c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(no), task, dtype=np.int64)), pa.array(no)], names=[*batch.schema.names, "_task", "_no"])


def pack(items: DataFrame, scratch: Scratch, capacity: int = 1024, groups: int = 96) -> DataFrame:
    """Adds (sequence_id, offset) to token pieces: every piece in one sequence of at most ``capacity`` tokens.

    Only the histogram of lengths (``capacity`` rows at most) comes to the driver. Pieces are numbered within their length
    by the tasks that write them, and the tasks' counts are added up, so that no piece moves to be numbered and no length,
    however common, is ordered in one task; the number says which bin and place the plan gives them. Repeated rows are
    packed each; an empty table gives an empty result.
    """
    schema = items.select("*", F.lit(0).cast("long").alias("_task"), F.lit(0).cast("long").alias("_no")).schema
    return _placed(items.mapInArrow(_number, schema), scratch, capacity, groups)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, scratch: Scratch, capacity: int = 1024, groups: int = 96, **options) -> DataFrame:
    """:func:`pack` of the :func:`pieces` of documents, cut and numbered in one pass of Python. ``options`` go to :func:`pieces`."""
    return _placed(pieces(docs, ranks_path, pattern, capacity, numbered=True, **options), scratch, capacity, groups)


def _placed(items: DataFrame, scratch: Scratch, capacity: int, groups: int) -> DataFrame:
    """Numbered pieces (with _task and _no last) with the sequence and offset that the plan gives them."""
    columns = items.columns[:-2]
    items = scratch.save(items, "pieces", compression="zstd")
    counts = scratch.save(items.groupBy("length", "_task").agg(F.count("*").alias("_k")), "counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_k")).collect()}
    firsts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for times, lengths in plan_bins(histogram, capacity, groups):
        offset = 0
        for n in lengths:
            firsts[n].append((used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in firsts.items()}
    shared = items.sparkSession.sparkContext.broadcast(table)

    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    off = scratch.save(counts.select("length", "_task", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off")), "offsets")
    numbered = items.join(off, ["length", "_task"]).withColumn("_no", F.col("_off") + F.col("_no"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, no: pd.Series) -> pd.DataFrame:
        plan = shared.value
        seq, offs = np.zeros(len(no), dtype=np.int64), np.zeros(len(no), dtype=np.int64)
        lengths, numbers = length.to_numpy(), no.to_numpy()
        for n in np.unique(lengths):
            mine = np.nonzero(lengths == n)[0]
            start, first, offset = plan[int(n)]
            i = np.searchsorted(start, numbers[mine], side="right") - 1
            seq[mine], offs[mine] = first[i] + numbers[mine] - start[i], offset[i]
        return pd.DataFrame({"sequence_id": seq, "offset": offs})

    return numbered.withColumn("_at", place("length", "_no")).select(*columns, "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids, pieces, offsets): the training sequences, from packed pieces that keep their ids.

    A sequence holds at most the capacity, so its group is bounded; its pieces stand in order of their offset.
    """
    held = packed.select("sequence_id", F.struct("offset", "doc_id", "piece", "length", "ids").alias("_p")).groupBy("sequence_id").agg(F.array_sort(F.collect_list("_p")).alias("_h"))

    def each(name):
        return F.transform("_h", lambda x: x[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # the token numbers of a whole batch would be some 40 MB, here and in the JVM
                batch = whole.slice(lo, 256)
                parts, lengths = batch.column(1), batch.column(2)
                flat = [np.frombuffer(p.as_py(), dtype=f"<u{len(p.as_py()) // n.as_py()}").astype(np.int32) for p, n in zip(parts.flatten(), lengths.flatten(), strict=True)]
                tokens = np.array([len(x) for x in flat], dtype=np.int64)
                ends = np.concatenate(([0], np.cumsum(tokens)))[parts.offsets.to_numpy() - parts.offsets[0].as_py()].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids.value_lengths(), ids, *batch.columns[3:]], names=["sequence_id", "length", "ids", "doc_ids", "pieces", "offsets"])

    rows = held.select("sequence_id", *[each(c).alias(c) for c in ("ids", "length", "doc_id", "piece", "offset")])
    return rows.mapInArrow(run, "sequence_id long, length int, ids array<int>, doc_ids array<long>, pieces array<int>, offsets array<long>")
