"""Which tokens of two tokenizers meet: products of sparse token-byte and token-group incidence matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.packing import encoder
from ferry.llm.pieces import SPACE, Lookup, offsets, ragged, vocabulary
from ferry.plans.scratch import Scratch

#: Bytes of text whose documents share one block matrix, and entries of a product that are formed at a time.
CHUNK, BLOCK = 250_000, 1 << 18
_TABLES: dict[tuple[str, str, str], Tables] = {}


@dataclass
class Csr:
    """A 0/1 matrix by rows: the columns of row i are ``cols[ptr[i] : ptr[i + 1]]``."""

    ptr: np.ndarray
    cols: np.ndarray
    width: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.ptr) - 1), self.sizes)
        return Csr(offsets(np.bincount(self.cols, minlength=self.width)), rows[np.argsort(self.cols, kind="stable")], len(self.ptr) - 1)


def product(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (row, column, value) of ``a`` x ``b`` by rows, in blocks of rows of about ``block`` terms.

    Row by row after Gustavson: row i is the sum of the rows of ``b`` that the columns of row i of ``a`` name; terms of one
    row and column are added up.
    """
    terms = b.sizes[a.cols]
    upto = offsets(terms)[a.ptr]
    lo, n = 0, len(a.ptr) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + block, side="right")) - 1)
        inner, count = a.cols[a.ptr[lo] : a.ptr[hi]], terms[a.ptr[lo] : a.ptr[hi]]
        col = b.cols[ragged(b.ptr[inner], count)]
        row = np.repeat(np.arange(lo, hi), upto[lo + 1 : hi + 1] - upto[lo:hi])
        if len(col):
            key = row * b.width + col
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, row, col = key[order], row[order], col[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            yield row[first], col[first], np.diff(np.append(first, len(key)))
        lo = hi


class Tables:
    """Both vocabularies, as bytes, and every id pair that can end at one place.

    Of two tokens whose byte ranges end together one is a suffix of the other. So the pairs are those of a token and a
    suffix of it: their number depends on the vocabularies alone, whatever the corpus.
    """

    def __init__(self, ranks_path: str, pattern: str, model_path: str) -> None:
        self.enc, self.pieces = encoder(ranks_path, pattern), vocabulary(model_path)
        n = self.enc.max_token_value + 1
        a = [b""] * n
        for t in self.enc.token_byte_values():
            a[self.enc.encode_single_token(t)] = t
        v = self.pieces
        b = [t.replace(SPACE, " ").encode() if not byte else bytes([int(t[3:-1], 16)]) for t, byte in zip(v.text, v.is_byte, strict=True)]
        self.a_size, self.b_size = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
        self.a_bytes, self.b_bytes = np.frombuffer(b"".join(a), np.uint8), np.frombuffer(b"".join(b), np.uint8)
        self.a_start, self.b_start = offsets(self.a_size)[:-1], offsets(self.b_size)[:-1]
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for i, t in enumerate(a):
            by_a.setdefault(t, []).append(i)
        for i, t in enumerate(b):
            if not v.hidden[i]:
                by_b.setdefault(t, []).append(i)
        self.width = len(b)
        keys = [i * self.width + j for i, t in enumerate(a) for k in range(len(t)) for j in by_b.get(t[k:], ())]
        keys += [i * self.width + j for t, js in by_b.items() for k in range(1, len(t)) for i in by_a.get(t[k:], ()) for j in js]
        self.key = np.array(sorted(keys), np.int64)
        self.keys = Lookup(self.key)
        # Every token in decimal with what may follow it in the text of groups.
        said = [f"{i}{s}" for s in ",|" for i in range(n)] + [f"{j}{s}" for s in (",", ";", "") for j in range(self.width)]
        self.said = np.array(said, object)
        self.n = n

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their number by text, ids of B, their number by text); texts that either does not keep have none."""
        spaced = [" " + t if t else "" for t in texts]
        lists = [self.enc.encode_to_numpy(t, disallowed_special=()) for t in spaced]
        n_a = np.fromiter(map(len, lists), np.int64, len(lists))
        a = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
        b, n_b = self.pieces.encode(texts)
        want = [t.encode() for t in spaced]
        lens = np.fromiter(map(len, want), np.int64, len(want))
        flat = np.frombuffer(b"".join(want), np.uint8)
        ok = lens > 0
        for ids, count, size, start, data in ((a, n_a, self.a_size, self.a_start, self.a_bytes), (b, n_b, self.b_size, self.b_start, self.b_bytes)):
            got = data[ragged(start[ids], size[ids])]
            at = offsets(offsets(size[ids])[offsets(count)][1:] - offsets(size[ids])[offsets(count)][:-1])
            same = np.diff(at) == lens
            if same.all():
                odd = np.flatnonzero(got != flat)
                same[np.searchsorted(at, odd, side="right") - 1] = False
            else:
                same &= [got[x:y].tobytes() == w for x, y, w in zip(at[:-1], at[1:], want, strict=True)]
            ok &= same
        return a[np.repeat(ok, n_a)], np.where(ok, n_a, 0), b[np.repeat(ok, n_b)].astype(np.int64), np.where(ok, n_b, 0)


def parts(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of rows that have about ``limit`` bytes of text together; only these become Python's strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield batch.column(0).slice(lo, hi - lo), [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
        lo = hi


def tables(ranks_path: str, pattern: str, model_path: str) -> Tables:
    """The tables of two tokenizers, one per Python process."""
    key = (ranks_path, pattern, model_path)
    if key not in _TABLES:
        _TABLES[key] = Tables(*key)
    return _TABLES[key]


@dataclass
class Aligned:
    """The tokens of some texts laid over the same bytes."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    over_a: Csr
    over_b: Csr

    @classmethod
    def of(cls, t: Tables, texts: list[str]) -> Aligned:
        a, n_a, b, n_b = t.encoded(texts)
        ptr_a, ptr_b = offsets(t.a_size[a]), offsets(t.b_size[b])
        every = np.arange(ptr_a[-1])
        return cls(a, b, n_a, n_b, ptr_a[1:], ptr_b[1:], Csr(ptr_a, every, len(every)), Csr(ptr_b, every, len(every)))

    def overlaps(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, bytes they share): the token-byte incidence of A times the transposed one of B."""
        return product(self.over_a, self.over_b.transposed(), block)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) of the overlaps whose byte ranges end together."""
        found = [(r[k], c[k]) for r, c, _ in self.overlaps() for k in [self.a_end[r] == self.b_end[c]]]
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, np.int64),) * 2

    def groups(self, ends: tuple[np.ndarray, np.ndarray]) -> tuple[Csr, Csr]:
        """Token-group incidence of A and of B: common ends cut the tokens into groups."""
        out = []
        for cut, n in ((ends[0], len(self.a)), (ends[1], len(self.b))):
            last = np.zeros(n, np.int64)
            last[cut] = 1
            out.append(Csr(np.arange(n + 1), np.cumsum(last) - last, len(cut)))
        return out[0], out[1]

    def said(self, t: Tables, group_a: Csr, group_b: Csr) -> list[str]:
        """By text, the groups as ``a1,a2|b1;a3|b2,b3``."""
        in_a, in_b = group_a.transposed(), group_b.transposed()
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[in_a.cols[in_a.ptr[1:] - 1]] = 1
        last_b[in_b.cols[in_b.ptr[1:] - 1]] = 1
        last_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        code[np.arange(len(self.a)) + in_b.ptr[group_a.cols]] = self.a + last_a * t.n
        code[np.arange(len(self.b)) + in_a.ptr[group_b.cols + 1]] = 2 * t.n + self.b + last_b * t.width
        words, at = t.said[code].tolist(), offsets(self.n_a + self.n_b)
        return ["".join(words[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_shared, groups string, links array<int>) of each whole text.

    A is the byte-level tokenizer over a space and the text, B the SentencePiece model over the text. ``links`` are the
    pairs whose byte ranges end together, by number (``pair_table``), in order; ``groups`` the ids between common ends;
    ``n_shared`` counts the pairs of a group. Null and empty texts, and those whose bytes either tokenizer does not keep
    (U+2581 in the text), have no tokens: zeros and empty values. Long texts are taken whole; the products are formed in
    blocks, the tokens of one text are held together. Repeated rows, ids and null ids give a row each, an empty table none;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(ranks_path, pattern, model_path)
        for batch in batches:
            for ids, texts in parts(batch):
                x = Aligned.of(t, texts)
                ends = x.ends()
                group_a, group_b = x.groups(ends)
                each = np.searchsorted(np.cumsum(x.n_a), ends[0], side="right")
                n_links = np.bincount(each, minlength=len(texts))
                doc_a = np.repeat(np.arange(len(texts)), x.n_a)
                shared = np.bincount(doc_a, group_b.transposed().sizes[group_a.cols], len(texts)).astype(np.int64)
                number = t.keys.find(x.a[ends[0]] * t.width + x.b[ends[1]])
                lists = pa.ListArray.from_arrays(pa.array(offsets(n_links), pa.int32()), pa.array(number, pa.int32()))
                longs = [pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, n_links, n_links, shared)]
                said = pa.array(x.said(t, group_a, group_b), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *longs, said, lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "links"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, links array<int>")


def linked_tokens(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link as a row: (doc_id, a_token, b_token, a_id, b_id, weight), tokens by their place in the text.

    ``kind`` is ``overlap`` (weight: shared bytes), ``end`` (those that end together) or ``shared`` (of one group, weight 1:
    as many as the group's two sizes multiplied, formed a block of tokens at a time). Texts without tokens have no links.
    """
    if kind not in ("overlap", "end", "shared"):
        raise ValueError(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(ranks_path, pattern, model_path)
        for batch in batches:
            for ids, texts in parts(batch):
                x = Aligned.of(t, texts)
                if kind == "shared":
                    group_a, group_b = x.groups(x.ends())
                    found = product(group_a, group_b.transposed())
                else:
                    found = x.overlaps()
                for r, c, w in found:
                    if kind == "end":
                        k = x.a_end[r] == x.b_end[c]
                        r, c, w = r[k], c[k], w[k]
                    doc = np.searchsorted(np.cumsum(x.n_a), r, side="right")
                    place_a, place_b = r - offsets(x.n_a)[doc], c - offsets(x.n_b)[doc]
                    cols = [ids.take(pa.array(doc)), *[pa.array(y, pa.int64()) for y in (place_a, place_b)], pa.array(x.a[r], pa.int32()), pa.array(x.b[c], pa.int32()), pa.array(w, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "a_token", "b_token", "a_id", "b_id", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_token long, b_token long, a_id int, b_id int, weight long")


def pair_table(ranks_path: str, pattern: str, model_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(id of A, id of B) by pair number."""
    t = tables(ranks_path, pattern, model_path)
    return t.key // t.width, t.key % t.width


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair linked; summed in each task before the exchange."""
    return aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def weigh(aligned: DataFrame, scratch: Scratch, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """``aligned`` with (n_best, count_sum) in place of ``links``: the links whose pair is linked most often among those of
    its B id, ties included, and the sum of the links' counts.

    The rows are written once and read twice. The counts are collected and sent to the tasks: one number a possible pair,
    of which the two vocabularies have a few hundred thousand, whatever the corpus.
    """
    held = scratch.save(aligned, "aligned", "zstd")
    b_of = pair_table(ranks_path, pattern, model_path)[1]
    got = pair_counts(held).toArrow()
    counts, top = np.zeros(len(b_of), np.int64), np.zeros(int(b_of.max()) + 1, np.int64)
    counts[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    np.maximum.at(top, b_of, counts)
    sent = held.sparkSession.sparkContext.broadcast((counts, counts == top[b_of]))
    others = [f for f in held.schema.fields if f.name != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            lists = batch.column(len(others))
            at = offsets(lists.value_lengths().to_numpy())
            pair = lists.flatten().to_numpy()
            sums = [np.diff(offsets(x[pair])[at]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(s, pa.int64()) for s in sums]], names=[*[f.name for f in others], "n_best", "count_sum"])

    out = T.StructType([*others, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return held.select(*[f.name for f in others], "links").mapInArrow(run, out)
