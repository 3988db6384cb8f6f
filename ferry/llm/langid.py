"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferry.llm.text import veiled

UNKNOWN = "und"


class Codebook:
    """Random vectors of letters and, bound from them, of letter triples.

    A letter's vector of +1 and -1 comes from a generator seeded with its code point, so every worker makes the same one.
    A triple's vector is the product of its letters' vectors, the first permuted twice and the second once. Anything that
    is not a letter is one boundary symbol; runs of it count once.
    """

    def __init__(self, dims: int = 1024, seed: int = 11) -> None:
        self.dims, self.seed = dims, seed
        self.shift = np.random.default_rng(seed).permutation(dims)
        self.number = np.full(0x110000, -1, dtype=np.int32)  # code point -> symbol; 0 is the boundary
        self.rows = [self._vector(0)]
        self.letters = np.array([False])
        self.stacked: tuple[np.ndarray, ...] | None = None

    def _vector(self, code: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1).astype(np.int8)

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = self.number[codes]
        if (found < 0).any():
            for c in np.unique(codes[found < 0]):
                if chr(c).isalpha():
                    self.number[c] = len(self.rows)
                    self.rows.append(self._vector(int(c)))
                    self.stacked = None
                else:
                    self.number[c] = 0
            found = self.number[codes]
        found = np.concatenate(([0], found, [0]))
        return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(unit document vectors, whether each has a letter)."""
        keys, owner, has = [], [], np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            s = self.symbols(t or "").astype(np.int64)
            has[i] = bool((s > 0).any())
            if has[i]:
                k = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
                keys.append(k)
                owner.append(np.full(len(k), i))
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        if not keys:
            return out, has
        if self.stacked is None:
            one = np.stack(self.rows)
            self.stacked = one[:, self.shift][:, self.shift], one[:, self.shift], one
        a, b, c = self.stacked
        keys, owner = np.concatenate(keys), np.concatenate(owner).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        at = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        uniq = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        for lo in range(0, len(uniq), 4096):  # counts of so many triples at a time
            u = uniq[lo : lo + 4096]
            x, y = np.searchsorted(at, (lo, lo + len(u)))
            count = np.bincount(owner[x:y].astype(np.int64) * len(u) + (at[x:y] - lo), minlength=len(texts) * len(u)).reshape(len(texts), -1).astype(np.float32)
            out += count @ (a[u >> 42] * b[(u >> 21) & 0x1FFFFF] * c[u & 0x1FFFFF]).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), has


_BOOKS: dict[tuple[int, int], Codebook] = {}


def _book(dims: int, seed: int) -> Codebook:
    return _BOOKS.setdefault((dims, seed), Codebook(dims, seed))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that a worker holds few texts as strings; what is freed goes back at the end."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def _groups(texts: list[str | None], chars: int = 200_000) -> Iterator[slice]:
    """Slices of about equal length in characters, so that very long texts don't meet in one matrix."""
    lo, seen = 0, 0
    for i, t in enumerate(texts):
        seen += len(t or "")
        if seen >= chars or i - lo >= 127:
            yield slice(lo, i + 1)
            lo, seen = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", sample: int = 40_000, dims: int = 1024, seed: int = 11) -> dict[str, np.ndarray]:
    """Language prototypes: the bundled unit vectors of labelled documents.

    Learns from rows with ``usable`` and a non-null language, from about ``sample`` of them when there are more, chosen
    by a hash of the key. Repeated rows count each; the sums, and so the prototypes, do not depend on the order of rows
    but for rounding. An empty table, or one without a labelled text with a letter, gives no prototypes. Other columns are
    ignored. Each task bundles what it reads into one vector per language; these partial sums are added by
    Spark and one vector per language comes back.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.xxhash64(key_col, F.lit(seed)) < int(sample / n * 2**64) - 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sums = _book(dims, seed), {}
        for batch in _small(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in _groups(texts):
                vecs, _ = book.vectors(texts[s])
                names = np.array(langs[s], dtype=object)
                for lang in set(langs[s]):
                    sums[lang] = sums.get(lang, 0) + vecs[names == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    partial = rows.select(lang_col, text_col).mapInArrow(run, "lang string, v array<double>")
    whole = partial.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    whole = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", F.transform("v", lambda p: p["x"]).alias("v"))
    got = {r["lang"]: np.array(r["v"]) for r in whole.collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(got.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = 1024, seed: int = 11) -> DataFrame:
    """Adds (lang_pred, score): the language whose prototype has the largest cosine with the document, and that cosine.

    Whole texts are read; null texts and texts without a letter are ``und`` with score 0, as is everything when nothing
    was learned. Of equal cosines the first language in code point order wins. Equal rows get equal results; an empty
    table gives an empty result; other columns pass through, but for columns of the two names, which are replaced.
    """
    docs = docs.drop(*({"lang_pred", "score"} - {text_col}))
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, dims), dtype=np.float32)

    # only the text travels to Python and only the answer back; the other columns wait in the JVM
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        book = _book(dims, seed)
        for batch in batches:
            pred, score = [], []
            for lo in range(0, len(batch), 512):
                texts = batch.slice(lo, 512).to_pylist()
                for s in _groups(texts):
                    vecs, has = book.vectors(texts[s])
                    cos = vecs @ matrix.T if names else np.zeros((len(has), 0), dtype=np.float32)
                    for ok, row in zip(has, cos, strict=True):
                        i = int(row.argmax()) if ok and names else -1
                        pred.append(names[i] if i >= 0 else UNKNOWN)
                        score.append(min(1.0, max(0.0, float(row[i]))) if i >= 0 else 0.0)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    def named(c: str) -> Column:
        return F.col(f"`{c.replace('`', '``')}`")

    kept = [named(c) for c in docs.columns]
    told = docs.select(*kept, answer(named(text_col)).alias("__answer"))
    return told.select(*kept, F.col("__answer.lang_pred").alias("lang_pred"), F.col("__answer.score").alias("score"))


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = 1024, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` whose language is one that was learned, with all their columns, whatever these are called.

    Null texts and texts without a letter go; when nothing was learned, everything goes. An empty table stays empty.
    """
    inner, names = veiled(docs)
    found = predict(inner, prototypes, names[text_col], dims, seed).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(a).alias(c) for c, a in names.items()])
