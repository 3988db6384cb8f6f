"""SentencePiece BPE on whole columns: words of many texts are merged together, round by round, in flat numpy arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.text import veiled

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Characters whose words are merged together.
CHUNK = 4_000_000
#: Rounds before words that go on for very long may be finished one by one.
ROUNDS = 64
_VOCABULARIES: dict[str, Vocabulary] = {}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Lookup:
    """Positions of distinct whole numbers by open addressing in numpy: all keys of an array are looked up together."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.at = np.full(len(self.slots), -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            first = np.unique(slot, return_index=True)[1]
            first = first[self.at[slot[first]] < 0]
            self.slots[slot[first]], self.at[slot[first]] = keys[todo[first]], todo[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, slot = todo[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, -1 for one that is not there."""
        slot = self._slot(keys)
        out = np.where(self.slots[slot] == keys, self.at[slot], -1)
        on = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[on]] == keys[on]
            out[on[held]] = self.at[slot[on[held]]]
            on = on[~held & (self.at[slot[on]] >= 0)]
        return out


class Vocabulary:
    """The pieces of a SentencePiece BPE model with byte fallback as tables.

    A symbol is a piece id, a further number for a character that only occurs inside pieces, or ``base`` plus the code
    point of a character in no piece. ``key`` has every way to put a piece together out of two symbols, sorted;
    ``joined`` the piece and ``rank`` its place by falling score, equal scores sharing one.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.hidden = np.array([lib.is_control(i) for i in range(n)])
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.is_byte):
            self.byte_id[int(self.text[i][3:-1], 16)] = i
        if self.is_byte.sum() != 256 or any(lib.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: not a BPE model with byte fallback and without unused pieces")
        symbol = {self.text[i]: i for i in normal}
        inner = sorted({c for i in normal for c in self.text[i]} - symbol.keys())
        symbol |= {c: n + k for k, c in enumerate(inner)}
        self.alphabet = {s for s in symbol if len(s) == 1}
        self.base = len(inner) + n
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.base
        for c in self.alphabet:
            self.of_char[ord(c)] = symbol[c]
        place = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in normal}, reverse=True))}
        rows = []
        for i in normal:
            p, r = self.text[i], place[lib.get_score(i)]
            rows += [(symbol[p[:k]] * self.base + symbol[p[k:]], r, i) for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.key, self.rank, self.joined = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.keys = Lookup(self.key)
        # Two characters that stand together in no piece are never in one symbol: words may be cut between them.
        self.together = Lookup(np.array(sorted({symbol[a] * self.base + symbol[b] for i in normal for a, b in zip(self.text[i], self.text[i][1:], strict=False)}), np.int64))
        cut = "".join(c for c in "\n\r\t" if c not in self.alphabet)
        whole = any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in normal)
        self.word = re.compile("(?s).+" if whole else f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        extra = [c.encode() for c in inner]
        self.id_sizes = np.array([1] * n + [len(b) for b in extra], np.int64)
        self.ids = np.concatenate([np.arange(n, dtype=np.int32), *[self.byte_id[list(b)] for b in extra]]).astype(np.int32)
        self.id_starts = offsets(self.id_sizes)[:-1]
        said = [b"" if self.hidden[i] else bytes([int(self.text[i][3:-1], 16)]) if self.is_byte[i] else lib.decode([int(i)]).encode() if lib.is_unknown(i) else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.said, self.said_sizes = np.frombuffer(b"".join(said), np.uint8), np.array([len(b) for b in said], np.int64)
        self.said_starts = offsets(self.said_sizes)[:-1]
        self.spaced = np.array([not self.is_byte[i] and self.text[i].startswith(SPACE) for i in range(n)])
        self._pairs: dict[tuple[int, int], tuple[int, int]] | None = None
        probe = ["", " ", "a  b \n", "\tﬁ①é́\x00▁x ", "the internationalisation   of <s> 12345", "中文。日本語 😀\U0010ffff"]
        if self.encode(probe)[0].tolist() != [i for t in probe for i in lib.encode(t)]:
            raise ValueError(f"{path}: encodes otherwise (no dummy prefix, other normalisation or not BPE)")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each two neighbouring symbols; NONE where they make no piece."""
        at = self.keys.find(left.astype(np.int64) * self.base + right)
        ok = (at >= 0) & (left < self.base) & (right < self.base)
        return np.where(ok, self.rank[at], NONE), self.joined[at]

    def _before_inversion(self, hit, owner, sym, new, low, start, size) -> np.ndarray:
        """Of the merges of a round, those that the library makes before it turns to a pair of no higher rank that one of
        them creates: all up to the first such merge of each segment. New pieces mostly rank below their parts, so that this
        is all of them, but a piece may be put together in several ways."""
        stop = start[owner] + size[owner]
        after = hit + 2
        right = np.where(after < stop, sym[np.minimum(after, len(sym) - 1)], self.base)
        joins = np.concatenate([[False], (hit[1:] - hit[:-1] == 2) & (owner[1:] == owner[:-1])])
        left = np.where(hit > start[owner], sym[np.maximum(hit - 1, 0)], self.base)
        left[joins] = new[hit[:-1]][joins[1:]]
        bad = (self.lookup(new[hit], right)[0] <= low[owner]) | (self.lookup(left, new[hit])[0] <= low[owner])
        if not bad.any():
            return np.ones(len(hit), bool)
        seen = np.cumsum(bad) - bad
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        return seen == np.repeat(seen[first], np.diff(np.append(np.flatnonzero(first), len(hit))))

    def merged(self, sym: np.ndarray, size: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, symbols of each segment) after merging within segments until no pair is left.

        Each round takes the least rank among a segment's pairs, merges its occurrences from the left, and squeezes the
        arrays; segments without a pair leave them. Long words that go on after ``rounds`` rounds with few merges each are
        finished one by one over a heap: the same merges in the same order.
        """
        seg, start = np.arange(len(size)), offsets(size)[:-1]
        end = np.zeros(len(sym), bool)
        end[start + size - 1] = True
        rank, new = self.lookup(sym, np.append(sym[1:], self.base).astype(np.int32))
        rank[end] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        turn, merges = 0, len(sym)
        while len(seg):
            low = np.minimum.reduceat(rank, start)
            live = low < NONE
            if not live.all():
                stays = np.repeat(live, size)
                done.append((seg[~live], size[~live], sym[~stays]))
                seg, size, low, sym, rank, new = seg[live], size[live], low[live], sym[stays], rank[stays], new[stays]
                start = offsets(size)[:-1]
                if not len(seg):
                    break
            if turn >= rounds and merges < 25 + len(sym) // 100:
                for i, a, n in zip(seg, start, size, strict=True):
                    one = self._one_by_one(sym[a : a + n].tolist())
                    done.append((np.array([i]), np.array([len(one)]), np.array(one, np.int32)))
                break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, at, 0))) % 2 == 0]
            owner = np.searchsorted(start, hit, side="right") - 1
            many = np.bincount(owner, minlength=len(seg))[owner] > 1
            if many.any():
                ok = np.ones(len(hit), bool)
                ok[many] = self._before_inversion(hit[many], owner[many], sym, new, low, start, size)
                hit, owner = hit[ok], owner[ok]
            sym[hit] = new[hit]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, rank, new = sym[stays], rank[stays], new[stays]
            size = size - np.bincount(owner, minlength=len(seg))
            start = offsets(size)[:-1]
            end = np.zeros(len(sym), bool)
            end[start + size - 1] = True
            near = np.concatenate([hit, hit[hit > 0] - 1])
            rank[near], new[near] = self.lookup(sym[near], sym[np.minimum(near + 1, len(sym) - 1)])
            rank[near[end[near]]] = NONE
            turn, merges = turn + 1, len(hit)
        if not done:
            return sym, size
        seg, size = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(seg)
        return np.concatenate([d[2] for d in done])[ragged(offsets(size)[:-1][order], size[order])], size[order]

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """The merges of one segment in order of rank and place, with links between the symbols that are left."""
        if self._pairs is None:
            self._pairs = {divmod(k, self.base): (r, j) for k, r, j in zip(self.key.tolist(), self.rank.tolist(), self.joined.tolist(), strict=True)}
        n, before, after = len(sym), list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (found := self._pairs.get((sym[i], sym[j]))):
                heapq.heappush(queue, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, a, b, joined = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = joined, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in sym if s >= 0]

    def words_to_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[codes]
        cut = np.ones(len(sym), bool)
        cut[1:] = (self.together.find(sym[:-1].astype(np.int64) * self.base + sym[1:]) < 0) | (sym[:-1] >= self.base) | (sym[1:] >= self.base)
        cut[offsets(sizes)[:-1]] = True
        starts = np.flatnonzero(cut)
        word = np.searchsorted(offsets(sizes), starts, side="right") - 1
        sym, n = self.merged(sym, np.diff(np.append(starts, len(sym))))
        known = sym < self.base
        n_ids, first, ids = np.ones(len(sym), np.int64), np.zeros(len(sym), np.int64), self.ids
        n_ids[known], first[known] = self.id_sizes[sym[known]], self.id_starts[sym[known]]
        if not known.all():
            strange, which = np.unique(sym[~known] - self.base, return_inverse=True)
            coded = [chr(c).encode() for c in strange.tolist()]
            lens = np.array([len(b) for b in coded])
            n_ids[~known], first[~known] = lens[which], (len(ids) + offsets(lens)[:-1])[which]
            ids = np.concatenate([ids, self.byte_id[np.frombuffer(b"".join(coded), np.uint8)]])
        per_segment = np.add.reduceat(n_ids, offsets(n)[:-1])
        return ids[ragged(first, n_ids)], np.bincount(word, per_segment, len(words)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Equal words are merged once."""
        found = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if not counts.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = pa.array([w for ws in found for w in ws], pa.large_string()).dictionary_encode()
        ids, sizes = self.words_to_ids(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        each = sizes[which]
        return ids[ragged(offsets(sizes)[:-1][which], each)], np.diff(offsets(each)[offsets(counts)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of id sequences, one after the other in ``ids``, as the library's decode() has them."""
        sizes = self.said_sizes[ids].copy()
        starts = self.said_starts[ids].copy()
        ends = offsets(counts)
        shown = np.flatnonzero(~self.hidden[ids])  # a sequence's first piece that is no control loses one leading space
        if len(shown):
            at = np.searchsorted(shown, ends[:-1])
            first = shown[np.minimum(at, len(shown) - 1)]
            first = first[(at < len(shown)) & (first >= ends[:-1]) & (first < ends[1:])]
            first = first[self.spaced[ids[first]]]
            sizes[first] -= 1
            starts[first] += 1
        flat = self.said[ragged(starts, sizes)]
        bounds = offsets(sizes)[ends]
        texts = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat.tobytes())])
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            parts = zip(ends[:-1], ends[1:], strict=True)
            return pa.array([self._decode_runs(ids[a:b], starts[a:b], sizes[a:b]) for a, b in parts], pa.large_string())

    def _decode_runs(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> str:
        """One text whose runs of byte pieces are not all UTF-8: each byte that begins no character becomes U+FFFD."""
        out, k = [], 0
        raw = self.is_byte[ids]
        while k < len(ids):
            j = k + 1
            while j < len(ids) and raw[j] == raw[k]:
                j += 1
            data = self.said[ragged(starts[k:j], sizes[k:j])].tobytes()
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode() + "�")
                    data = data[e.start + 1 :]
            k = j
        return "".join(out)


def vocabulary(path: str) -> Vocabulary:
    """The tables of a model file, one per Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``limit`` characters together; a longer text is a range of its own."""
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each whole text as the SentencePiece library encodes it, without begin and end ids.

    Null and empty texts have no ids. Texts of any length are taken whole, in memory that grows with the longest of them;
    repeated rows and ids and null ids give a row each. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, counts = v.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets(counts), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids, as the library decodes them, in ``text_col``.

    Null ids, ids that are null or outside the vocabulary give a null text; no ids give an empty one. Other columns stay,
    whatever their names; one named like ``text_col`` is replaced.
    """
    kept = encoded.drop(text_col) if text_col != ids_col else encoded
    rows, names = veiled(kept)
    back = {v: k for k, v in names.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                col = part.column(part.schema.get_field_index(names[ids_col])).cast(pa.list_(pa.int32()))
                flat = col.flatten()
                counts = np.diff(np.concatenate([[0], np.cumsum(np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))]))
                ids = flat.fill_null(-1).to_numpy()
                odd = (ids < 0) | (ids >= len(v.text))
                lost = np.zeros(len(counts), bool)
                lost[np.repeat(np.arange(len(counts)), counts)[odd]] = True
                lost |= col.is_null().to_numpy(zero_copy_only=False)
                texts = v.decode(np.where(odd, v.byte_id[0], ids), counts)
                if lost.any():
                    texts = pa.array([None if gone else t for gone, t in zip(lost, texts.to_pylist(), strict=True)], pa.large_string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], names=[*part.schema.names, "__text"])

    made = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__text", T.StringType())]))
    return made.select(*[F.col(c).alias(back[c]) for c in rows.columns], F.col("__text").alias(text_col)) if text_col != ids_col else made.select(*[F.col("__text" if back[c] == ids_col else c).alias(back[c]) for c in rows.columns])
