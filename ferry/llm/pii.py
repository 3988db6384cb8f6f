"""Personal data: fixed rules, and a semi-Markov conditional random field that adds spans to what they find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Digit runs are taken whole and examined from their start only: a run that fails there fails everywhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from the at signs: the local part is the whole run before one."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield "email", lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed rules: leftmost and non-overlapping per kind, failing matches dropped, in order of start."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the random field

LONGEST = 24  # tokens of an entity at most
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_CLASSES = {"@": 0, ".": 1, "+": 2, "-": 3, "(": 4, ")": 5, "_": 6, "%": 6}
_OTHER, _SPACE, _LETTER, _DIGIT = 7, 8, 9, 10


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring words with a digit or an at sign; elsewhere nothing can be an entity.

    Entities hold a digit or an at sign and never more than one white-space character in a row, so that decoding these
    runs one by one is decoding the text.
    """
    lo = hi = -1
    for m in _WORD.finditer(text):
        if lo >= 0 and m.start() - hi == 1:
            hi = m.end()
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = m.span()
    if lo >= 0:
        yield lo, hi


class Region:
    """Tokens of one region, with running sums from which the features of any segment follow."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.bounds = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        n = len(self.bounds)
        words = [text[a:b] for a, b in self.bounds]
        kind = np.array([_DIGIT if w[0].isascii() and w[0].isdigit() else _LETTER if w.isalpha() else _SPACE if w.isspace() else _CLASSES.get(w, _OTHER) for w in words])
        width = np.array([b - a for a, b in self.bounds])
        value = np.array([min(int(w[:6]), 999) if k == _DIGIT else 0 for w, k in zip(words, kind, strict=True)])
        self.n, self.words, self.kind = n, words, kind

        def sums(v):
            return np.concatenate(([0], np.cumsum(v)))

        self.digits, self.values = sums(np.where(kind == _DIGIT, width, 0)), sums((kind == _DIGIT) & (value > 255))
        self.counts = [sums(kind == k) for k in range(11)]
        joint, wordy = np.isin(kind, (1, 2, 3, 6)), np.isin(kind, (_LETTER, _DIGIT))
        self.wordy = wordy
        self.joint_before, self.wordy_before = np.concatenate(([False], joint[:-1])), np.concatenate(([False], wordy[:-1]))
        self.wordy_after, self.at_after = np.concatenate((wordy[1:], [False])), np.concatenate((kind[1:] == 0, [False]))
        self.more_after = np.concatenate((np.isin(kind[1:], (1, 3)) & np.concatenate((wordy[2:], [False]))[: n - 1], [False]))
        self.last_dot = np.maximum.accumulate(np.where(kind == 1, np.arange(n), -1))

    def segments(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(features, whether allowed) of the segments that begin at tokens ``lo`` to ``hi``."""
        i = np.arange(lo, hi)[:, None]
        j = i + np.arange(LONGEST)[None, :]
        inside = j < self.n
        j = np.minimum(j, self.n - 1)
        digits, big = self.digits[j + 1] - self.digits[i], self.values[j + 1] - self.values[i]
        at, dot, plus, hyphen, left, right, _, other, space, letters, parts = (c[j + 1] - c[i] for c in self.counts)
        first, last = self.kind[i] + 0 * j, self.kind[j]
        edge = np.isin(first, (_LETTER, _DIGIT, 2, 4)) & np.isin(last, (_LETTER, _DIGIT))
        card = np.zeros(digits.shape, dtype=bool)
        for a, b in zip(*np.nonzero((digits >= 14) & (digits <= 19) & (letters == 0) & inside & (first == _DIGIT) & (last == _DIGIT)), strict=True):
            x = lo + a
            card[a, b] = luhn("".join(w for w, k in zip(self.words[x : x + b + 1], self.kind[x : x + b + 1], strict=True) if k == _DIGIT))
        plain = (letters == 0) & (at == 0) & (other == 0)
        of = [
            np.ones(digits.shape), digits == 0, (digits > 0) & (digits < 7), (digits >= 7) & (digits < 10), (digits >= 10) & (digits < 14), (digits >= 14) & (digits <= 15), (digits > 15) & (digits < 20), digits > 19,
            parts == 1, parts == 2, parts == 3, parts == 4, parts > 4, letters == 0, letters > 1, at == 1, at > 1, dot == 0, dot == 3, dot > 3,
            plus == 1, plus > 1, first == 2, (left == right) & (left > 0), left != right, space == 0, (space > 0) & (space < 4), space > 3, hyphen == 0, hyphen > 3, other > 0,
            first == _LETTER, first == _DIGIT, first == 4, last == _LETTER, last == _DIGIT,
            self.wordy_before[i] & self.wordy[i], self.wordy_after[j] & self.wordy[j], self.joint_before[i], self.at_after[j], self.more_after[j],
            plain & (parts == 4) & (dot == 3) & (big == 0) & (space + hyphen + plus == 0), plain & (big > 0) & (dot == 3), card, (digits >= 14) & ~card & (letters == 0),
            (at == 1) & (self.last_dot[j] > i) & (last == _LETTER) & (space == 0), (at == 1) & (space > 0),
            plain & (plus == 1) & (first == 2) & (digits >= 10) & (digits <= 15), plain & (plus == 0) & (left == 1) & (right == 1) & (digits >= 10) & (digits <= 15),
        ]
        features = np.stack([np.broadcast_to(f, digits.shape) for f in of], axis=-1).astype(np.float32)
        return features, inside & edge & ((digits > 0) | (at > 0))


@dataclass
class Model:
    """Weights of span features per kind, and of neighbouring labels; the last label is 'no entity'."""

    weights: np.ndarray
    moves: np.ndarray


O = len(KINDS)  # noqa: E741


def _scores(model: Model, r: Region, block: int = 1024) -> np.ndarray:
    """[tokens, lengths, kinds]; features are made for a block of starts at a time."""
    out = np.empty((r.n, LONGEST, O), dtype=np.float32)
    for lo in range(0, r.n, block):
        features, allowed = r.segments(lo, min(r.n, lo + block))
        out[lo : lo + block] = np.where(allowed[:, :, None], features @ model.weights, -1e9)
    return out


def _ends(table: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, scores) of the segments that end before token ``j``."""
    starts = np.arange(max(0, j - LONGEST), j)
    return starts, table[starts, j - starts - 1]


def decode(model: Model, r: Region) -> list[tuple[str, int, int]]:
    """The best segmentation: boundaries and kinds chosen together, over segments of bounded length."""
    s, n = _scores(model, r), r.n
    best = np.full((n + 1, O + 1), -1e18)
    best[0, O] = 0
    into = np.full((n + 1, O + 1), -1e18)  # best score of being at i and going on with a label
    back: list[list[tuple[int, int]]] = [[(0, O)] * (O + 1) for _ in range(n + 1)]
    src = np.zeros((n + 1, O + 1), dtype=int)
    for j in range(n + 1):
        if j:
            starts, sc = _ends(s, j)
            tot = into[starts, :O] + sc
            arg = tot.argmax(axis=0)
            best[j, :O] = tot[arg, np.arange(O)]
            best[j, O] = into[j - 1, O]
            back[j] = [(int(starts[a]), y) for y, a in enumerate(arg)] + [(j - 1, O)]
        step = best[j][:, None] + model.moves
        src[j] = step.argmax(axis=0)
        into[j] = step.max(axis=0)
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, _ = back[j][y]
        if y < O:
            out.append((KINDS[y], r.bounds[i][0], r.bounds[j - 1][1]))
        j, y = i, int(src[i][y])
    return out[::-1]


def _gradient(model: Model, r: Region, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected features of one region of any length, by forward and backward sums over segments. Features
    are made for a block of starts at a time, twice, so that memory follows the scores only."""
    s, n = _scores(model, r), r.n

    def total(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    fwd, into = np.full((n + 1, O + 1), -1e9), np.full((n + 1, O + 1), -1e9)
    fwd[0, O] = 0
    for j in range(n + 1):
        if j:
            starts, sc = _ends(s, j)
            fwd[j, :O] = total(into[starts, :O] + sc, 0)
            fwd[j, O] = into[j - 1, O]
        into[j] = total(fwd[j][:, None] + model.moves, 0)
    bwd, onto = np.zeros((n + 1, O + 1)), np.zeros((n + 1, O + 1))  # onto[i, y]: everything after i that begins with y
    for i in range(n - 1, -1, -1):
        w = min(LONGEST, n - i)
        onto[i, :O] = total(s[i, :w] + bwd[i + 1 : i + w + 1, :O], 0)
        onto[i, O] = bwd[i + 1, O]
        bwd[i] = total(model.moves + onto[i][None, :], 1)
    z = float(total(fwd[n], 0))
    gw, gm = np.zeros_like(model.weights), np.zeros_like(model.moves)
    marks = {a: (b, y) for a, b, y in gold}
    for lo in range(0, n, 256):
        features, _ = r.segments(lo, min(n, lo + 256))
        for i in range(lo, min(n, lo + 256)):
            w = min(LONGEST, n - i)
            p = np.exp(np.minimum(into[i, :O] + s[i, :w] + bwd[i + 1 : i + w + 1, :O] - z, 0))
            gw -= features[i - lo, :w].T @ p
            gm -= np.exp(np.minimum(fwd[i][:, None] + model.moves + onto[i][None, :] - z, 0))
            if i in marks:
                b, y = marks[i]
                gw[:, y] += features[i - lo, b - i - 1]
    y0, i = O, 0
    while i < n:
        b, y = marks.get(i, (i + 1, O))
        gm[y0, y] += 1
        i, y0 = b, y
    return gw, gm


#: Characters of a region that are learned together, and around a span that is varied.
STRETCH, AROUND = 400, 80


def _stretches(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A region in stretches of about STRETCH characters that end at white space, if there is some near, and in no span."""
    lo = 0
    while lo < len(text):
        hi = lo + STRETCH
        blank = re.compile(r"\s").search(text, hi, hi + AROUND)
        hi = min(len(text), blank.start() if blank else hi)
        while inside := [b for _, a, b in spans if a < hi < b]:
            hi = max(inside)
        yield text[lo:hi], [(k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi]
        lo = hi


def _variants(text: str, spans: list[Span], rng: np.random.Generator) -> Iterator[tuple[str, list[Span]]]:
    """A stretch as it is, and around each span a copy that is still personal data and a corrupted one that is not. What is
    copied grows with the number of spans, not with its square."""
    yield text, spans
    for k, x, y in spans:
        lo, hi = max(0, x - AROUND), y + AROUND
        local = [(kk, u - lo, v - lo) for kk, u, v in spans if lo <= u and v <= hi]
        t, a, b = text[lo:hi], x - lo, y - lo
        old = t[a:b]
        digits = re.sub("[^0-9]", "", old)
        good = bad = None
        if k == "phone":
            good = {0: old.lstrip("+"), 1: "-".join(re.findall("[0-9]+", old)), 2: "+" + ".".join(re.findall("[0-9]+", old))}[int(rng.integers(3))]
            bad = digits[:6]
        elif k == "card":
            good = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
            bad = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(8))) % 10)
            bad = None if luhn(bad) else bad
        elif k == "ip":
            bad = "999." + old.split(".", 1)[1]
        else:
            bad = old.replace("@", "")
        for new, keep in ((good, True), (bad, False)):
            if new:
                move = len(new) - len(old)
                rest = [(kk, u + move * (u >= b), v + move * (u >= b)) for kk, u, v in local if (u, v) != (a, b) and (v <= a or u >= b)]
                yield t[:a] + new + t[b:], sorted(rest + [(k, a, a + len(new))] * keep, key=lambda s: s[1])


def fit(samples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.25, decay: float = 1e-4, budget: int = 60_000) -> Model:
    """Maximum likelihood by Adagrad on regions (text, spans of the fixed rules), in stretches and varied as above, until
    these come to ``budget`` characters; the test documents' 600 regions have some 20,000."""
    rng = np.random.default_rng(3)
    data, held = [], 0
    for text, spans in samples:
        if held >= budget:
            break
        for t, marks in (v for part in _stretches(text, spans) for v in _variants(*part, rng)):
            held += len(t)
            for a, b in regions(t):
                r = Region(t, a, b)
                starts, stops = {x: i for i, (x, _) in enumerate(r.bounds)}, {y: i + 1 for i, (_, y) in enumerate(r.bounds)}
                gold, free = [], 0
                for k, x, y in marks:
                    i, j = starts.get(x), stops.get(y)
                    if i is not None and j is not None and free <= i < j <= i + LONGEST and r.segments(i, i + 1)[1][0, j - i - 1]:
                        gold.append((i, j, KINDS.index(k)))
                        free = j
                data.append((r, gold))
    width = Region("0", 0, 1).segments(0, 1)[0].shape[-1]
    model = Model(np.zeros((width, O)), np.zeros((O + 1, O + 1)))
    model.weights[0] = -6.0
    sums = [np.full_like(model.weights, 1e-2), np.full_like(model.moves, 1e-2)]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            grads = _gradient(model, *data[i])
            for p, g, q in zip((model.weights, model.moves), grads, sums, strict=True):
                g = g - decay * p
                q += g * g
                p += rate * g / np.sqrt(q)
    return model


def _marked_regions(docs: DataFrame, h, text_col: str, most: int, longest: int) -> DataFrame:
    """(h, at, text, spans) of regions of every document with the spans of the fixed rules inside them: of at most ``most``
    of its regions, spread over it, and of each at most about ``longest`` characters."""
    schema = "h long, at int, text string, spans array<struct<kind:string,start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                base = base_spans(text)
                found = list(regions(text))
                rows = []
                for lo, hi in found[:: -(-len(found) // most)] if found else []:
                    last = lo + longest
                    hi = min(hi, max([last, *[b for _, a, b in base if a < last < b]]))
                    rows.append((key, lo, text[lo:hi], [{"kind": k, "start": a - lo, "stop": b - lo} for k, a, b in base if lo <= a and b <= hi]))
                cols = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.string(), t), strict=True)], names=["h", "at", "text", "spans"])

    return docs.where(F.col(text_col).rlike(r"@|[0-9]{2}")).select(h.alias("h"), text_col).mapInArrow(run, schema)


def train(docs: DataFrame, sample: int = 600, id_col: str = "doc_id", text_col: str = "text", per_document: int = 8, longest: int = 1_000) -> Model:
    """Fit on at most ``sample`` regions of documents that hold a digit pair or an at sign: at most ``per_document`` of each,
    spread over its text, and of a very long region the first ``longest`` characters. What comes to the driver, and with the
    budget of :func:`fit` the time of training, are bounded whatever the documents are like.

    Regions go by a hash of the document's id and by their place. Documents are looked at from the lowest hashes on, in
    shares that grow until the sample is full or every document was seen, so neither the reading nor what the tasks return
    grows with the table. Null texts have no region; repeated rows, and rows without id, give theirs each; equal ones may
    swap places, which changes nothing. An empty table gives a model that finds nothing. Other columns are ignored.
    """
    h, n, share = F.xxhash64(id_col, F.lit(13)), docs.count(), 0.0
    rows = []
    while share < 1 and len(rows) < sample:
        share = min(1.0, 16 * (share or sample / max(1, n)))
        low = docs.where(h < int(share * 2**64) - 2**63) if share < 1 else docs
        rows = _marked_regions(low, h, text_col, per_document, longest).orderBy("h", "at", "text").limit(sample).collect()
    return fit([(r["text"], [tuple(x) for x in r["spans"]]) for r in rows])


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): added ones lie clear of every base span."""
    text = text or ""
    base = base_spans(text)
    added = []
    for lo, hi in regions(text):
        for k, a, b in decode(model, Region(text, lo, hi)):
            if all(b <= x or a >= y for _, x, y in base):
                added.append((k, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, stop) in code points, stop exclusive, of every whole text.

    Null and empty texts have none. Texts without a digit or an at sign cannot have any and never leave the JVM. Equal
    rows get equal results, an empty table gives an empty result, other columns are ignored.
    """
    kind = "array<struct<kind:string,start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            found = [find(x.as_py(), model) for x in batch.column(1)]
            cols = [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in f[i]] for f in found], t) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "base", "spans"])

    text = F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col))
    got = docs.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id long, base {kind}, spans {kind}")
    return got.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
    return "".join([*out, text[at:]])
