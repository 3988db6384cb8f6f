"""Quality grades by ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = string.punctuation + "¡¿«»„“”‘’…–—"
_SEEN: dict[tuple[str, int], tuple[str, int, str, bool]] = {}


def _word(word: str, mask: int) -> tuple[str, int, str, bool]:
    """(word without the marks at its end, its hashed index, those marks, whether in capitals), remembered per worker."""
    got = _SEEN.get((word, mask))
    if got is None:
        bare = word.rstrip(_MARKS)
        low = bare.lower()
        got = low, zlib.crc32(b"w" + low.encode("utf-8", "replace")) & mask, word[len(bare) :][-3:], len(word) > 1 and word.isupper()
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        if len(word) < 64:
            _SEEN[word, mask] = got
    return got


def features(text: str | None, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of one whole text: (indices, values).

    Words without their punctuation (damped counts, scaled to unit length) and a few facts of form as hashed symbols: how
    often words repeat, end in which punctuation, are in capitals, and how long the text is. Null or blank text has the
    length symbol only.
    """
    words = (text or "").split()
    n, mask = max(1, len(words)), (1 << bits) - 1
    counts: dict[int, int] = {}
    tails: dict[str, int] = {}
    capitals = letters = 0
    for w, c in Counter(words).items():
        low, at, tail, upper = _word(w, mask)
        if low:
            counts[at] = counts.get(at, 0) + c
        if tail:
            tails[tail] = tails.get(tail, 0) + c
        capitals += c * upper
        letters += c * len(w)
    same = sum(map(str.__eq__, words, words[1:]))
    form = {f"n{min(12, int(np.log2(n)))}": 1.0, f"u{int(8 * len(counts) / n)}": 1.0, f"s{int(8 * same / n)}": 1.0, f"c{int(8 * capitals / n)}": 1.0, f"l{min(15, int(letters / n))}": 1.0}
    form |= {f"t{t}{min(4, int(16 * c / n))}": 0.5 for t, c in tails.items() if 64 * c > n}
    damped = 1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    damped *= 2 / max(1.0, float(np.sqrt((damped**2).sum())))
    idx = [*counts, *(zlib.crc32(k.encode("utf-8", "replace")) & mask for k in form)]
    val = np.concatenate((damped, 0.5 * np.array(list(form.values()))))
    return np.array(idx, dtype=np.int32), val.astype(np.float32)


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . features - cuts[k]): one weight vector, ordered thresholds."""

    weights: np.ndarray
    cuts: np.ndarray
    bits: int


def tail_probabilities(f: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """[rows, cuts]: the probability of a grade above each cut."""
    return 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -40, 40)))


def loss_and_slopes(f: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the grades ``y``, and its slopes by each row's score and by each cut."""
    r = np.arange(len(y))
    above = np.column_stack([np.ones(len(y)), tail_probabilities(f, cuts), np.zeros(len(y))])
    p = np.maximum(above[r, y] - above[r, y + 1], 1e-9)
    slope = above * (1 - above)
    dc = np.zeros(len(cuts) + 2)
    np.add.at(dc, y, slope[r, y] / p)
    np.add.at(dc, y + 1, -slope[r, y + 1] / p)
    return float(-np.log(p).sum()), -(slope[r, y] - slope[r, y + 1]) / p, dc[1:-1]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, bits: int = 18, epochs: int = 200, rate: float = 0.08, decay: float = 1e-5) -> Model:
    """Maximum likelihood by full-batch Adam. The first cut and the logarithms of the gaps are the free parameters, which
    keeps the thresholds in order."""
    dims = 1 << bits
    w, first, gaps = np.zeros(dims), np.array([0.0]), np.zeros(max(0, grades - 2))
    if not rows:
        return Model(w, np.arange(grades - 1, dtype=float), bits)
    y = np.array([r[0] for r in rows])
    idx, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(float)
    lens = np.array([len(r[1]) for r in rows])
    starts, owner = np.concatenate(([0], np.cumsum(lens)[:-1])), np.repeat(np.arange(len(rows)), lens)
    weight = 1 / len(y)  # every rating counts the same, so that the probabilities are those of the ratings
    params = [w, first, gaps]
    mom, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    for t in range(1, epochs + 1):
        cuts = first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        _, df, dc = loss_and_slopes(np.add.reduceat(w[idx] * val, starts), cuts, y)
        df, dc = weight * df, weight * dc
        g = [np.bincount(idx, weights=df[owner] * val, minlength=dims) + decay * w, np.array([dc.sum()]), np.array([dc[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])]
        for i, (q, d) in enumerate(zip(params, g, strict=True)):
            mom[i] = 0.9 * mom[i] + 0.1 * d
            var[i] = 0.99 * var[i] + 0.01 * d * d
            q -= rate * (mom[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.99**t)) + 1e-8)
    return Model(w, first[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))), bits)


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = 12_000, bits: int = 18) -> Model:
    """Fit on at most about ``sample`` rated documents, chosen by a hash of the id. Ratings are (id, grade from 0 on);
    null ids or grades are left out, and of several ratings of a document the lowest counts. Of rows that repeat a rated id
    one is a sample, the one whose text has the least hash; it is chosen in the tasks. The model is the same whatever order the rows come in. Without a rating every
    document gets the same grade. Other columns are ignored. The chosen ratings, whose number is bounded, are broadcast, so
    that no text is shuffled."""
    r = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("_rid")).agg(F.min(grade_col).cast("int").alias("_g"))
    n = r.count()
    if n > sample:
        r = r.where(F.xxhash64("_rid", F.lit(5)) < int(sample / n * 2**64) - 2**63)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(r), F.col("_id") == F.col("_rid")).select("_g", "_t", "_rid", F.xxhash64("_t").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs = [features(t.as_py(), bits) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tobytes() for i, _ in fs], pa.binary()), pa.array([v.tobytes() for _, v in fs], pa.binary()), b.column(2), b.column(3)], names=["g", "i", "v", "id", "h"])

    made = joined.withColumn("_rid", F.col("_rid").cast("string")).mapInArrow(run, "g int, i binary, v binary, id string, h long")
    rows = made.groupBy("id").agg(F.min_by(F.struct("g", "i", "v"), "h").alias("x")).select("x.*").collect()
    data = [(min(grades - 1, max(0, x["g"])), np.frombuffer(x["i"], dtype=np.int32), np.frombuffer(x["v"], dtype=np.float32)) for x in rows]
    data.sort(key=lambda x: (x[0], x[1].tobytes()))  # the same model whatever order the rows came in
    return fit(data, grades, bits)


def grade(docs: DataFrame, model: Model, text_col: str = "text", min_grade: float = 1.5, min_tail: float = 0.5) -> DataFrame:
    """Adds expected_grade, p_1, p_2, ... (the tail probabilities of grade 1 or more, 2 or more, ...) and kept.

    A document is kept when its expected grade is ``min_grade`` or more and its probability of the best grade ``min_tail``
    or more. Null, empty and blank texts are graded by their length alone and never kept. Whole texts are read, equal
    texts get equal grades, other columns pass through (but for columns of these names, which are replaced), empty tables
    stay empty.
    """
    k = len(model.cuts)
    tails = [f"p_{i + 1}" for i in range(k)]
    docs = docs.drop(*({"expected_grade", "kept", *tails} - {text_col}))
    schema = docs.select("*", F.lit(0.0).alias("expected_grade"), *[F.lit(0.0).alias(t) for t in tails], F.lit(True).alias("kept")).schema
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for b in batches:
            f, blank = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            for j, t in enumerate(b.column(at)):
                text = t.as_py()
                i, v = features(text, model.bits)
                f[j], blank[j] = float(w[i] @ v), not (text or "").strip()
            p = tail_probabilities(f, cuts)
            mean = p.sum(axis=1)
            kept = (mean >= min_grade) & (p[:, -1] >= min_tail) & ~blank
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean), *[pa.array(p[:, i].copy()) for i in range(k)], pa.array(kept)], names=schema.names)

    return docs.mapInArrow(run, schema)
