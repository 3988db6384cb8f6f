"""Exact k-means on integers: nearest centroids by progressive search over Walsh-Hadamard coefficients."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferry.llm.text import veiled
from ferry.plans.scratch import Scratch

LIMB = 45
#: Coefficients compared before each elimination.
LEVELS = (4, 8, 16, 32, 64)


def coarse_first(dims: int) -> np.ndarray:
    """Places of the coefficients of :func:`transformed` by their number of sign changes, the mean first."""
    bits = dims.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(dims)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coarse coefficients first, in exact integers.

    Sums and differences only, so that squared distances of transforms are ``dims`` times those of the rows.
    """
    n, dims = x.shape
    y, half = x.copy(), 1
    while half < dims:
        y = y.reshape(n, -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, dims)
        half *= 2
    return y[:, coarse_first(dims)]


def nearest(vectors: np.ndarray, centroids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each row, the smaller number of equals; squared distance; coefficient differences formed).

    Differences are accumulated coarse to fine. After each level the centroid that leads is finished: its distance bounds
    the least one, and centroids whose sum is already greater, strictly, are left out. Those that remain at the end have
    all their coefficients and are compared whole.
    """
    # A sum of squared differences of coefficients is at most 4 dims^3 m^2: beyond 63 bits Python's integers are taken.
    if max((int(abs(a).max()) for a in (vectors, centroids) if a.size), default=0) >= math.isqrt((1 << 61) // vectors.shape[1] ** 3):
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    v, c = transformed(vectors), transformed(centroids)
    n, k, dims = len(v), len(c), v.shape[1]
    row, col = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, v.dtype)
    start, used, lo = np.arange(n) * k, 0, 0
    for hi in [h for h in levels if h < dims] + [dims]:
        d = v[row, lo:hi] - c[col, lo:hi]
        total = total + (d * d).sum(axis=1)
        used, lo = used + d.size, hi
        if hi == dims:
            break
        least = np.minimum.reduceat(total, start)
        lead = np.flatnonzero(total == np.repeat(least, np.diff(np.append(start, len(row)))))
        lead = lead[np.diff(row[lead], prepend=-1) > 0]
        rest = v[:, hi:] - c[col[lead], hi:]
        bound = least + (rest * rest).sum(axis=1)
        stays = np.flatnonzero((total <= bound[row]).astype(bool))
        row, col, total, used = row[stays], col[stays], total[stays], used + rest.size
        start = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, start)
    lead = np.flatnonzero(total == np.repeat(least, np.diff(np.append(start, len(row)))))
    lead = lead[np.diff(row[lead], prepend=-1) > 0]
    return col[lead], least // dims, used


def integers(col: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; Python's integers where one does not fit 53 bits."""
    x = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, dims)
    if x.size and np.abs(x).max() >= 1 << 52:
        return np.array([[int(v) for v in r] for r in x.tolist()], object)
    return x.astype(np.int64)


def kept_vectors(df: DataFrame, dims: int = 64, scale: int = 64, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dims`` components, none null or non-finite, nor so large that ``scale`` times it is."""
    x = F.col(vec_col)

    def good(v):
        wide = v.cast("double") * scale
        return v.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))

    return df.where(x.isNotNull() & (F.size(x) == dims) & F.forall(x, good))


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << LIMB) <= total < 1 << LIMB:
        yield k, total & ((1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1
    yield k, total


def centroid_sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """(vectors, component sums) of each centroid that is nearest to some vector.

    A batch gives one row for each of its centroids, component and limb of 45 bits of the sum, so that sums of any size
    are exact; the batches of a task are added up before the exchange. What comes back has at most clusters x components x
    limbs rows.
    """
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(0), dims, scale)
            out = []
            if len(x):
                near = nearest(x, centroids)[0]
                for c in np.unique(near).tolist():
                    own = x[near == c]
                    out.append((c, -1, 0, len(own)))
                    out += [(c, j, k, v) for j, s in enumerate(own.sum(axis=0).tolist()) for k, v in _limbs(s)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cluster", "component", "limb", "value"])

    got = rows.mapInArrow(run, "cluster long, component long, limb long, value long").groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    count: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for c, j, k, v in got.collect():
        if j < 0:
            count[c] = int(v)
        else:
            sums.setdefault(c, [0] * dims)[j] += int(v) << (LIMB * k)
    return count, sums


def first_centroids(df: DataFrame, k: int, dims: int, scale: int, seed: int, id_col: str, vec_col: str) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id, as integers; of equal ids the smaller vector counts."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    got = df.select(name.alias("h"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return np.array([[int(np.floor(scale * x)) for x in r["v"]] for r in got], object).reshape(-1, dims)


def narrowed(centroids: np.ndarray) -> np.ndarray:
    small = not centroids.size or max(abs(v) for v in centroids.ravel().tolist()) < 1 << 52
    return centroids.astype(np.int64) if small else centroids


def cluster(
    df: DataFrame, scratch: Scratch, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(assigned, centroids): rows that hold a whole vector with ``cluster`` int and ``distance`` (squared, in units of
    1/scale), and the centroids after ``rounds`` rounds. ``dims`` is a power of two.

    Components are taken as floor(scale * x). Centroids start as the vectors with the smallest hashes; each round assigns
    every vector to the nearest one (the smaller number of equals) and replaces a centroid by the floor of its vectors'
    mean; one without vectors stays. A table with fewer than ``k`` vectors has as many centroids, without vectors none and
    no rows. Vectors that are null, of another length, or hold null or non-finite components are left out. Repeated rows
    and null ids count each. A distance beyond a long is null. Columns may have any name; new ones replace their like.
    """
    if dims & (dims - 1):
        raise ValueError("dims has to be a power of two")
    rows, names = veiled(df.drop("cluster", "distance"))
    back = {v: n for n, v in names.items()}
    rows = kept_vectors(rows, dims, scale, names[vec_col])
    centroids = narrowed(first_centroids(rows, k, dims, scale, seed, names[id_col], names[vec_col]))
    for _ in range(rounds if len(centroids) else 0):
        count, sums = centroid_sums(rows.select(names[vec_col]), centroids, scale)
        centroids = narrowed(np.array([[s // count[c] for s in sums[c]] if c in sums else centroids[c].tolist() for c in range(len(centroids))], object))
    columns, final = rows.columns, centroids
    at = columns.index(names[vec_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, far, _ = nearest(integers(batch.column(at), dims, scale), final)
                far = [None if d >= 1 << 63 else d for d in far.tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far, pa.int64())], names=[*columns, "__cluster", "__distance"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__cluster", T.IntegerType()), T.StructField("__distance", T.LongType())]))
    out = out.select(*[F.col(c).alias(back[c]) for c in columns], F.col("__cluster").alias("cluster"), F.col("__distance").alias("distance"))
    return out, final


def with_inertia(assigned: DataFrame, centroids: np.ndarray, scratch: Scratch) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; written once and read twice. A sum beyond a long, or
    of a distance beyond one, is null."""
    held = scratch.save(assigned, "assigned")
    whole = F.count("*") == F.count("distance")
    sums = held.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    every = sum(int(r["s"]) for r in sums) if all(r["s"] is not None for r in sums) else None

    def long(s):
        return int(s) if s is not None and s < 1 << 63 else None

    own = {r["cluster"]: r["s"] for r in sums}
    told = [(c, long(own.get(c)), ",".join(map(str, v))) for c, v in enumerate(centroids.tolist())]
    small = held.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, at string").select("cluster", "cluster_inertia", F.lit(long(every)).cast("long").alias("inertia"), F.sha2("at", 256).alias("centroid_sha256"))
    return held.join(F.broadcast(small), "cluster")
