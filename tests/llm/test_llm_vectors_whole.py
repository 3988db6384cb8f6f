"""Operator 5: the graph is found by refinement, links are counted whole, and the audit sees what is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferry.llm import embeddings


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def counts(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for lo in range(0, len(u), 2048):
        s = u[lo : lo + 2048] @ u.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -1
        out.append((s >= threshold).sum(axis=1))
    return np.concatenate(out)


def planted(rng, n, pairs, groups=()):
    x = rng.normal(size=(n, 64))
    twins = []
    for c in np.linspace(0.905, 0.99, pairs):
        a = x[rng.integers(n)]
        a = a / np.linalg.norm(a)
        r = rng.normal(size=64)
        r -= a * (r @ a)
        twins.append(c * a + np.sqrt(1 - c * c) * r / np.linalg.norm(r))
    near = [rng.normal(size=64) + 0.3 * rng.normal(size=(m, 64)) for m in groups]
    return np.concatenate([x, np.array(twins), *near])


def test_groups_of_every_size_keep_their_links(spark, scratch):
    rng = np.random.default_rng(11)
    x = [rng.normal(size=(600, 64))]
    for size in [30] * 12 + [150]:
        x.append(rng.normal(size=64) + rng.uniform(0.2, 0.4, size=(size, 1)) * rng.normal(size=(size, 64)))
    x = np.concatenate(x)
    want = counts(x)
    got, recall = embeddings.near_vectors(table(spark, x).toDF("vec_id", "embedding"), scratch)
    have = {r["vec_id"]: r["n_links"] for r in got.collect()}
    have = np.array([have[i] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.995 * want.sum() and set(recall) == {"small", "large"} and min(recall.values()) >= 0.95


def test_refinement_and_not_the_seeds_finds_planted_pairs(spark, scratch):
    x = planted(np.random.default_rng(5), 20_000, 400)
    nodes = scratch.save(embeddings.sketches(table(spark, x)).withColumn("comp", F.col("id")), "nodes")
    limit = embeddings.limit_bits(0.9)
    seeds = scratch.save(embeddings.seed_lists(nodes, len(x), range(2), 20), "seeds")

    def found(lists):
        near = lists.where(f"d <= {limit}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return embeddings.verified(near, table(spark, x), 0.9).count()

    first = found(seeds)
    last = found(embeddings.refine(seeds, nodes, limit, 20, scratch, "r"))
    truth = int(counts(x).sum()) // 2
    assert truth >= 400 and first < 0.75 * truth and last >= 0.95 * truth


def test_a_dense_group_in_two_halves_is_one_component(spark, scratch):
    """Lists of twenty neighbours saturate within either half; the enlarged lists find the links between the halves."""
    rng = np.random.default_rng(9)
    centre, off = rng.normal(size=64), rng.normal(size=64)
    x = np.concatenate([centre + s * 0.14 * off + 0.12 * rng.normal(size=(150, 64)) for s in (-1, 1)])
    want = counts(x)
    got, _ = embeddings.near_vectors(table(spark, x).toDF("vec_id", "embedding"), scratch)
    rows = got.collect()
    assert want.min() > 20 and {r["component_id"] for r in rows} == {0} and all(r["n_links"] == want[r["vec_id"]] for r in rows)


def test_links_are_counted_over_blocks_with_weights(spark, scratch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=64) + 0.35 * rng.normal(size=(n, 64)) for n in (90, 1, 7)])
    comp = np.repeat([0, 90, 91], [90, 1, 7])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    weight = 1 + np.arange(len(x)) % 3
    s = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool) & (comp[:, None] == comp[None, :])
    rows = [(int(comp[i]), i, int(weight[i]), x[i].tolist()) for i in range(len(x))]
    got = embeddings.count_links(spark.createDataFrame(rows, "comp long, id long, n long, v array<double>"), 0.9, block=16)
    assert {r["id"]: r["others"] for r in got.collect()} == dict(enumerate((s @ weight).tolist()))


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=64) + 0.1 * rng.normal(size=(n, 64)) for n in [200] + [3] * 10])
    want = counts(x)
    rows = [(i, 1, v.tolist(), int(want[i])) for i, v in enumerate(x)]
    schema = "id long, n long, v array<double>, others long"
    assert embeddings.audit(spark.createDataFrame(rows, schema), 0.9, 10, 500, 0) == {"small": 1.0, "large": 1.0}
    lost = [(i, n, v, c if i < 200 else c // 2) for i, n, v, c in rows]
    recall = embeddings.audit(spark.createDataFrame(lost, schema), 0.9, 10, 500, 0)
    assert recall["large"] == 1 and recall["small"] == 0.5


def test_a_search_that_stays_below_the_recall_is_an_error(spark, scratch, monkeypatch):
    none = spark.createDataFrame([], "id long, others long")
    monkeypatch.setattr(embeddings, "count_links", lambda *a, **k: none)
    x = np.random.default_rng(1).normal(size=16) + 0.05 * np.random.default_rng(2).normal(size=(12, 16))
    with pytest.raises(RuntimeError, match="recall of links"):
        embeddings.near_vectors(table(spark, x).toDF("vec_id", "embedding"), scratch, max_extra=0)


def test_rows_without_id_and_vectors_of_several_lengths(spark, scratch):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (None, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (None, None)]
    got, _ = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch)
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in got.collect()) == [(-1, 0, -1), (-1, 0, -1), (-1, 2, 4), (4, 2, 4), (5, 2, 4), (6, 1, 6), (7, 1, 6)]
