"""Centroid clustering, SentencePiece coding and the alignment of two tokenizers against plain Python and the libraries."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferry.llm import alignment, clusters, pieces
from ferry.llm import queries as Q

DATA = "/root/testdata/sf0.001"
EDGES = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "▁ kept as space", "naïve 中文。日本語 😀\x00", "<|endoftext|> <s> <0x41>", "abcabcabc" * 40, "x" * 3000, " " * 3000, "a b"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- op11


def floors(v):
    return [math.floor(64 * float(x)) for x in v]


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, floors(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: sha(f"1:{r[0]}"))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        got = [[] for _ in cs]
        for _, v in kept:
            got[near(v)[1]].append(v)
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(got, cs, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, c, d in out:
        own[c] += d
    return sorted((i, c, d, own[c], sum(own.values()), sha(",".join(map(str, cs[c])))) for i, c, d in out)


def clustered(spark, rows, scratch, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = clusters.with_inertia(*clusters.cluster(df, scratch), scratch)
    return sorted(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_of_the_query_equal_brute_force(spark):
    got = Q.op11_centroid_clustering(spark, DATA)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_clusters(rows)


def test_clusters_with_ties_gaps_and_repeats(spark, scratch):
    rng = np.random.default_rng(2)
    grid = [(i, rng.integers(-2, 3, 64).astype(float).tolist()) for i in range(60)]
    same = [(100 + i, [0.5] * 64) for i in range(80)]
    odd = [(200, None), (201, [1.0] * 63), (202, [math.nan] + [0.0] * 63), (203, [math.inf] + [0.0] * 63), (204, [None] + [0.0] * 63), (205, [])]
    rows = grid + same + odd + [(7, grid[7][1])]
    assert clustered(spark, rows, scratch) == plain_clusters(rows)


def test_few_vectors_none_and_clashing_names(spark, scratch):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(spark, rows, scratch) == plain_clusters(rows)
    assert clustered(spark, [], scratch) == [] and clustered(spark, [(1, None)], scratch) == []
    df = spark.createDataFrame([(1, [0.0] * 64, 9, "x")], "vec_id long, embedding array<double>, cluster int, limb string")
    got, _ = clusters.cluster(df, scratch)
    assert [(r.vec_id, r.limb, r.cluster, r.distance) for r in got.collect()] == [(1, "x", 0, 0)]


def test_components_beyond_machine_integers_stay_exact(spark, scratch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 1e3).tolist()) for i in range(30)] + [(30 + i, (rng.normal(size=64) * 3e5).tolist()) for i in range(30)]
    assert clustered(spark, rows, scratch) == plain_clusters(rows)
    huge = rows + [(90 + i, (rng.normal(size=64) * 1e30).tolist()) for i in range(20)]
    want = plain_clusters(huge)
    top = 1 << 63
    lost = {c for _, c, d, *_ in want if d >= top}
    assert lost and clustered(spark, huge, scratch) == sorted(
        ((i, c, d if d < top else None, s if c not in lost and s < top else None, None, h) for i, c, d, s, _, h in want), key=lambda r: r[0]
    )


def test_transform_is_hadamard_and_search_leaves_only_worse_centroids_out():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (40, 64))
    h = np.array([[1]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    assert (clusters.transformed(x) == x @ h[np.argsort(changes)].T).all()
    smooth = np.cumsum(x, axis=1)
    for y, share in ((x, 1), (smooth, 0.6)):
        c = y[rng.integers(0, 40, 16)]
        want = ((y[:, None] - c[None]) ** 2).sum(axis=2)
        near, far, used = clusters.nearest(y, c)
        assert (near == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all() and used < share * len(y) * 16 * 64


# ---- op12


def test_whole_texts_encode_and_decode_as_the_library_does(spark):
    lib = pieces.vocabulary(Q.piece_model()).lib
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op12_sentencepiece(spark, DATA).collect()}
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in texts.items() for ids in [lib.encode(t)]}
    assert got == want


def test_edge_texts_extra_columns_and_bad_ids(spark):
    lib = pieces.vocabulary(Q.piece_model()).lib
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(EDGES)] + [(None, "a b", "k")], "doc_id long, text string, ids string")
    coded = pieces.encode(df, Q.piece_model())
    rows = pieces.decode(coded.withColumn("decoded", F.lit(1)).withColumn("__0", F.lit(2)), Q.piece_model()).collect()
    got = {r.doc_id: (list(r.ids), r.decoded, r["__0"]) for r in rows}
    for i, t in enumerate(EDGES):
        assert got[i] == (lib.encode(t or ""), lib.decode(lib.encode(t or "")), 2)
    assert got[None][0] == lib.encode("a b")
    odd = spark.createDataFrame([(1, None), (2, [40_000]), (3, [1, 264, 3]), (4, [232, 233, 264]), (5, [])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, Q.piece_model()).orderBy("k").collect()] == [None, None, lib.decode([1, 264, 3]), lib.decode([232, 233, 264]), ""]
    assert pieces.decode(pieces.encode(df.limit(0), Q.piece_model()), Q.piece_model()).count() == 0


def test_rounds_and_single_merges_agree_with_the_library_on_repeated_pieces():
    v = pieces.vocabulary(Q.piece_model())
    rng = random.Random(3)
    pool = [t for i, t in enumerate(v.text) if i > 300]
    words = []
    for _ in range(1500):
        unit = "".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 3]))).replace("▁", "")[: rng.choice([3, 5, 9, 20])]
        words.append("▁" + unit * rng.choice([1, 2, 3, 9]))
    words += ["▁" * n for n in (1, 2, 15, 16, 17, 33, 200)]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    by_rounds = v.merged(v.of_char[codes], size, rounds=10**9)
    one_by_one = v.merged(v.of_char[codes], size, rounds=0)
    assert (by_rounds[0] == one_by_one[0]).all() and (by_rounds[1] == one_by_one[1]).all()
    ids, counts = v.words_to_ids(words)
    at = pieces.offsets(counts)
    assert all(v.lib.encode(w[1:].replace("▁", " ")) == ids[a:b].tolist() for w, a, b in zip(words, at[:-1], at[1:], strict=True) if w != "▁")


def test_long_words_take_seconds():
    v = pieces.vocabulary(Q.piece_model())
    rng = random.Random(5)
    texts = [" " * 100_000, "a" * 100_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))]
    ids, counts = v.encode(texts)
    at = pieces.offsets(counts)
    assert all(v.lib.encode(t) == ids[a:b].tolist() for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


def test_random_ids_decode_as_the_library_does():
    v = pieces.vocabulary(Q.piece_model())
    rng = random.Random(8)
    rows = [[rng.choice([rng.randrange(32_000), rng.randrange(260), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 7))] for _ in range(2000)]
    flat = np.array([i for r in rows for i in r])
    assert v.decode(flat, np.array([len(r) for r in rows])).to_pylist() == [v.lib.decode(r) for r in rows]


# ---- op13


def plain_alignment(texts):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(str(public.path("byte_bpe_50k.json"))), pieces.vocabulary(Q.piece_model()).lib
    a_lib.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    entry = {i: t for t, i in a_lib.get_vocab().items()}
    docs, counts = {}, Counter()
    for key, text in texts.items():
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_bytes = [bytes(of_char[c] for c in entry[i]) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs[key] = None
            continue
        a_end, b_end = np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()
        links = [(a[i], b[b_end.index(e)]) for i, e in enumerate(a_end) if e in set(b_end)]
        counts.update(links)
        groups, lo = [], 0
        for hi in sorted(set(a_end) & set(b_end)):
            groups.append(",".join(str(x) for x, e in zip(a, a_end, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, b_end, strict=True) if lo < e <= hi))
            lo = hi
        docs[key] = (len(a), len(b), len(groups), links, sha(";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return {
        k: (0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for k, d in docs.items()
    }


def aligned(spark, df, scratch):
    both = (*Q.tokenizer(), Q.piece_model())
    rows = alignment.align(df, *both).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    got = alignment.weigh(rows, scratch, *both)
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()}


def test_alignment_of_the_query_equals_brute_force(spark):
    texts = {r.doc_id: (r.text or "")[:3000] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from ferry.plans.scratch import Scratch

    assert aligned(spark, df, Scratch(spark, "t13")) == plain_alignment(texts)
    got = Q.op13_tokenizer_alignment(spark, DATA)
    whole = {r.doc_id: len(r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in got.collect()} == whole.keys()


def test_alignment_of_edge_texts(spark, scratch):
    texts = dict(enumerate(EDGES)) | {None: "one two", 50: "one two"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, links int, pair int")
    got = aligned(spark, df, scratch)
    assert got == plain_alignment(texts) and got[5] == (0, 0, 0, 0, 0, 0, "")
    assert aligned(spark, df.limit(0), scratch) == {}


def test_products_equal_dense_ones_in_blocks_of_any_size():
    rng = np.random.default_rng(0)

    def matrix(n, m, p):
        d = rng.random((n, m)) < p
        return d.astype(int), alignment.Csr(pieces.offsets(d.sum(axis=1)), np.nonzero(d)[1], m)

    for block in (1, 7, 1 << 20):
        (x, a), (y, b) = matrix(9, 13, 0.3), matrix(11, 13, 0.2)
        got = np.zeros((9, 11), int)
        for r, c, v in alignment.product(a, b.transposed(), block):
            got[r, c] += v
        assert (got == x @ y.T).all()


def test_links_as_rows(spark):
    both = (*Q.tokenizer(), Q.piece_model())
    text = "the internationalisation naïve 😀 12345"
    df = spark.createDataFrame([(1, "hello there"), (2, text), (3, None)], "doc_id long, text string")
    t = alignment.tables(*both)
    a, b = t.enc.encode_ordinary(" " + text), t.pieces.lib.encode(text)
    a_at, b_at = pieces.offsets(t.a_size[a]), pieces.offsets(t.b_size[b])
    got = {k: {(r.a_token, r.b_token, r.weight) for r in alignment.linked_tokens(df, *both, kind=k).where("doc_id = 2").collect()} for k in ("overlap", "end", "shared")}
    share = {(i, j, int(min(a_at[i + 1], b_at[j + 1]) - max(a_at[i], b_at[j]))) for i in range(len(a)) for j in range(len(b))}
    assert got["overlap"] == {s for s in share if s[2] > 0}
    assert {s[:2] for s in got["end"]} == {(i, j) for i, j, _ in share if a_at[i + 1] == b_at[j + 1]}
    cuts = sorted(set(a_at[1:].tolist()) & set(b_at[1:].tolist()))
    group = [np.searchsorted(cuts, e[1:]) for e in (a_at, b_at)]
    assert got["shared"] == {(i, j, 1) for i in range(len(a)) for j in range(len(b)) if group[0][i] == group[1][j]}
    row = alignment.align(df, *both).where("doc_id = 2").first()
    assert row.n_shared == len(got["shared"]) and row.n_links == len(got["end"])
    with pytest.raises(ValueError):
        alignment.linked_tokens(df, *both, kind="other")
