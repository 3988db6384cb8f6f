"""Exact and near-duplicates, vectors, mixing, chat and WARC against brute force."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ferry.llm import chat, embeddings, exact_dedup, mixing, simhash, warc
from ferry.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, scratch, shape):
    rng = random.Random(2)
    links = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(40)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "none": []}[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = smallest({x for a, b in links if a != b for x in (a, b)}, [(a, b) for a, b in links if a != b])
    assert got == want


ODD = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 100_000), (9, "X" * 100_000), (10, "x" * 99_999 + "y"), (2, "sAME"), (11, "unique"), (None, "same")]


@pytest.mark.parametrize("bits", [None, 64])
def test_exact_dedup(spark, scratch, monkeypatch, bits):
    if bits:  # maps in which nearly everything collides change nothing
        monkeypatch.setattr(exact_dedup, "LENGTH_BITS", bits)
        monkeypatch.setattr(exact_dedup, "PREFIX_BITS", bits)
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in ODD], "doc_id long, text string, keep_id long, kept boolean")
    got = exact_dedup.exact_dedup(docs, scratch).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[(t or "").translate(ASCII)].append(i)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    stay = exact_dedup.drop_exact_duplicates(docs, scratch)
    assert stay.columns == docs.columns and Counter(r["doc_id"] for r in stay.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(docs.limit(0), scratch).count() == 0


def test_each_step_of_exact_dedup_reads_what_the_one_before_left(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["text"] or "") for r in docs.collect()]
    sizes = Counter(len(t.encode()) for t in texts)
    heads = Counter((len(t.encode()), t[:256].translate(ASCII)) for t in texts)
    step = exact_dedup.Refinement(docs, "text", 256, scratch)
    lengths, prefixes, full = docs.select(step.alike_length.alias("a"), step.alike_prefix.alias("b"), step.full.alias("c")).selectExpr("count_if(a)", "count_if(b)", "count(c)").first()
    assert lengths == sum(n for n in sizes.values() if n > 1) < len(texts)
    assert prefixes == full == sum(n for n in heads.values() if n > 1) < lengths


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(ASCII)).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    ids = list(prints)
    v = np.array([prints[i] for i in ids], dtype=np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(v)) for j in np.nonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3)[0] + i + 1]
    return smallest(ids, links)


def test_simhash_on_documents(spark):
    from __spark_entry__ import queries

    got = {r["doc_id"]: r for r in queries()["op8_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_groups(prints)


@pytest.mark.parametrize("bucket", [512, 16])
def test_simhash_links_connect_what_brute_force_connects(spark, scratch, bucket):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            p = base
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, scratch, bucket=bucket).collect()]
    back = {s: p for p, s in signed.items()}
    assert all((back[a] ^ back[b]).bit_count() <= 3 for a, b in links)
    assert smallest(prints, [(back[a], back[b]) for a, b in links]) == brute_groups({p: p for p in prints})


def test_simhash_edge_cases(spark, scratch):
    rows = [(5, None), (3, ""), (4, " \n"), (1, "one"), (2, "ONE"), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (8, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp long")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs, scratch).collect())
    assert got == Counter({(5, 3): 1, (3, 3): 1, (4, 3): 1, (1, 1): 1, (2, 1): 1, (9, 9): 2, (None, 9): 1, (8, 8): 1})
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near_duplicates(docs, scratch).collect()) == [0, 1, 3, 8, 9, 9]
    assert simhash.simhash_groups(docs.limit(0), scratch).count() == 0


def test_all_pairs_of_a_bucket_count(spark, scratch):
    # many families of texts around one long common part share buckets, and most are near to none of a bucket's two ends
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"w{i}" for i in range(5_000)])
    common, texts = list(rng.choice(vocabulary, 200)), []
    for _ in range(40):
        own = list(rng.choice(vocabulary, 200))
        for _ in range(5):
            words = common + own
            words[int(rng.integers(400))] = "x"
            texts.append((len(texts), " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words, width, wipe, most = simhash.wide_plan(len(texts), 0.8, 0.97)
    prints = simhash.wide_index(df, words, width, wipe).cache()
    fps = {r["id"]: np.array(r["fp"], dtype=np.int64).view(np.uint64) for r in prints.collect()}
    buckets = {}
    for r in simhash.wide_variants(prints, width, wipe).collect():
        buckets.setdefault(r["key"], set()).add(r["id"])
    near = {(a, b) for m in buckets.values() for a in m for b in m if a < b and np.bitwise_count(fps[a] ^ fps[b]).sum() <= most}

    def groups(links):
        of = {i: i for i in fps}
        for _ in of:
            before = dict(of)
            for a, b in links:
                of[a] = of[b] = min(of[a], of[b])
            if of == before:
                break
        return of

    for options in ({}, {"few": 4, "block": 16, "work": 1}):
        got = {(r["a"], r["b"]) for r in simhash.similar_links(df, scratch, **options).collect()}
        assert got <= near and groups(got) == groups(near)


def test_pairs_away_from_the_ends_of_a_bucket_are_linked(spark, scratch, monkeypatch):
    # ten pairs of equal texts, all in one bucket: its two ends meet at most two of them
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "wide_variants", lambda prints, *_: prints.select("id", F.lit(0).cast("long").alias("key")))
    df = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(50))) for i in range(20)], "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in simhash.similar_links(df, scratch).collect()} == {(2 * i, 2 * i + 1) for i in range(10)}


def test_forest_of_different_components_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (12, 4)).astype(np.uint64)
    fps = base[rng.integers(0, 12, 60)] ^ (np.uint64(1) << rng.integers(0, 64, (60, 4)).astype(np.uint64))
    comps = rng.integers(0, 40, 60)
    got = simhash._wide_forest(fps, comps, 6)
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    assert all(d[i, j] <= 6 and comps[i] != comps[j] for i, j in got)

    def closed(pairs):
        reach = comps[:, None] == comps[None]
        for i, j in pairs:
            reach[i, j] = reach[j, i] = True
        for k in range(60):
            reach |= reach[:, [k]] & reach[[k]]
        return reach

    assert (closed(got) == closed(np.argwhere(d <= 6))).all() and len(got) < 40


def test_similar_texts_against_brute_force(spark, scratch):
    """Of the pairs of texts whose five-word shingles are alike by 0.8 or more nearly all share a group; no group joins
    texts that are not alike."""
    rows, rng, vocabulary = [], random.Random(6), [f"w{i}" for i in range(3000)]
    for g in range(60):
        base = rng.choices(vocabulary, k=rng.choice([60, 150, 600]))
        for c in range(3 if g else 200):
            text = list(base)
            for _ in range(max(1, len(base) // 100)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((100_000 + 1000 * g + c, " ".join(text)))
    rows += [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, " "), (6, "long " * 100_000), (7, "LONG " * 100_000), (8, "a b c d e f"), (8, "q r s t u v"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp long")
    held = {r["doc_id"]: r["text"] for r in df.where("doc_id >= 100000").collect()}
    grams = {i: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in held.items()}
    pairs = [(a, b) for a in grams for b in grams if a < b and a // 1000 == b // 1000 and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    comp = {r["node"]: r["component"] for r in components(simhash.similar_links(df, scratch), scratch).collect()}
    together = sum(comp.get(a, a) == comp.get(b, b) for a, b in pairs)
    assert len(pairs) > 1000 and together >= 0.9 * len(pairs)
    assert all(i // 1000 == c // 1000 for i, c in comp.items() if i >= 100_000)
    stay = Counter(r["doc_id"] for r in simhash.drop_similar(df, scratch).collect() if r["doc_id"] is None or r["doc_id"] < 9)
    assert stay == Counter({None: 2, 1: 1, 3: 1, 6: 1, 8: 2})
    assert simhash.drop_similar(df.limit(0), scratch).count() == 0


@pytest.mark.parametrize(("text", "words"), [("a b c d e f g a b c d e", 16), ("x", 16), ("é " * 600 + "tail", 17)])
def test_wide_fingerprints_are_majorities_over_distinct_shingles(text, words):
    got, tip = simhash.wide_fingerprint(text, words)
    t = text.split()
    grams = {" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    lanes = simhash._lanes(np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], dtype=np.uint64), words)
    ones = [sum(int(row[b // 64]) >> (b % 64) & 1 for row in lanes) for b in range(64 * words)]
    assert [int(got[b // 64]) >> (b % 64) & 1 for b in range(64 * words)] == [2 * o > len(grams) for o in ones]
    assert tip.tolist() == [abs(2 * o - len(grams)) for o in ones]


def brute_vectors(rows):
    good = {i: np.array(v, dtype=float) for i, v in rows.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    n = Counter(x for p in links for x in p)
    return {i: (n[i], c) for i, c in smallest(rows, links).items()}


def test_vectors_on_test_data(spark):
    from __spark_entry__ import queries

    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries()["op5_embedding_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    want = brute_vectors(rows)
    assert all(g[0] <= want[i][0] for i, g in got.items())
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_vectors_with_a_large_group_and_odd_rows(spark, scratch):
    rng = np.random.default_rng(6)
    rows = {i: rng.normal(size=16).tolist() for i in range(300)}
    centre = rng.normal(size=16)
    rows |= {1000 + i: (centre + 0.05 * rng.normal(size=16)).tolist() for i in range(120)}
    rows |= {2000 + i: rows[7] for i in range(50)}
    rows |= {3000: None, 3001: [], 3002: [0.0] * 16, 3003: [None] + [1.0] * 15, 3004: [float("nan")] * 16, 3005: [float("inf")] + [1.0] * 15, 3006: [1.0, 2.0], 3007: [2.0, 4.0], 3008: [1e300, 2e300]}
    df = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, scratch)[0].collect()}
    want = brute_vectors({i: v for i, v in rows.items() if i != 3008})
    want[3006], want[3007], want[3008] = (2, 3006), (2, 3006), (2, 3006)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i] == want[i] for i in range(3000, 3009))
    assert embeddings.near_vectors(df.limit(0), scratch)[0].count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (goal - sum(full.values())) / (sum(w[s] for s in rest) or 1)
        over = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def mixed(df, scratch):
    rows = mixing.mix(df, scratch).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for s in want:
        assert abs(want[s] - target[s]) <= 1e-6 * max(1, want[s])
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    return rows, taken, want


def test_mixing_on_documents(spark, scratch):
    rows, taken, want = mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), scratch)
    assert len(rows) == 1000 and all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 10 for s in want)
    again, *_ = mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7), scratch)
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in again}


def test_mixing_edge_cases(spark, scratch):
    rows = [(i, "a", "w " * (1 + i % 9)) for i in range(300)] + [(1000 + i, "b", "same words here") for i in range(200)] + [(2000, None, "null source"), (2001, "c", None), (2002, "c", ""), (2003, "é", "x"), (0, "a", "w " * 5), (0, "a", "w " * 5), (None, "b", "z z")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, target double")
    got, taken, want = mixed(df, scratch)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 5 for s in want)
    mix = mixing.take_mix(df, scratch)
    assert mix.columns == df.columns and abs(mix.count() - sum(r["copies"] for r in got)) <= 2
    assert mixing.mix(df.limit(0), scratch).count() == 0 and mixing.take_mix(df.limit(0), scratch).count() == 0


def test_mixing_rates_are_the_tilt_of_a_plain_dual_solution(spark, scratch):
    rng = random.Random(5)
    rows = [(i, "abcd"[i % 4], rng.randint(1, 400)) for i in range(8000)]  # a and d are full, b and c tilted up and down
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got, _, want = mixed(df, scratch)
    copies = {r["doc_id"]: r["copies"] for r in got}
    for source in "bc":
        sizes = np.array([n for _, s, n in rows if s == source], dtype=float)
        taken = np.array([copies[i] for i, s, _ in rows if s == source])
        mean, lo, hi = (sizes**2).sum() / sizes.sum(), -50.0, 50.0
        for _ in range(200):
            tilt = (lo + hi) / 2
            lo, hi = (tilt, hi) if (sizes * np.minimum(2, np.exp(tilt * sizes / mean))).sum() < want[source] else (lo, tilt)
        rate = np.minimum(2, np.exp(tilt * sizes / mean))
        for a in range(0, 400, 50):
            inside = (sizes > a) & (sizes <= a + 50)
            assert abs(taken[inside].mean() - rate[inside].mean()) < 0.03
        assert abs(tilt) > 0.01


def test_mixing_tells_when_a_tilt_is_not_found(spark, scratch):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 50)) for i in range(200)], "doc_id long, source string, text string")
    hist = df.selectExpr("source", "cast(1 + doc_id % 50 as long) as size").groupBy("source", "size").count().withColumnRenamed("count", "n")
    sources = mixing._targets(hist, (5, 2, 1), 1.5, 2.0)
    with pytest.raises(RuntimeError, match="tilt"):
        mixing._solve(hist, sources, 2.0, scratch, tol=0.0, rounds=2)


def test_taking_repeated_rows_gives_the_copies_of_the_mix(spark, scratch):
    rows = [(7, "a", "w w w")] * 6 + [(i, "a", "w " * (1 + i % 5)) for i in range(100, 140)] + [(i, "b", "w " * 9) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = Counter()
    for r in mixing.mix(df, scratch).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.take_mix(df, scratch).collect()) == +want


def brute_chat(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add((t, r or "", x or ""))
    ordered = {c: [(r, x) for _, r, x in sorted(s, key=lambda y: (y[0] is None, y[0] or 0, y[1], y[2]))] for c, s in convs.items()}
    out = {}
    for c, s in ordered.items():
        same = [d for d, o in ordered.items() if o == s]
        if not any(len(o) > len(s) and o[: len(s)] == s for o in ordered.values()) and c == min(same):
            out[c] = (len(same), s)
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_chat(spark, scratch, block):
    rng = random.Random(8)
    rows = []
    for c in range(40):
        base = rng.randrange(5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base}-{t if rng.random() < 0.95 else -t}") for t in range(rng.randint(1, 7))]
    rows += [(100, 0, None, None), (101, 0, "", ""), (None, 0, "user", "x"), (102, None, "user", "late"), (102, 1, "user", "a <|im_end|>"), (103, 0, "user", "x"), (103, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = defaultdict(dict)
    for r in chat.collapse_and_render(df, scratch, block=block).collect():
        got[r["conv_id"]][r["segment"]] = r
    want = brute_chat(rows)
    assert set(got) == set(want)
    for c, (copies, turns) in want.items():
        text = "".join(got[c][s]["rendered"] for s in sorted(got[c]))
        assert text == "".join(f"<|im_start|>{r}\n{x.replace('<|', '<​|')}<|im_end|>\n" for r, x in turns)
        assert {(r["n_turns"], r["n_copies"]) for r in got[c].values()} == {(len(turns), copies)}
        assert len(got[c]) == -(-len(turns) // block)
    assert chat.collapse_and_render(df.limit(0), scratch).count() == 0


def b32(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def brute_warc(rows, least=0):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            best[h or ""] = max((x for x in (best.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        rev = (h or "") in best and best[h or ""] != i
        out.append((i, len((h or "").encode()), b32(h), "revisit" if rev else "response", best[h or ""] if rev else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, scratch, least):
    long = "é" * 30_000 + "WARC/1.1\r\n\r\n0\r\n\r\n" * 50
    rows = [(1, "http://a/é b", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "u", None), (4, "u", ""), (5, "u", long), (6, "u", long), (7, "u", "x" * 16_384), (8, "u\r\nX: y", "\r\n\r\n"), (9, "u", "0\r\n\r\nWARC/1.1\r\n"), (6, "u", long), (None, "u", "lonely null id"), (10, "u", "語" * 200_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    warc.write_archives(df, scratch.path("arc"), scratch, min_revisit_bytes=least, per_file=3)
    read = warc.read_archives(spark, scratch.path("arc"), scratch)
    assert {bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()} == {r[2] or "" for r in rows}
    got = warc.resolve_revisits(read, scratch)
    assert got.where("error is not null").count() == 0
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == brute_warc(rows, least)


def test_warc_faults_are_told(spark, scratch, tmp_path):
    recs = list(warc.records(1, "u", "x" * 50_000, warc.digest(b"x" * 50_000), None, False, 16_384))
    assert len(recs) > 2
    (tmp_path / "a.warc").write_text("\r\n\r\n".join(r for i, r in enumerate(recs) if i != 1) + "\r\n\r\n", newline="")
    row = warc.read_archives(spark, f"file://{tmp_path}", scratch, glob="*.warc").first()
    assert row["payload"] is None and row["error"] == "segments are missing"
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"


def test_warc_empty_table(spark, scratch):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, scratch.path("none"), scratch)
    assert warc.resolve_revisits(warc.read_archives(spark, scratch.path("none"), scratch), scratch).count() == 0


def test_a_text_whose_id_holds_a_third_of_all_rows_is_judged_in_parts(spark, scratch):
    rows = [(7, "same text")] * 300 + [(None, "")] * 300 + [(i, f"text {i % 150}") for i in range(10, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.exact_dedup(docs, scratch).collect()
    kept = Counter((r.keep_id, r.kept) for r in got if r.doc_id in (7, None))
    assert len(got) == 900 and kept[(7, True)] == 1 == kept[(None, True)] and kept[(7, False)] == 299
    assert exact_dedup.drop_exact_duplicates(docs, scratch).count() == 152
    plan = exact_dedup.exact_dedup(docs, scratch)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "_among" in plan


def test_recall_of_near_pairs_does_not_fall_with_the_size_of_the_table():
    rng = random.Random(1)

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    pairs = []
    while len(pairs) < 1_000:
        a = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice([60, 90, 150]))]
        b = list(a)
        while (like := len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) >= 0.86:
            b[rng.randrange(len(b))] = f"x{rng.randrange(20_000)}"
        if like >= 0.8:
            pairs.append((" ".join(a), " ".join(b)))
    for n in (10**4, 2**24, 2**30):
        words, width, wipe, most = simhash.wide_plan(n, 0.8, 0.97)
        at = np.arange(2 * words)
        take = (at[:, None] // 2 * 64 + at[:, None] % 2 * 32) + np.arange(width)[None, :]

        def keys(text, words=words, width=width, wipe=wipe, at=at, take=take):
            fp, tip = simhash.wide_fingerprint(text, words)
            weak = np.argsort(tip[take], axis=1, kind="stable")[:, :wipe]
            half = np.stack([fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)], 1).ravel() & np.uint64((1 << width) - 1)
            return fp, {(int(s), int(b), int(half[s]) & ~(1 << int(b))) for s in at for b in weak[s]}

        found = 0
        for a, b in pairs:
            (x, k), (y, m) = keys(a), keys(b)
            found += bool(k & m) and int(np.bitwise_count(x ^ y).sum()) <= most
        assert found >= 950, (n, found)
