"""The pipeline's stages against plain Python, each on its own input."""

from collections import Counter

from test_llm_dedup import ASCII

import corpus_pipeline


def shingles(text):
    words = (text or "").translate(ASCII).split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def check_language(before, after):
    gone = Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after)
    assert gone == Counter(r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or ""))


def check_exact(before, after):
    best, most = {}, {}
    for r in before:
        t = (r["text"] or "").translate(ASCII)
        best[t] = max(best.get(t, -1), r["doc_id"])
    for r in after:
        t = (r["text"] or "").translate(ASCII)
        most[t] = most.get(t, 0) + 1
        assert r["doc_id"] == best[t]
    assert set(most) == set(best) and set(most.values()) <= {1}


def check_near(before, after):
    kept = {r["doc_id"] for r in after}
    grams = {r["doc_id"]: shingles(r["text"]) for r in before}
    where = {}
    for i, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in where.values() if len(ids) < 300 for k, b in enumerate(ids) for a in ids[:k])
    alike = {p: c / (len(grams[p[0]]) + len(grams[p[1]]) - c) for p, c in common.items()}
    groups = [p for p, j in alike.items() if j >= 0.8]
    both = sum(a in kept and b in kept for a, b in groups)
    assert both <= 0.1 * len(groups) + 1
    near = {i for p, j in alike.items() if j >= 0.55 for i in p}
    assert {r["doc_id"] for r in before} - kept <= near  # documents unlike any other stay


def check_mix(before, after):
    rows, copies = Counter(r["doc_id"] for r in before), Counter(r["doc_id"] for r in after)
    assert all(copies[i] <= 2 * n for i, n in rows.items()) and set(copies) <= set(rows)
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in before}
    words = sum(size[r["doc_id"]] for r in before)
    assert abs(sum(size[i] * c for i, c in copies.items()) - 1.5 * words) < 0.02 * words + max(size.values())


def check_pack(before, after):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {}
    for r in after:
        assert len(r["ids"]) <= 1024
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["offsets"], [*r["offsets"][1:], len(r["ids"])], strict=True):
            got.setdefault((doc, piece), []).append(tuple(r["ids"][a:b]))
    docs = {}
    for (doc, piece), held in sorted(got.items()):
        assert len(set(held)) == 1
        docs.setdefault(doc, []).append(held)
    copies = Counter(r["doc_id"] for r in before)
    for r in {r["doc_id"]: r for r in before}.values():
        held = docs.pop(r["doc_id"])
        assert {len(h) for h in held} == {copies[r["doc_id"]]}
        assert [x for h in held for x in h[0]] == [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
    assert not docs and len(after) <= 1.02 * sum(len(r["ids"]) for r in after) / 1024 + 1


CHECKS = [check_language, check_exact, check_near, check_mix, check_pack]


def test_run_chains_the_stages_and_each_takes_effect(spark, monkeypatch):
    """What each stage read and gave inside run(), against plain Python."""
    sf, seen = "/root/testdata/sf0.01", []

    def watched(stage):
        def f(spark, docs, sf_dir):
            seen.append(docs)
            return stage(spark, docs, sf_dir)

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, sf)
    source = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [d.collect() for d in [*seen, last]]
    assert Counter(map(tuple, tables[0])) == Counter(map(tuple, source.collect()))
    assert all(d.columns == source.columns for d in seen)
    for check, before, after in zip(CHECKS, tables, tables[1:], strict=False):
        check(before, after)


def test_stages_take_repeated_rows_and_odd_texts(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(70_001, None, None, None, 0), (70_002, "12 34", "en", "src0", 5), (70_003, "", "en", None, 0), (70_004, "one word " * 60_000, "en", "src1", 0), (70_005, "y" * 300_000, None, "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id % 5 = 0"))
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "").collect()
        if name == "SimHash near-dedup":
            assert {r["doc_id"] for r in rows if r["doc_id"] >= 70_000} - {r["doc_id"] for r in out} == {70_003}
        else:
            CHECKS[k](rows, out)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_keep_columns_with_clashing_names(spark, scratch):
    clash = "lang_pred score id fp comp kept size copies n m h bk _row _full _pre _len _gone _i _s _z _z0 _copies _each component_id length piece".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", *[f"concat('{c}-', doc_id) AS `{c}`" for c in clash])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, ""), f"clash-{i}")
        assert out.count() > 0
        if i < 4:
            assert out.columns == docs.columns
            assert not out.where(" OR ".join(f"`{c}` <> concat('{c}-', doc_id)" for c in clash)).count()
            docs = out


def test_packing_holds_one_python_worker_a_task(spark, monkeypatch):
    """Pieces are cut and numbered in one pass: each pass of a task keeps a worker of its own, with a tokenizer in it."""
    plans = {}

    class Watched(corpus_pipeline.Scratch):
        def save(self, df, name, **options):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().save(df, name, **options)

    monkeypatch.setattr(corpus_pipeline, "Scratch", Watched)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))
    out = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert plans["pieces"].count("MapInArrow") == 1
    check_pack(docs.collect(), out)


def test_sequences_leave_python_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    steps = []
    items = spark.createDataFrame([(0, 1, 0, 1, bytearray(b"\1\0"), 0)], "sequence_id long, doc_id long, piece int, length long, ids binary, offset long")
    monkeypatch.setattr(type(items), "mapInArrow", lambda self, f, schema: steps.append(f))
    corpus_pipeline.packing.sequences(items)
    rows = [{"sequence_id": s, "ids": [bytes([s % 7, 0] * n) for n in (1 + s % 3, 2)], "length": [1 + s % 3, 2], "doc_id": [s, s + 1], "piece": [0, 1], "offset": [0, 1 + s % 3]} for s in range(1000)]
    got = list(steps[0](iter([pa.RecordBatch.from_pylist(rows)])))
    assert max(b.num_rows for b in got) <= 256
    want = [{"sequence_id": r["sequence_id"], "length": sum(r["length"]), "ids": [r["sequence_id"] % 7] * sum(r["length"]), "doc_ids": r["doc_id"], "pieces": r["piece"], "offsets": r["offset"]} for r in rows]
    assert [r for b in got for r in b.to_pylist()] == want
