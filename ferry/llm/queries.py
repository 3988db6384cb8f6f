"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm import alignment, chat, clusters, embeddings, exact_dedup, langid, mixing, packing, pieces, pii, quality, simhash, warc
from ferry.llm.text import ascii_lower
from ferry.plans.scratch import Scratch

LANG_KEY = "doc_id"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """(rank file, split pattern) of the public 50k byte-level tokenizer: the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers as public

    return str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN


def piece_model() -> str:
    """The public SentencePiece BPE model."""
    import public_tokenizers as public

    return str(public.path("piece_bpe_32k.model"))


def op1_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))

    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256")
    return exact_dedup.exact_dedup(docs, Scratch(spark, "op2"), carry=[sha]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer(), Scratch(spark, "op3"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = langid.train(docs, ~F.col("held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op5"))[0]


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op6_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, grades(_table(spark, sf_dir, "labels")))
    return quality.grade(docs.select("doc_id", "text"), model).drop("text")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_groups(_table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"), Scratch(spark, "op9"))


def op10_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    warc.write_archives(_table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    read = warc.read_archives(spark, scratch.path("archives"), scratch)
    got = warc.resolve_revisits(read, scratch)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    assigned, centroids = clusters.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scratch)
    got = clusters.with_inertia(assigned.select("vec_id", "cluster", "distance"), centroids, scratch)
    return got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), piece_model())
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), "ids")
    return pieces.decode(encoded, piece_model()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (*tokenizer(), piece_model())
    aligned = alignment.align(_table(spark, sf_dir, "documents"), *both)
    said = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", said, "links")
    got = alignment.weigh(rows, Scratch(spark, "op13"), *both)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii_semi_crf, op2_exact_dedup, op3_best_fit_packing, op4_language_id, op5_embedding_near_dedup, op6_quality_ordinal, op7_mix_sources, op8_simhash_near_dedup, op9_chat_collapse, op10_warc_reassembly, op11_centroid_clustering, op12_sentencepiece, op13_tokenizer_alignment, pipeline]
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn, r, x) AS ts, count(*) AS n FROM t GROUP BY conv_id),
w AS (SELECT ts, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts, n),
p AS (SELECT DISTINCT ts[1:k] AS pre FROM (SELECT ts, n, unnest(range(1, n)) AS k FROM w)),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = w.ts)),
q AS (SELECT conv_id, n, n_copies, unnest(ts) AS u, unnest(range(0, n)) AS i FROM m)
SELECT conv_id, i // 256 AS segment, n AS n_turns, n_copies,
       string_agg('<|im_start|>' || replace(u.r, '<|', '<​|') || chr(10) || replace(u.x, '<|', '<​|') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM q GROUP BY conv_id, i // 256, n, n_copies
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op9_chat_collapse": OP9_SQL}
