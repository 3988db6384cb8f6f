"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.llm import exact_dedup, langid, mixing, packing, simhash
from ferry.llm.queries import tokenizer
from ferry.plans.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, whatever their label says, with all their columns.

    Null and empty texts and texts without a letter go; very long ones are read whole. Equal texts, repeated rows too, are
    judged alike; of equal cosines the first language counts. An empty table, or one without a labelled text, gives an
    empty result. Columns may have any name.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.keep_identified(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, with all its columns: the one of the largest id, and one row of it where it repeats.

    Null counts as an empty text, a null id as smaller than any other. Very long texts are compared whole, by a hash of
    256 bits. An empty table stays empty. Columns may have any name.
    """
    return exact_dedup.drop_exact_duplicates(docs, Scratch(spark, "stage-exact"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of texts whose five-word shingles are alike by 0.8 or more,
    with all its columns.

    Likeness is told by wide SimHash fingerprints of whole texts. Null texts and texts without words are all alike. Rows
    that repeat an id stay or go together; rows without id stay. An empty table stays empty. Columns may have any name.
    """
    return simhash.drop_similar(docs, Scratch(spark, "stage-simhash"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns: not at all, once or twice.

    A null source is one of its own; null and empty texts have no words and may be taken or not. Equal rows share their
    copies. Reruns take the same. An empty table stays empty. Columns may have any name.
    """
    return mixing.take_mix(docs, Scratch(spark, "stage-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: (sequence_id, length, ids, doc_ids, pieces, offsets).

    Each document is its tokens and an end; longer ones are cut into pieces. Null and empty texts are an end alone.
    Repeated rows are packed each. An empty table gives an empty result. Other columns are left out.
    """
    return packing.sequences(packing.pack_documents(docs, *tokenizer(), Scratch(spark, "stage-pack"), keep_ids=True))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact),
    ("SimHash near-dedup", drop_near),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained profiles, SimHash components, the tilt and packing are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
