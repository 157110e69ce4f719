"""A training corpus from raw documents: five stages, each one operator of corridor.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import cotrain, minhash, packing, suffix, toxicity
from corridor.llm.common import saved, table

TOXIC, GOOD = 0.7, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score of toxic passages stays below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score_col="__toxicity").where(F.col("__toxicity") < TOXIC).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the combined views score GOOD or better."""
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    names = ("__quality", "__text", "__meta")
    return cotrain.scored(docs, model, names).where(F.col("__quality") >= GOOD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group."""
    kept = minhash.near_duplicates(docs, words_in_shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("__id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus."""
    return suffix.cleaned(docs, size=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the Hilbert curve."""
    return packing.packed(docs, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: Learnt stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else saved(docs), sf_dir)
    return docs
