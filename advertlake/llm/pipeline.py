"""Corpus pipeline: quality, near duplicates, repeated passages, source mix, and sampled pieces, one written table after the other.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows and an empty table. Null and empty texts are judged
like any other text by the classifier, are in no class of near duplicates, hold no passage, and have size 0 in the mix, which takes them as often
as the rate of their source says; they have no pieces. Rows that repeat are near duplicates of each other, so one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.llm import near_dedup, piece_sampling, quality_classifier, source_mixing, substring_dedup
from advertlake.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the folder whose crc32 mod 5 is not 0. Rows without a
    doc_id are judged, but not learned from; without labels every document gets the same score and stays."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id, a null doc_id last. Documents without words all stay."""
    return near_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier in the corpus; n_chars follows the text. Every document stays."""
    got = substring_dedup.remove_repeats(docs).select(docs.columns)
    if "n_chars" not in docs.columns:
        return got
    return got.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source of its own."""
    return source_mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document: doc_id, pieces, n_pieces, lossless. Copies of a document get the same pieces; a null doc_id is a key too."""
    return piece_sampling.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pieces", pieces),
]

#: SQL can't express the learned classifier, the sampled signatures or the sampled pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of a folder; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
