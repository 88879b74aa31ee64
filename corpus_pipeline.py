"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

language ID, exact deduplication, n-gram Jaccard join (one document of a group
stays), benchmark decontamination, best-fit packing. All stages but the last
return the columns of ``documents``; the last returns one row per token piece.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows, further columns of any name, and no rows at all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosaic.llm import best_fit_packing, decontaminate, exact_dedup, jaccard_join, language_id
from prosaic.llm.scratch import Scratch, scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in a language; the trigram models are fitted on a bounded sample of the labelled ones.

    Null, empty and letterless texts go. Without any labelled document there is no model, and nothing is kept.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts, a null one last; one of repeated rows stays; a null text equals an empty one."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Texts without words and rows without a doc_id are in no group and stay.
    """
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text; texts without words stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1,024 tokens; an empty or null text is its end token."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Language models, sketches and token ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents.

    Each stage's result is saved; its scratch tables and its predecessor's result are
    deleted then. The last result stays until ``scratch.release``, for the caller reads it.
    """
    docs, kept, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with scope(spark):
            docs = kept.save(stage(spark, docs, sf_dir), name)
        if before:
            kept.drop(before)
        before = name
    return docs
