"""From raw documents to packed training sequences: language, quality, near duplicates, packing.

Each stage reads what its predecessor kept as a written table. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadflow.llm import language, neardup, packing, quality
from leadflow.llm.support import prepare, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted. Null, empty and letterless texts go; texts are read whole, whatever their length; repeated
    rows are judged alike and all stay or go; an empty table stays empty; other columns travel along and are not read."""
    prepare(spark)
    return language.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the centre of their language and source. Null and empty texts fail the base rules; null
    languages and sources are groups of their own; repeated rows share a verdict; an empty table stays empty."""
    prepare(spark)
    return quality.keep_sound(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id. A null text is a class of its own, texts without words are equal;
    rows without an id all stay. Rows with one id count as one document: of those with different texts one stays, which is known as a fault."""
    prepare(spark)
    return neardup.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2048 ids. A null or empty text is one piece with the end id alone, long
    texts are cut into pieces of 2048, each repeated row is a document, and an empty table gives no rows."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("quality", apply_quality_rules), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

# Trained models, iterated estimates and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(prepare(spark), docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out, f"stage-{name}")
    return docs
