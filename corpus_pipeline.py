"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.

This module belongs to the subpackage ``hwcatalog.llm`` and can't be imported without it; nothing else needs either.
Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables as its operator's docstring says:
null and empty texts fail the quality rules, a document whose lines all go stays with an empty text, and a document
without words is never taken by the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hwcatalog.llm import bpe, line_dedup, minhash_dedup, mixing, quality_rules
from hwcatalog.llm.common import cut, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows the text."""
    out = line_dedup.drop_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash_dedup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's encoding and decoding."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_dedup), ("source_mixing", mix), ("byte_bpe", tokens)]

#: MinHash links, dependent rounding and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        release(before)  # the table itself was no cut and stays
    return docs
