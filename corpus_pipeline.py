"""From raw documents to packed training sequences: five stages, each one operator of vaultline.llm.

run() writes the result of every stage as Parquet in the shared folder and reads it again as the next one's documents. All
stages but the last return the columns of documents. A row takes part with whatever columns it has; nulls, empty texts,
repeated rows and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultline.llm.common import table, written
from vaultline.llm.language import keep_identified
from vaultline.llm.lines import keep_new_lines
from vaultline.llm.packing import pack
from vaultline.llm.simhash import keep_one
from vaultline.llm.suffixes import without_repeats


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that stand, give or take a word, in an earlier line; documents without any line left go."""
    return recounted(keep_new_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte that a repeated 200-byte string covers."""
    return recounted(without_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeat_removal),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
