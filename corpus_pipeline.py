"""From raw documents to packed sequences: stages of the training-data operators, each on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.decontaminate import drop_contaminated
from marlstone.llm.exact_dedup import drop_exact_copies
from marlstone.llm.language_id import known_labels, rows_with_language, train
from marlstone.llm.near_dedup import drop_near_copies
from marlstone.llm.packing import packed
from marlstone.llm.shared import staged

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose language is ambiguous."""
    return rows_with_language(docs, train(known_labels(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the least id stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's window go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of sequences, a row for each piece."""
    return packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on all documents; what passes between them is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
