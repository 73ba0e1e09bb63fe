"""The corpus pipeline: from raw documents to packed training sequences, one operator of ``sparkpact.llm`` a stage.

Null and empty texts fail the quality rules and go; texts of any length are read whole. Rows without an id or a language are
documents like others (of a group of near-duplicates they stay only if no other row has an id). Rows alike in id and text are
near-duplicates of each other: one stays. An empty table, or one of which a stage leaves nothing, gives an empty result;
columns beside those of documents are handed on to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkpact.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from sparkpact.llm.common import durable, table
from sparkpact.llm.registry import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.judge_quality(docs, keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: a Jaccard similarity of 0.8 or more of five-word shingles."""
    return simhash.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: SQL has neither the tokenizer nor the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
