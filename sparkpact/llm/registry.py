"""The registered queries of the training-data operators and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_in_middle, license_scan, line_dedup, merkle, packing, quality_rules, simhash, suffix_dedup, top_k, toxicity, url_filter
from .bpe_counts import token_counts
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.fit(table(spark, sf_dir, "labels"), documents))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scan, op2_suffix_dedup, op3_url_filter, op4_simhash, op5_packing, op6_quality_rules, op7_toxicity, op8_token_counts, op9_line_dedup, op10_decontamination, op11_merkle_manifest, op12_fill_in_middle, op13_exact_top_k)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_merkle_manifest": merkle.oracle(), "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_exact_top_k": top_k.ORACLE}
