"""The registered text queries; none of them has a SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axlewatch.llm import (
    clustering, decontamination, graph_search, lm_scoring, near_dedup, packing, page_text, personal_data, secret_scan,
    sharding, substring_dedup, toxicity, whitening,
)
from axlewatch.llm.base import table


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_digest(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against those labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score_language(table(spark, sf_dir, "documents"), good)


def op6_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"))


def op10_ngram_bayes_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op13_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_skip_chain_crf, op2_recompression, op3_secret_scan, op4_site_template_removal,
        op5_cross_entropy_difference, op6_pigeonhole_edit_matching, op7_robust_pruned_graph, op8_circulant_minhash,
        op9_pattern_packing, op10_ngram_bayes_toxicity, op11_spectrum_slicing, op12_histogram_sort, op13_va_file)}
ORACLES: dict[str, str] = {}
