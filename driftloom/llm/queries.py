"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import bpe_trie, cost_packing, ecoc_langid, license_scan, media_chunks, ngram_jaccard, quality_llr, quote_link, suffix_dedup, url_boost
from driftloom.llm.arrowkit import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_link.link_quotes(table(spark, sf_dir, "conversations"))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc_langid.predict_languages(table(spark, sf_dir, "documents"))


def op10_url_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_boost.filter_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_media_chunks, op3_license_scan, op4_ngram_jaccard, op5_bpe_trie, op6_quality_llr, op7_quote_link, op8_cost_packing, op9_ecoc_langid, op10_url_boost)}
ORACLES: dict[str, str] = {}
