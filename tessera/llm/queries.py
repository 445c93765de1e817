"""One query per training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, html, knn, lines, mixing, quality, ranked, rules, secrets, shards, simhash, tries, urls
from tessera.session import table

#: Where the public tokenizer files lie; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), vocabulary=vocabulary_path())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_voronoi_knn": op3_voronoi_knn,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_html_main_text": op7_html_main_text,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_secret_scan": op9_secret_scan,
    "op10_mix_sources": op10_mix_sources,
    "op11_threshold_search": op11_threshold_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bloom_cascade": op13_bloom_cascade,
}
ORACLES: dict[str, str] = {
    "op3_voronoi_knn": knn.ORACLE,
    "op4_line_dedup": lines.ORACLE,
    "op5_quality_rules": rules.ORACLE,
    "op11_threshold_search": ranked.ORACLE,
    "op12_prefix_trie": tries.ORACLE,
    "op13_bloom_cascade": urls.ORACLE,
}
