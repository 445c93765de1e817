"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.

* ``quality_rules`` drops documents that the base rules or their host's verdict reject; a null or empty text fails,
  null sources are one host, repeated rows fare alike.
* ``line_dedup`` drops repeated lines from the texts; a text may become empty, its row stays; a null id is smaller
  than any other, a null text becomes empty.
* ``simhash_dedup`` keeps one document of each group of near copies, that of the smallest id (null last; ties by
  hashes of the row); texts without words are one group.
* ``mix_sources`` returns the mix: a row per document and pass, with the words that the pass takes; texts without
  words are in no pass, null sources are one source.
* ``bpe_encode`` returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

An empty table passes through every stage; columns that documents do not have pass through all but the last.

Mixing draws pseudorandom permutations and SimHash needs a seeded XXH64, which SQL does not offer, so there is
no ORACLE_SQL; tests/llm compares every stage with a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, lines, mixing, queries, rules, simhash


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.dedup_lines(docs, report=None))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix_documents(docs))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, queries.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)  # a stage reads its documents more than once
            if before is not None:
                common.discard(before)
            before = docs
    return docs
