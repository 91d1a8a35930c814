"""The corpus pipeline: language ID, SimHash near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and read again before the next. All but the last return the columns of
``documents``.

* ``language_id`` drops documents whose language is undetermined (no letters) or ambiguous.
* ``near_dedup`` keeps one document of each group of texts whose sets of five-word shingles have
  a Jaccard similarity of 0.8 or more, the one of the smallest id: the SimHash index's links,
  verified, and a prefix join for similar texts that differ in more bits.
* ``decontaminate`` drops documents that hold a full window of a benchmark item.
* ``pack`` tokenises what is left and packs it into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import common, decontaminate, langid, packing, queries, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, benchmark)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.byte_bpe_50k)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

# Fingerprints by XXH64 majority, learned classifiers and tokenizers are beyond SQL; the
# tests compare the pipeline with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.write_table(stage(spark, docs, sf_dir))
    return docs
