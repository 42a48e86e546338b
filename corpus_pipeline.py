"""From raw documents to token ids: language, near copies, benchmark items, source mix, token files.

Each stage takes the documents that its predecessor kept, as a stored table, and all but the last return them with the columns of
documents.  Documents without a language go; one document of each component of near copies stays, that with the least doc_id;
documents that contain a benchmark item go; documents are repeated or dropped to reach the sources' weights; the last stage writes
the token ids of what is left and returns a row for each document as read back from the files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import decontaminate, jaccard, langid, mixing, tokenfile
from linkwright.llm.common import new_path

#: Workers of earlier stages stay, so that each may remember fewer pieces of text than where the last stage is alone.
PIECES = 200_000


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.encode_and_read(docs, new_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), pieces=PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", with_language),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing_sources", mixed),
    ("token_ids", token_ids),
]

#: SQL has no tokenizer, nor the language mixture; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
