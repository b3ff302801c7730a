"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Language ID drops documents without a known language, near-dedup (the stage named
simhash) keeps one document of each group of near copies, five-word Jaccard
similarity 0.8 or more, by the SimHash trie join with a wide budget, substring dedup cuts repeated passages, the secret
scan masks secrets, and packing cuts what is left into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithos.llm import langid, near, packing, secrets, substring
from lithos.llm.common import made, materialize, sweep
from lithos.llm.queries import JSON_FILE, PIECE_FILE, RANK_FILE


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs, PIECE_FILE))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, RANK_FILE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, JSON_FILE)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Models and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            sweep(mark, docs)  # what the stage was made from is no longer needed
    return docs
