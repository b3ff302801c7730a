"""Queries and oracle SQL of the llm operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lithos.llm import bpe, counts, html, langid, media, packing, secrets, simhash, substring, topk

#: Files of public vocabularies; the operators take them as parameters.
JSON_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), RANK_FILE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), RANK_FILE, PATTERN, with_ids=False).drop("ids", "decoded")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), JSON_FILE, with_ids=False).drop("ids")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, PIECE_FILE))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(_table(spark, sf_dir, "documents"), with_media=False).drop("media", "rgb")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(_table(spark, sf_dir, "documents"), RANK_FILE, PATTERN, counts.revision())


_QUERIES = (
    op1_html, op2_secret_scan, op3_bpe, op4_topk, op5_packing, op6_simhash, op7_language_id, op8_media, op9_substring_dedup,
    op10_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: The other queries are beyond SQL (models, libraries' tokenizers, XXH64, files) and tested against brute force.
_ORACLES = {
    "op4_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id,
                coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
            FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        WHERE rank <= 20
    """,
    "op9_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, list_slice(w, i, i + 12) AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
        ), firsts AS (
            SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE first_doc < doc_id
        ), each AS (
            SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
        ), marked AS (
            SELECT e.doc_id, e.i, e.word, g.i IS NOT NULL AS removed FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
        ), kept AS (
            SELECT doc_id, count(*)::BIGINT AS n_words, count_if(removed)::BIGINT AS n_removed,
                string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS text
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
