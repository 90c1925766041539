"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment,
    decontamination,
    fingerprints,
    langid,
    lines,
    near_dups,
    packing,
    resampling,
    sharding,
    token_files,
    toxicity,
    url_filters,
    warc,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_consistent_hash_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op5_warc_revisits", """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op1_language_codes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


@query("op6_toxic_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_invertible_sketches")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op8_line_neighbours", lines.ORACLE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated_documents(table(spark, sf_dir, "documents"))


@query("op2_bbit_minhash", near_dups.ORACLE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.duplicates(table(spark, sf_dir, "documents"))


@query("op3_string_tiling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_url_trie", url_filters.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, url_filters.RULES))


@query("op11_batch_concatenation", resampling.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_pair_hashing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
