"""The contract queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.llm import bit_slices, centroids, decontaminate, iblt, language, licenses, ngram_trie, pieces, secrets, simhash, token_files, urls, warc
from aerolytics.llm.common import read_table, shared_dir


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(read_table(spark, sf_dir, "pages"))


def op2_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.train_and_score(read_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_documents(read_table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark)
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_files.read_token_files(spark, folder, keep_ids=False)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))[0]


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_OPERATORS = (op1_merkle_audit, op2_lookup_sketch, op3_ngram_trie, op4_language, op5_licenses, op6_sentencepiece, op7_url_filter, op8_simhash, op9_secrets, op10_decontamination, op11_token_files, op12_centroids, op13_ranked_search)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL: dict[str, str] = {"op1_merkle_audit": warc.oracle(), "op2_lookup_sketch": iblt.oracle(), "op5_licenses": licenses.oracle(), "op7_url_filter": urls.oracle(), "op10_decontamination": decontaminate.oracle(), "op12_centroids": centroids.oracle(), "op13_ranked_search": bit_slices.oracle()}
