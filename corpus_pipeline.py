"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. language: rank-order profiles are learned from the labelled documents; documents without letters go, and
   those whose closeness to every learned language is below ``language.LEAST_SCORE``;
2. near_duplicates: of each component of near copies (SimHash covering tables and bands propose pairs of
   five-word shingle sets, Jaccard similarity of 0.8 or more links them) the document with the smallest id stays;
3. decontamination: documents that hold a window of a benchmark item go;
4. secrets: secrets are masked in the text, no document goes;
5. pieces: each text gets its SentencePiece ids (and their digest) beside all of its columns.

All but the last return the columns of ``documents``.  The copies between stages stay in the shared folder until
``aerolytics.scratch.clear`` is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolytics.llm import decontaminate, language, near_copies, pieces, secrets
from aerolytics.llm.common import read_table, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known_languages(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True, keep_columns=True)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("pieces", pieces_stage),
]

#: No SQL: n-gram profiles, components and subword merges; tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
