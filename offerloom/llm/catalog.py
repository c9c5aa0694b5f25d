"""The corpus queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import (
    bpe,
    decontaminate,
    divergence,
    jaccard,
    passages,
    quality,
    secrets,
    suffixes,
    token_counts,
    topk,
    toxicity,
    vector_codes,
    warc,
)
from offerloom.llm.common import table
from offerloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("__k1", "__k2")


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # a cache of its own per call: the query shows the work, not what an earlier call has stored
    cache = f"{shared_folder(spark)}/token-counts/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), cache)


def op6_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    return warc.fixity(table(spark, folder, "pages"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contamination(documents, benchmark).drop(*decontaminate.KEY)


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_report(table(spark, folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_digests(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scans,
        op3_jaccard_join,
        op4_top_k,
        op5_token_counts,
        op6_warc_fixity,
        op7_decontamination,
        op8_repeated_passages,
        op9_bpe,
        op10_toxicity,
        op11_vector_codes,
        op12_source_divergence,
        op13_suffix_dedup,
    )
}
