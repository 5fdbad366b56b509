"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.llm.bpe import bpe_encode
from cueforge.llm.common import read_table
from cueforge.llm.embed_dedup import embedding_duplicates
from cueforge.llm.html_extract import extract_text
from cueforge.llm.lm import lm_scores
from cueforge.llm.minhash import near_duplicates
from cueforge.llm.mixing import mix_sources
from cueforge.llm.quality import ORACLE as QUALITY_SQL
from cueforge.llm.quality import quality_rules
from cueforge.llm.secret_scan import secret_scan
from cueforge.llm.substring import remove_repeats
from cueforge.llm.token_count import token_counts

#: A document of more tokens than this does not fit the context.
TOKEN_LIMIT = 2048
#: Entropy of the source weights, in nats, where there are MIX_SOURCES sources; with others, the same part of the most there can be.
MIX_ENTROPY, MIX_SOURCES = 2.9, 20


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_encode(read_table(spark, sf_dir, "documents"), path, decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan(read_table(spark, sf_dir, "documents"))
    values = F.transform("findings", lambda c: c.getField("value"))
    return scanned.select("doc_id", F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"), F.size("findings").alias("n_findings"), F.array_join(values, " ").alias("secrets"), F.sha2(F.encode("redacted", "UTF-8"), 256).alias("redacted_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a set entropy, in the least budget that passes over every source once or more."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), evenness=MIX_ENTROPY / math.log(MIX_SOURCES))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_bpe_encode_decode": op2_bpe_encode_decode,
        "op3_lm_scores": op3_lm_scores,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_secret_scan": op6_secret_scan,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_mix_sources": op9_mix_sources,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY_SQL}
