"""A training corpus from raw documents: filter, deduplicate, redact, mix, encode.

STAGES lists the stages in order. Each is a function of (spark, docs, sf_dir)
whose result is written as Parquet and read again as the next one's docs; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.llm.bpe import bpe_encode
from cueforge.llm.common import checkpointed, narrow, shared_folder
from cueforge.llm.minhash import near_duplicates
from cueforge.llm.mixing import mix_sources
from cueforge.llm.quality import quality_rules
from cueforge.llm.secret_scan import secret_scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rejected ids that are broadcast to the scan of the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: How often the mixture may pass over a source while it passes over the largest once.
REPETITIONS = 2.0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _without(docs: DataFrame, rejected: DataFrame, key: str, most: int) -> DataFrame:
    rejected = checkpointed(narrow(rejected.where(F.col(key).isNotNull()).select(key).distinct(), most))
    return docs.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_IDS else rejected, key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    judged = quality_rules(docs, keep=("doc_id", "lang", "source", "n_chars"), cleaned_col="text").where("kept")
    size = F.when(F.col("n_lost_words") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return judged.withColumn("n_chars", size).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: one with the smallest id, whether or not ids are null or repeated.

    A document is known by a hash of its columns. Of equal rows, one is taken;
    documents without shingles are no copies, and all stay.
    """
    docs = docs.withColumn("_doc", F.xxhash64(*COLUMNS))
    most = docs.count()
    found = checkpointed(narrow(near_duplicates(docs, row_col="_doc").select("_doc", "n_shingles", "kept"), 2 * most))
    equal = checkpointed(narrow(found.where("kept and n_shingles > 0").groupBy("_doc").agg(F.count("*").alias("rows")).where("rows > 1").select("_doc"), most))
    left = _without(docs, found.where("not kept").select("_doc").union(equal), "_doc", most).select(*COLUMNS)
    n = equal.count()
    if not n:
        return left
    once = docs.join(F.broadcast(equal) if n <= BROADCAST_IDS else equal, "_doc", "left_semi").dropDuplicates(["_doc"])
    return left.unionByName(once.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the secret scan finds replaced in their texts."""
    scanned = secret_scan(docs).withColumn("text", F.col("redacted"))
    size = F.when(F.size("findings") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return scanned.withColumn("n_chars", size).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, as often as its source's weight asks for."""
    return mix_sources(docs, repetitions=REPETITIONS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as ids, decoded again to prove the round trip."""
    coded = bpe_encode(docs, TOKENIZER, decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secret scan", redact_secrets), ("mixing", mixture), ("bpe encoding", encode)]

#: Candidate hashing, a random forest and merges have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what lies between them goes to the shared folder, and goes away once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
