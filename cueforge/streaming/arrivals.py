"""Newly arrived subtitle files as a stream of cues, and job retention kept up as jobs finish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.operators.retention import MOST_BYTES, MOST_JOBS, retained
from cueforge.sources.subtitles import parse


def cue_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Cues of the files that come into folder; stateless, so no watermark is needed."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(folder)
    return parse(lines.select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", "\r\n?", "\n").alias("body")))


def keep_jobs(batch: DataFrame, kept: DataFrame | None, key: str, most_jobs: int = MOST_JOBS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What is kept of kept once the jobs of a micro-batch have come in; for use in foreachBatch."""
    known = batch if kept is None else kept.select(batch.columns).unionByName(batch)
    return retained(known, key, most_jobs=most_jobs, most_bytes=most_bytes).drop("rank", "running_bytes")
