"""Which finished jobs are kept: the newest, up to a number and a total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_JOBS, MOST_BYTES = 16, 256 << 20


def retained(jobs: DataFrame, key: str, seq: str = "seq", size: str = "bytes", most_jobs: int = MOST_JOBS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The jobs of each key that are kept once all have come in, with rank (1 is the newest) and running_bytes.

    The newest is always kept. Evicting the oldest whenever a limit is passed
    keeps the same jobs as this window, since totals from the newest down only
    grow. Only the first most_jobs of a key are ever summed.
    """
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
    ranked = jobs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most_jobs)
    summed = ranked.withColumn("running_bytes", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where((F.col("rank") == 1) | (F.col("running_bytes") <= most_bytes))


def last_of_stem(files: DataFrame, stem: str = "stem", position: str = "position") -> DataFrame:
    """Of the inputs that would write one stem, the last, with their number as inputs."""
    # a greatest row and a count are partial aggregates, so a stem that many inputs share is no one task's
    others = [c for c in files.columns if c != stem]
    last = files.groupBy(stem).agg(F.max(F.struct(position, *(c for c in others if c != position))).alias("_last"), F.count("*").alias("inputs"))
    return last.select(stem, *(F.col("_last").getField(c).alias(c) for c in others), "inputs")
