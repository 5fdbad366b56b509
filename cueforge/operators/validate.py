"""Checks that come before any audio is decoded, as a column or as a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of the longest timeline.
MOST_MS = 14_400_000


def bound_error(most_ms: int = MOST_MS) -> Column:
    """What is wrong with a cue's times: 'negative start', 'beyond the timeline', or null."""
    return F.when(F.col("start_ms") < 0, "negative start").when(F.greatest("start_ms", "end_ms") > most_ms, "beyond the timeline")


def violations(timed: DataFrame, most_ms: int = MOST_MS) -> DataFrame:
    return timed.withColumn("error", bound_error(most_ms)).where("error is not null")


def quarantine(timed: DataFrame, most_ms: int = MOST_MS) -> tuple[DataFrame, DataFrame]:
    """Cues of the files that are sound, and all cues of those that are not, with error where a cue is at fault."""
    marked = timed.withColumn("error", bound_error(most_ms))
    if "audio" in timed.columns:
        marked = marked.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.length("audio"), F.lit(0)) == 0, "no audio")))
    bad = marked.where("error is not null").select("file_id").distinct()
    return marked.join(bad, "file_id", "left_anti").drop("error"), marked.join(bad, "file_id", "left_semi")


def strict(timed: DataFrame, most_ms: int = MOST_MS) -> DataFrame:
    """timed unchanged; an eager check fails the run, naming a cue, before anything is decoded."""
    first = violations(timed, most_ms).select("index", "error", "start_ms", "end_ms").head(1)
    if first:
        raise ValueError(f"segment {first[0]['index']}: {first[0]['error']} ({first[0]['start_ms']} to {first[0]['end_ms']} ms)")
    return timed
