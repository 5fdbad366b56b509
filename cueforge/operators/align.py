"""Cues, tagged and aligned to their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.functions import prosody
from cueforge.functions.frames import frames


def segments(cues: DataFrame, language: str = "") -> DataFrame:
    """Cues with their tags, the text without them, and the run's language."""
    return cues.withColumns({"tags": prosody.tags(F.col("text")), "text": prosody.clean(F.col("text")), "language": F.lit(language)})


def stretch_ratio(start_ms: Column, end_ms: Column, duration_ms: Column) -> Column:
    """Window by duration where audio is longer than a window that is one; else 1."""
    window = end_ms - start_ms
    return F.when((window > 0) & (duration_ms > window), window.cast("double") / duration_ms.cast("double")).otherwise(F.lit(1.0))


def align(rendered: DataFrame) -> DataFrame:
    """Add stretch_ratio to segments that carry duration_ms."""
    return rendered.withColumn("stretch_ratio", stretch_ratio(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms")))


def align_pairs(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """align() for durations (file_id, ord, duration_ms) that are a table of their own; a pair without partner fails."""
    both = segments.withColumn("_s", F.lit(True)).join(durations.withColumn("_d", F.lit(True)), ["file_id", "ord"], "full")
    paired = F.coalesce(F.col("_s") & F.col("_d"), F.lit(False))
    checked = F.when(paired, F.col("duration_ms")).otherwise(F.raise_error(F.concat(F.lit("segments and durations differ in file "), F.col("file_id"))).cast("bigint"))
    return align(both.withColumn("duration_ms", checked).drop("_s", "_d"))


def span(timed: DataFrame, rate: int) -> DataFrame:
    """(file_id, frames): where each file's timeline ends. A window counts whole, a cue without one by its audio's duration_ms."""
    window, at = F.col("end_ms") - F.col("start_ms"), lambda c: frames(c, rate)
    end = at(F.col("start_ms")) + F.when(window > 0, at(window)).otherwise(at(F.col("duration_ms")))
    return timed.groupBy("file_id").agg(F.max(end).alias("frames"))


def plan(timed: DataFrame) -> DataFrame:
    return timed.select("file_id", "ord", "start_ms", "end_ms", "stretch_ratio", "text")


def summary(files: DataFrame, timed: DataFrame) -> DataFrame:
    """(file_id, segments) for every file, those without segments included."""
    return files.select("file_id").join(timed.groupBy("file_id").agg(F.count("*").alias("segments")), "file_id", "left").select("file_id", F.coalesce("segments", F.lit(0)).cast("bigint").alias("segments"))
