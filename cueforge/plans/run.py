"""Whole runs: subtitle files or texts to plans and timelines, for one file or many in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.operators import align, render, synthesize, validate
from cueforge.operators.retention import last_of_stem
from cueforge.sources import sinks, subtitles, voices


@dataclass
class Run:
    """files (file_id, body) and timed segments with audio; lazy, so nothing is synthesised before it is asked for."""

    files: DataFrame
    timed: DataFrame

    def plan(self) -> DataFrame:
        return align.plan(self.timed)

    def summary(self) -> DataFrame:
        return align.summary(self.files, self.timed)

    def timelines(self) -> DataFrame:
        return render.render(self.timed)

    def write(self, folder: str) -> DataFrame:
        """A WAV file for each input with segments and a JSON plan for every input; of inputs with one stem the last is written."""
        base = F.element_at(F.split("file_id", "/"), -1)
        stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
        chosen = last_of_stem(self.files.select("file_id", stem.alias("stem"), F.col("file_id").alias("position"))).select("file_id")
        # synthesised once for both sinks
        timed = self.timed.join(chosen, "file_id", "left_semi").persist()
        try:
            audio = sinks.write_files(sinks.wav_files(render.render(validate.strict(timed))), folder, "wav", ".wav")
            plans = sinks.write_files(sinks.plan_json(chosen, align.plan(timed)), folder, "json", ".json")
            rows = [tuple(r) for part in (audio, plans) for r in part.collect()]
        finally:
            timed.unpersist()
        return self.files.sparkSession.createDataFrame(rows, "path string, bytes long")


def _run(files: DataFrame, cues: DataFrame, backend: synthesize.Backend, language: str, catalogue: DataFrame | None, partitions: int | None) -> Run:
    segments = synthesize.resolve(align.segments(cues, language))
    if catalogue is not None:
        segments = voices.select_voices(segments, catalogue, strict=True)
    return Run(files, align.align(synthesize.synthesize(segments, backend, partitions)))


def run_files(spark: SparkSession, path: str, backend: synthesize.Backend, language: str = "", catalogue: DataFrame | None = None, partitions: int | None = None) -> Run:
    """Every file that a path or glob names; no file is an error."""
    files = subtitles.read_files(spark, path)
    if files.isEmpty():
        raise FileNotFoundError(f"no files match {path}")
    return _run(files, subtitles.parse(files), backend, language, catalogue, partitions)


def run_texts(texts: DataFrame, backend: synthesize.Backend, language: str = "", catalogue: DataFrame | None = None, partitions: int | None = None) -> Run:
    """Texts (file_id, body); one without any cue is a cue of its own, spoken from the start."""
    return _run(texts, subtitles.parse_or_plain(texts), backend, language, catalogue, partitions)
