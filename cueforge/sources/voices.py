"""Voice catalogues and the choice of a voice for a language."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueforge.functions.text import strip

#: Where a listing's line tells the locale: a code of two parts between a wide gap and the mark of a sample text.
CODE = r"\s{2,}(\p{Alpha}{2,3}[_-]\p{Alpha}{2,})\s+#"


def installed(spark: SparkSession, timeout_s: int = 30) -> DataFrame:
    """The voices of this machine's `say`, asked once on the driver; what is asked for must also be on the executors."""
    if shutil.which("say") is None:
        raise RuntimeError("'say' not found; its voices are not available here")
    listing = subprocess.run(["say", "-v", "?"], check=True, capture_output=True, text=True, timeout=timeout_s).stdout
    return parse_catalogue(spark.createDataFrame(list(enumerate(listing.splitlines())), "pos int, line string"))


def parse_catalogue(lines: DataFrame) -> DataFrame:
    """Voices of a listing's lines (pos, line): (pos, name, locale); other lines are ignored."""
    line = F.col("line")
    name = F.get(F.split(line, CODE, 2), F.lit(0))
    return lines.where(line.rlike(CODE)).select("pos", strip(name).alias("name"), F.regexp_extract(line, CODE, 1).alias("locale"))


def normal_locale(locale: Column) -> Column:
    return F.lower(F.replace(locale, F.lit("-"), F.lit("_")))


def select_voices(languages: DataFrame, voices: DataFrame, column: str = "language", strict: bool = False) -> DataFrame:
    """Add voice to rows with a language: an exact locale, else the first of its base language.

    An empty language has no voice. One without any fails under strict and
    gets null otherwise. The choice is made once for each distinct language.
    """
    known = voices.select("pos", "name", normal_locale(F.col("locale")).alias("locale"))
    wanted = languages.select(F.col(column).alias("language")).where("language <> ''").distinct()
    wanted = wanted.withColumn("norm", normal_locale(F.col("language"))).withColumn("base", F.split_part("norm", F.lit("_"), F.lit(1)))
    pairs = wanted.join(known.withColumn("base", F.split_part("locale", F.lit("_"), F.lit(1))), "base")
    first = Window.partitionBy("language").orderBy((F.col("locale") == F.col("norm")).desc(), "pos")
    best = pairs.withColumn("rank", F.row_number().over(first)).where("rank = 1").select(F.col("language").alias("_language"), F.col("name").alias("voice"))
    out = languages.join(best, F.col(column) == F.col("_language"), "left").drop("_language")
    if strict:
        missing = F.concat(F.lit("no voice for language "), F.col(column))
        out = out.withColumn("voice", F.when(F.col("voice").isNull() & (F.col(column) != ""), F.raise_error(missing).cast("string")).otherwise(F.col("voice")))
    return out


def base_languages(voices: DataFrame) -> DataFrame:
    """One row: the sorted base languages of a catalogue, joined by commas."""
    base = F.split_part(normal_locale(F.col("locale")), F.lit("_"), F.lit(1))
    return voices.agg(F.array_join(F.array_sort(F.collect_set(base)), ", ").alias("languages"))
