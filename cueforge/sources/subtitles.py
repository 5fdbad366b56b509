"""Subtitle texts as cue tables.

A file is one row until its blocks are exploded; cues keep their place in the
file (ord). All of it is expressions in one narrow stage.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.functions.text import LINE_END, SPACE, ascii_digits, integer, strip

#: Bytes of a subtitle upload.
UPLOAD_BYTES = 1 << 20

_CLOCK = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"
TIMECODE = rf"^{_CLOCK}[{SPACE}]*-->[{SPACE}]*{_CLOCK}"
#: The same, with the second clock whole; the first is the line's first twelve characters.
_SECOND = rf"^{_CLOCK.replace('(', '(?:')}[{SPACE}]*-->[{SPACE}]*({_CLOCK.replace('(', '(?:')})"


def read_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file_id, body) of every file that a path or glob names; file_id is the path.

    Line ends become line feeds. strict: a file that is no UTF-8 fails the
    query, as it is read; else its body is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    body = F.when(F.is_valid_utf8(text), text)
    if strict:
        body = F.coalesce(body, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    read = files.select(F.col("path").alias("file_id"), F.regexp_replace(body, "\r\n?", "\n").alias("body"))
    # the scan passes over files of no bytes; the listing has them
    names = [(re.sub(r"^([\w+.-]+):///", r"\1:/", unquote(f)),) for f in files.inputFiles()]
    listed = spark.createDataFrame(names, "file_id string")
    empty = listed.join(files.select(F.col("path").alias("file_id")), "file_id", "left_anti").withColumn("body", F.lit(""))
    return read.unionByName(empty)


def accept_uploads(files: DataFrame, content: str = "content") -> DataFrame:
    """Add reject (null, 'too large' or 'not UTF-8') to uploads; sizes are judged before texts."""
    data = F.col(content)
    return files.withColumn("reject", F.when(F.length(data) > UPLOAD_BYTES, "too large").when(~F.is_valid_utf8(data.cast("string")), "not UTF-8"))


def clock_ms(clock: Column) -> Column:
    """Milliseconds of a clock 00:00:00,000, which a text may follow."""
    part = [F.substring(clock, at, size).try_cast("bigint") for at, size in ((1, 2), (4, 2), (7, 2), (10, 3))]
    return part[0] * 3_600_000 + part[1] * 60_000 + part[2] * 1000 + part[3]


def _split(body: Column) -> Column:
    return F.split(strip(body), f"\n[{SPACE}]*\n")


def _lines(block: Column) -> Column:
    return F.split(strip(block), LINE_END)


def _timecode(lines: Column) -> Column:
    return ascii_digits(strip(F.get(lines, F.lit(1))))


def has_cue(body: Column) -> Column:
    """Whether any block of a body is a cue."""

    def cue(block: Column) -> Column:
        # an array of one binds the lines once
        return F.exists(F.array(_lines(block)), lambda x: (F.size(x) >= 3) & integer(F.get(x, F.lit(0))).isNotNull() & _timecode(x).rlike(TIMECODE))

    return F.exists(_split(body), cue)


def blocks(docs: DataFrame) -> DataFrame:
    """(file_id, ord, lines): the blank-line blocks of each body, in order."""
    split = docs.select("file_id", F.posexplode(_split(F.col("body"))).alias("ord", "block"))
    return split.select("file_id", "ord", _lines(F.col("block")).alias("lines"))


def parse(docs: DataFrame) -> DataFrame:
    """Cues of (file_id, body): (file_id, ord, index, start_ms, end_ms, text).

    A block is skipped if it has under three lines, no whole number in the
    first, or no timecode at the start of the second. Text after a timecode is
    ignored. A null body has no cues.
    """
    split = docs.select("file_id", F.posexplode(_split(F.col("body"))).alias("ord", "block"))
    # lambdas over arrays of one, and the generator, bind each line once; the timecode is matched once

    def cue(x: Column) -> Column:
        line = F.transform(F.array(_timecode(x)), lambda t: F.struct(x.alias("lines"), integer(F.get(x, F.lit(0))).alias("index"), t.alias("line"), F.regexp_extract(t, _SECOND, 1).alias("second")))
        return F.when(F.size(x) >= 3, F.get(line, F.lit(0)))

    rows = split.select("file_id", "ord", F.explode(F.transform(F.array(_lines(F.col("block"))), cue)).alias("c"))
    rows = rows.where(F.col("c.index").isNotNull() & (F.col("c.second") != ""))
    text = F.array_join(F.slice("c.lines", F.lit(3), F.size("c.lines")), "\n")
    return rows.select("file_id", "ord", "c.index", clock_ms(F.col("c.line")).alias("start_ms"), clock_ms(F.col("c.second")).alias("end_ms"), text.alias("text"))


def parse_or_plain(docs: DataFrame) -> DataFrame:
    """parse(), but a body without any cue is one cue of its whole text, (1, 0, 0), at ord 0."""
    plain = docs.where(F.col("body").isNotNull() & ~has_cue(F.col("body")))
    zero = F.lit(0).cast("bigint")
    whole = plain.select("file_id", F.lit(0).alias("ord"), F.lit(1).cast("bigint").alias("index"), zero.alias("start_ms"), zero.alias("end_ms"), F.col("body").alias("text"))
    # both are narrow; no text is shuffled to learn which files have cues
    return parse(docs).unionByName(whole)
