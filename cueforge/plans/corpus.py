"""Subtitle files made from the driver's conversations, for Spark and for DuckDB.

A conversation is a file and a turn a cue. Times overlap, some windows are
empty, tags cycle through the cases, and some blocks can be made malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ("", "<emotion:happy>", "<rate:slow>", "<emotion:excited><rate:fast>", "<emotion:calm><pitch:low>", "<rate:185>", "<pitch:high>", "<mood:odd>", "<rate:x-slow>")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files should parse to, with the stand-in duration and amplitude of each cue."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    conv, turn, size = F.col("conv_id"), F.col("turn"), F.char_length("text").cast("bigint")
    start = turn * 2500 + (conv * 37) % 400
    tag = F.element_at(F.array(*map(F.lit, TAGS)), ((conv * 7 + turn) % len(TAGS) + 1).cast("int"))
    return rows.select(
        conv.alias("file_id"), turn.cast("int").alias("ord"), (turn + 1).alias("index"), start.alias("start_ms"),
        (start + F.when((conv + turn) % 11 == 0, 0).otherwise(1500 + (size * 7) % 6000)).alias("end_ms"),
        F.concat(tag, F.col("text")).alias("text"), (size * 60).alias("duration_ms"),
        ((20000 + (conv * 131 + turn * 7919) % 10000) * F.when(turn % 3 < 2, 1).otherwise(-1)).alias("amp"),
    )


def clock(ms: Column) -> Column:
    whole = lambda unit: F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def files(spark: SparkSession, sf_dir: str, malformed: bool = False, two_lines: bool = False) -> DataFrame:
    """(file_id string, body): one subtitle text for each conversation."""
    rows = cues(spark, sf_dir)
    kind = (F.col("file_id") + F.col("ord")) % 13 if malformed else F.lit(9)
    first = F.concat(F.when(kind == 0, "x").otherwise(""), F.col("index").cast("string"))
    line = F.concat(clock(F.col("start_ms")), F.when(kind == 1, " -> ").otherwise(" --> "), clock(F.col("end_ms")))
    text = F.regexp_replace("text", "^([^ ]*) ", "$1\n") if two_lines else F.col("text")
    block = F.concat(first, F.lit("\n"), line, F.when(kind == 2, "").otherwise(F.concat(F.lit("\n"), text)))
    parts = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("block")))).alias("blocks"))
    return parts.select(F.col("file_id").cast("string").alias("file_id"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("body"))


_TAG_SQL = " ".join(f"WHEN {k} THEN '{tag}'" for k, tag in enumerate(TAGS))
CUES_SQL = f"""
cues AS (
  SELECT conv_id AS file_id, turn AS ord, turn + 1 AS idx, turn * 2500 + (conv_id * 37) % 400 AS start_ms,
    turn * 2500 + (conv_id * 37) % 400 + CASE WHEN (conv_id + turn) % 11 = 0 THEN 0 ELSE 1500 + (length(text) * 7) % 6000 END AS end_ms,
    CASE (conv_id * 7 + turn) % {len(TAGS)} {_TAG_SQL} END || text AS text, length(text) * 60 AS duration_ms,
    (20000 + (conv_id * 131 + turn * 7919) % 10000) * CASE WHEN turn % 3 < 2 THEN 1 ELSE -1 END AS amp
  FROM conversations
)"""


def _clock_sql(ms: str) -> str:
    part = lambda expression, width: f"lpad(CAST({expression} AS VARCHAR), {width}, '0')"
    return f"{part(f'{ms} // 3600000', 2)} || ':' || {part(f'{ms} // 60000 % 60', 2)} || ':' || {part(f'{ms} // 1000 % 60', 2)} || ',' || {part(f'{ms} % 1000', 3)}"


def parsed_sql(malformed: bool = False, two_lines: bool = False) -> str:
    """CTEs that end in parsed(file_id, ord, idx, start_ms, end_ms, text), read back from whole file texts."""
    kind = "(file_id + ord) % 13" if malformed else "9"
    text = r"regexp_replace(text, '^([^ ]*) ', '\1' || chr(10))" if two_lines else "text"
    clock = r"([0-9]{2}):([0-9]{2}):([0-9]{2}),([0-9]{3})"
    code = rf"^{clock}\s*-->\s*{clock}"
    ms = lambda k: " + ".join(f"CAST(regexp_extract(lines[2], '{code}', {k + i}) AS BIGINT) * {unit}" for i, unit in enumerate((3_600_000, 60_000, 1000, 1)))
    return rf"""{CUES_SQL}, bodies AS (
  SELECT file_id, string_agg(CASE WHEN {kind} = 0 THEN 'x' ELSE '' END || idx || chr(10) || {_clock_sql('start_ms')} || CASE WHEN {kind} = 1 THEN ' -> ' ELSE ' --> ' END || {_clock_sql('end_ms')}
    || CASE WHEN {kind} = 2 THEN '' ELSE chr(10) || {text} END, chr(10) || chr(10) ORDER BY ord) AS body
  FROM cues GROUP BY file_id
), blocks AS (
  SELECT file_id, unnest(range(len(b))) AS ord, unnest(b) AS block FROM (SELECT file_id, string_split_regex(body, '\n\s*\n') AS b FROM bodies)
), cut AS (
  SELECT file_id, ord, string_split(block, chr(10)) AS lines FROM blocks
), parsed AS (
  SELECT file_id, ord, CAST(lines[1] AS BIGINT) AS idx, {ms(1)} AS start_ms, {ms(5)} AS end_ms, array_to_string(lines[3:], chr(10)) AS text
  FROM cut WHERE len(lines) >= 3 AND regexp_matches(lines[1], '^[0-9]+$') AND regexp_matches(lines[2], '{code}')
)"""
