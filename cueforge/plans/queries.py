"""The engine's queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cueforge.functions import frames, prosody
from cueforge.operators import align, render, retention, synthesize, validate
from cueforge.plans import corpus, run
from cueforge.sources import sinks, subtitles, voices, wav

#: Frames a second in queries whose rows are frames.
LOW_RATE = 100
#: Frames of a chunk in those queries, so that files are of several.
LOW_CHUNK = 256
#: Milliseconds of a timeline in the query for cues beyond it.
LOW_CAP = 12_000
RETAINED_BYTES = 1000
# The voice catalogue that the queries choose from.
CATALOGUE = (("Albert", "en_US"), ("Daniel", "en_GB"), ("Mónica", "es_ES"), ("Paulina", "es_MX"), ("Thomas", "fr_FR"))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _file() -> Column:
    return F.col("file_id").cast("bigint").alias("file_id")


def _parsed(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return subtitles.parse(corpus.files(spark, sf_dir, **options))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesize.resolve(align.segments(_parsed(spark, sf_dir)))


_ROWS = "SELECT file_id, idx AS \"index\", CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM parsed"


@query(f"WITH {corpus.parsed_sql()} {_ROWS}")
def q1_srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(_file(), "index", "start_ms", "end_ms", "text")


@query(f"WITH {corpus.parsed_sql(malformed=True)} {_ROWS}")
def q2_srt_skip_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, malformed=True).select(_file(), "index", "start_ms", "end_ms", "text")


@query(f"WITH {corpus.parsed_sql()} SELECT DISTINCT {corpus._clock_sql('start_ms')} AS clock, CAST(start_ms AS BIGINT) AS ms FROM parsed")
def q3_timecode_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = subtitles.strip(F.col("lines")[1])
    rows = subtitles.blocks(corpus.files(spark, sf_dir)).select(F.substring(line, 1, 12).alias("clock"), subtitles.clock_ms(line).alias("ms"))
    return rows.distinct()


@query(f"WITH {corpus.parsed_sql(two_lines=True)} SELECT file_id, idx AS \"index\", text, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM parsed")
def q4_srt_multiline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, two_lines=True).select(_file(), "index", "text", F.size(F.split("text", "\n")).alias("n_lines"))


@query("SELECT doc_id AS file_id, CAST(1 AS BIGINT) AS \"index\", CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms, text FROM documents WHERE text IS NOT NULL")
def q5_plain_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_id"), F.col("text").alias("body"))
    return subtitles.parse_or_plain(docs).select(_file(), "index", "start_ms", "end_ms", "text")


_TAGGED = r"""tagged AS (
  SELECT *, regexp_extract_all(text, '<(\w+):(\w+)>', 1) AS names, regexp_extract_all(text, '<(\w+):(\w+)>', 2) AS vals, regexp_replace(text, '<(\w+):(\w+)>', '', 'g') AS clean FROM parsed
)"""


@query(f"WITH {corpus.parsed_sql()}, {_TAGGED} SELECT file_id, idx AS \"index\", CAST(i AS INTEGER) AS pos, names[i + 1] AS name, vals[i + 1] AS value FROM (SELECT *, unnest(range(len(names))) AS i FROM tagged)")
def q6_prosody_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).select(_file(), "index", F.posexplode(prosody.tags(F.col("text"))).alias("pos", "tag"))
    return rows.select("file_id", "index", "pos", "tag.name", "tag.value")


@query(f"WITH {corpus.parsed_sql()}, {_TAGGED} SELECT file_id, idx AS \"index\", clean FROM tagged")
def q7_prosody_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(_file(), "index", prosody.clean(F.col("text")).alias("clean"))


def _case(table: dict[str, int]) -> str:
    return "CASE v " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in table.items()) + " ELSE CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS BIGINT) END END"


# one row a tag; the last good of each name holds
_RESOLVED = f"""{_TAGGED}, one AS (
  SELECT file_id, ord, i, lower(names[i + 1]) AS n, lower(vals[i + 1]) AS v FROM (SELECT *, unnest(range(len(names))) AS i FROM tagged)
), good AS (
  SELECT file_id, ord, i, n, CASE n WHEN 'rate' THEN {_case(prosody.RATE_WPM)} WHEN 'pitch' THEN {_case(prosody.PITCH_BASE)} WHEN 'emotion' THEN CASE v {' '.join(f"WHEN '{k}' THEN {x}" for k, x in prosody.EMOTION_WPM.items())} END END AS x FROM one
), best AS (
  SELECT file_id, ord, max_by(x, i) FILTER (n = 'rate' AND x IS NOT NULL) AS r, max_by(x, i) FILTER (n = 'emotion' AND x IS NOT NULL) AS e, max_by(x, i) FILTER (n = 'pitch' AND x IS NOT NULL) AS p FROM good GROUP BY ALL
), resolved AS (
  SELECT tagged.*, CAST(coalesce(r, e) AS BIGINT) AS rate, CAST(p AS BIGINT) AS pitch FROM tagged LEFT JOIN best USING (file_id, ord)
)"""
_WITH_RESOLVED = f"WITH {corpus.parsed_sql()}, {_RESOLVED}"


@query(f"{_WITH_RESOLVED} SELECT file_id, idx AS \"index\", rate FROM resolved")
def q8_rate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(_file(), "index", prosody.rate(prosody.tags(F.col("text"))).alias("rate"))


@query(f"{_WITH_RESOLVED} SELECT file_id, idx AS \"index\", pitch FROM resolved")
def q9_pitch_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(_file(), "index", prosody.pitch(prosody.tags(F.col("text"))).alias("pitch"))


# rates and pitches are stretched first, so that both bounds are met
@query(f"""{_WITH_RESOLVED} SELECT file_id, idx AS "index", CASE WHEN rate IS NOT NULL THEN CAST(greatest(20, least(500, (rate - 150) * 5)) AS BIGINT) END AS rate,
  CASE WHEN pitch IS NOT NULL THEN CAST(greatest(-100, least(100, (pitch - 46) * 20)) AS BIGINT) END AS pitch FROM resolved""")
def q10_rate_pitch_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prosody.tags(F.col("text"))
    rate, pitch = (prosody.rate(found) - 150) * 5, (prosody.pitch(found) - 46) * 20
    return _parsed(spark, sf_dir).select(_file(), "index", prosody.clamp(rate, prosody.RATE_BOUNDS).alias("rate"), prosody.clamp(pitch, prosody.PITCH_BOUNDS).alias("pitch"))


@query(f"{_WITH_RESOLVED} SELECT file_id, idx AS \"index\", CASE WHEN pitch IS NULL THEN clean ELSE '[[ pbas ' || pitch || ' ]] ' || clean END AS spoken FROM resolved")
def q11_spoken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select(_file(), "index", "spoken")


_VOICES = "(VALUES " + ", ".join(f"({k}, '{n}', '{c}')" for k, (n, c) in enumerate(CATALOGUE)) + ") AS voices(pos, name, locale)"


@query(f"SELECT doc_id, lang, (SELECT name FROM {_VOICES} WHERE split_part(lower(locale), '_', 1) = split_part(lower(replace(lang, '-', '_')), '_', 1) ORDER BY (lower(locale) = lower(replace(lang, '-', '_'))) DESC, pos LIMIT 1) AS voice FROM documents")
def q12_voice_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k, *v) for k, v in enumerate(CATALOGUE)], "pos int, name string, locale string")
    return voices.select_voices(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), known, "lang").select("doc_id", "lang", "voice")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned segments with the stand-in duration of their spoken text: 60 ms a character."""
    return align.align(_segments(spark, sf_dir).withColumn("duration_ms", F.char_length("text").cast("bigint") * 60))


_TIMED = f"""WITH {corpus.parsed_sql()}, {_TAGGED}, timed AS (
  SELECT file_id, ord, idx, start_ms, end_ms, clean, length(clean) * 60 AS duration_ms,
    CASE WHEN end_ms > start_ms AND length(clean) * 60 > end_ms - start_ms THEN CAST(end_ms - start_ms AS DOUBLE) / CAST(length(clean) * 60 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS stretch_ratio FROM tagged
)"""


@query(f"{_TIMED} SELECT file_id, idx AS \"index\", CAST(duration_ms AS BIGINT) AS duration_ms, stretch_ratio FROM timed")
def q13_align_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select(_file(), "index", "duration_ms", "stretch_ratio")


@query(f"{_TIMED} SELECT file_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, stretch_ratio, clean AS text FROM timed")
def q14_segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.plan(_timed(spark, sf_dir)).select(_file(), "start_ms", "end_ms", "stretch_ratio", "text")


@query(f"WITH {corpus.parsed_sql(malformed=True)} SELECT bodies.file_id, count(parsed.idx) AS segments FROM bodies LEFT JOIN parsed USING (file_id) GROUP BY bodies.file_id")
def q15_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir, malformed=True)
    return align.summary(files, subtitles.parse(files)).select(_file(), "segments")


@query(f"WITH {corpus.parsed_sql()} SELECT file_id, idx AS \"index\", 'beyond the timeline' AS error FROM parsed WHERE greatest(start_ms, end_ms) > {LOW_CAP}")
def q16_timeline_cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(_parsed(spark, sf_dir), LOW_CAP).select(_file(), "index", "error")


@query(f"""SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank, CAST(running_bytes AS BIGINT) AS running_bytes FROM (
  SELECT event_id, user_id, row_number() OVER w AS rank, sum(CAST(floor(value) AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_bytes
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)
) WHERE rank = 1 OR (rank <= {retention.MOST_JOBS} AND running_bytes <= {RETAINED_BYTES})""")
def q17_job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.floor("value").alias("bytes"))
    return retention.retained(jobs, "user_id", "event_id", "bytes", most_bytes=RETAINED_BYTES).select("event_id", "user_id", "rank", "running_bytes")


@query("SELECT source AS stem, doc_id, inputs FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r, count(*) OVER (PARTITION BY source) AS inputs FROM documents) WHERE r = 1")
def q18_stem_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return retention.last_of_stem(docs.select(F.col("source").alias("stem"), "doc_id"), position="doc_id").select("stem", "doc_id", "inputs")


_FRAMES = lambda ms, rate: f"CAST(round_even({ms} * {rate} / CAST(1000 AS DOUBLE), 0) AS BIGINT)"


@query(f"{_TIMED} SELECT file_id, idx AS \"index\", {_FRAMES('start_ms', 22050)} AS start_frame, {_FRAMES('(end_ms - start_ms)', 22050)} AS window_frames, {_FRAMES('duration_ms', 22050)} AS audio_frames FROM timed")
def q19_frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: frames.frames(c, 22_050)
    return _timed(spark, sf_dir).select(_file(), "index", at(F.col("start_ms")).alias("start_frame"), at(F.col("end_ms") - F.col("start_ms")).alias("window_frames"), at(F.col("duration_ms")).alias("audio_frames"))


_SPEEDS = (8000, 16000, 22050, 44100)


@query(f"WITH {corpus.CUES_SQL}, n AS (SELECT file_id, idx, length(text) * 997 AS n_frames, CASE (file_id + ord) % 4 {' '.join(f'WHEN {k} THEN {r}' for k, r in enumerate(_SPEEDS))} END AS rate FROM cues) SELECT file_id, idx AS \"index\", CAST(n_frames * 1000 // rate AS BIGINT) AS duration_ms FROM n")
def q20_wav_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*map(F.lit, _SPEEDS)), ((F.col("file_id") + F.col("ord")) % 4 + 1).cast("int"))
    return corpus.cues(spark, sf_dir).select("file_id", "index", frames.wav_duration_ms(F.char_length("text").cast("bigint") * 997, rate).alias("duration_ms"))


_SPAN = f"max({_FRAMES('start_ms', 22050)} + CASE WHEN end_ms > start_ms THEN {_FRAMES('(end_ms - start_ms)', 22050)} ELSE {_FRAMES('duration_ms', 22050)} END)"


@query(f"{_TIMED} SELECT file_id, {_SPAN} AS frames, CAST({_SPAN} * 1000 // 22050 AS BIGINT) AS span_ms FROM timed GROUP BY file_id")
def q21_timeline_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = align.span(_timed(spark, sf_dir), 22_050).select(_file(), "frames")
    return spans.withColumn("span_ms", frames.wav_duration_ms(F.col("frames"), F.lit(22_050)))


_SIGNAL = f"""signal AS (
  SELECT file_id, ord, start_ms, amp, {_FRAMES('start_ms', LOW_RATE)} AS f,
    CASE WHEN end_ms > start_ms THEN least({_FRAMES('duration_ms', LOW_RATE)}, {_FRAMES('(end_ms - start_ms)', LOW_RATE)}) ELSE {_FRAMES('duration_ms', LOW_RATE)} END AS n FROM cues
), frame AS (SELECT file_id, ord, start_ms, amp, unnest(range(f, f + n)) AS frame FROM signal)"""


class Steady:
    """A backend whose audio is one amplitude for the cue's stand-in duration."""

    def __init__(self, rate: int) -> None:
        self.rate = rate

    def synthesize(self, segment: dict) -> bytes:
        return wav.encode(np.full(round(segment["wanted_ms"] * self.rate / 1000), segment["amp"], np.int16), self.rate)


def _steady(spark: SparkSession, sf_dir: str, rate: int) -> DataFrame:
    """Cues with audio of a rate, synthesised."""
    rows = corpus.cues(spark, sf_dir).select(F.col("file_id").cast("string").alias("file_id"), "ord", "index", "start_ms", "end_ms", "amp", F.col("duration_ms").alias("wanted_ms"))
    return synthesize.synthesize(rows, Steady(rate))


def _mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """Rows (tuples) that a function gives for each row of df (a dict), in Arrow batches."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for x in batch.to_pylist() for r in row(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kind)], names=kind.names)

    return df.mapInArrow(run, schema)


@query(f"""WITH {corpus.CUES_SQL}, {_SIGNAL} SELECT * FROM (
  SELECT file_id, frame, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(amp ORDER BY start_ms, ord)), lambda a, x: greatest(-32768, least(32767, a + x))) AS INTEGER) AS sample
  FROM frame GROUP BY file_id, frame) WHERE sample <> 0""")
def q22_overlap_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole timelines as they are rendered, at a low rate; frames that sound."""
    chunks = render.render(_steady(spark, sf_dir, LOW_RATE), LOW_RATE, chunk=LOW_CHUNK)

    def samples(x: dict) -> Iterator[tuple]:
        pcm = np.frombuffer(x["pcm"], "<i2")
        return ((int(x["file_id"]), x["chunk"] * LOW_CHUNK + k, int(pcm[k])) for k in np.flatnonzero(pcm).tolist())

    return _mapped(chunks, "file_id bigint, frame bigint, sample int", samples)


_SAMPLES = "list_transform(range(ord + 3), lambda i: CAST((idx * 7919 + i * 3571 * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) % 30000 AS BIGINT))"


@query(f"""WITH {corpus.CUES_SQL}, s AS (SELECT file_id, idx, {_SAMPLES} AS s, length(text) % 29 + 1 AS t FROM cues), g AS (
  SELECT *, len(s) AS n, CASE WHEN t > 1 THEN CAST(len(s) - 1 AS DOUBLE) / (t - 1) ELSE CAST(0 AS DOUBLE) END AS step FROM s)
  SELECT file_id, idx AS "index", array_to_string(CASE WHEN n = t THEN s ELSE list_transform(range(t), lambda i:
    CAST(trunc(s[CAST(floor(i * step) AS BIGINT) + 1] + (coalesce(s[CAST(floor(i * step) AS BIGINT) + 2], s[CAST(floor(i * step) AS BIGINT) + 1]) - s[CAST(floor(i * step) AS BIGINT) + 1]) * (i * step - floor(i * step))) AS BIGINT)) END, ',') AS fitted FROM g""")
def q23_fit_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, (F.char_length("text") % 29 + 1).cast("bigint").alias("target"))
    return _mapped(rows, "file_id bigint, index bigint, fitted string", lambda x: [(x["file_id"], x["index"], ",".join(map(str, render.fit(np.array(x["samples"], np.int16), x["target"]).tolist())))])


def _samples(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    value = lambda i: ((F.col("index") * 7919 + i * 3571 * F.when(i % 2 == 0, 1).otherwise(-1)) % 30000).cast("bigint")
    return corpus.cues(spark, sf_dir).select("file_id", "index", F.transform(F.sequence(F.lit(0), F.col("ord") + 2), value).alias("samples"), *more)


@query(f"""WITH {corpus.CUES_SQL}, s AS (SELECT file_id, idx, {_SAMPLES} AS s, file_id % 2 + 2 AS c FROM cues)
  SELECT file_id, idx AS "index", array_to_string(list_transform(range(len(s) // c), lambda i: CAST(floor(list_sum(s[i * c + 1:(i + 1) * c]) / c) AS BIGINT)), ',') AS mono FROM s""")
def q24_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV files of several channels, decoded."""
    rows = _samples(spark, sf_dir, (F.col("file_id") % 2 + 2).cast("int").alias("channels"))
    decoded = lambda x: wav.decode(wav.encode(np.array(x["samples"], np.int16), 8000, x["channels"]))[0].tolist()
    return _mapped(rows, "file_id bigint, index bigint, mono string", lambda x: [(x["file_id"], x["index"], ",".join(map(str, decoded(x))))])


@query(f"""{_WITH_RESOLVED} SELECT file_id, idx AS "index", CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, clean AS text, rate, pitch,
  CASE WHEN end_ms > start_ms AND length(clean) * 60 > end_ms - start_ms THEN CAST(end_ms - start_ms AS DOUBLE) / CAST(length(clean) * 60 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS stretch_ratio FROM resolved""")
def q25_end_to_end_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select(_file(), "index", "start_ms", "end_ms", "text", "rate", "pitch", "stretch_ratio")


@query(f"{_TIMED} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ord) - 1 AS pos, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, stretch_ratio, clean AS text FROM timed")
def q26_plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON plans, read again."""
    written = sinks.plan_json(corpus.files(spark, sf_dir), align.plan(_timed(spark, sf_dir)))
    cues = F.from_json("json", "array<struct<start_ms:bigint,end_ms:bigint,stretch_ratio:double,text:string>>")
    return written.select(_file(), F.posexplode(cues).alias("pos", "c")).select("file_id", F.col("pos").cast("bigint").alias("pos"), "c.*")


@query(f"{_TIMED} SELECT file_id, '[' || start_ms || '–' || end_ms || '] ' || clean AS line FROM timed")
def q27_console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.console(align.plan(_timed(spark, sf_dir))).select(_file(), "line")


@query(f"WITH {corpus.CUES_SQL} SELECT file_id, idx AS \"index\", 44 + 2 * {_FRAMES('duration_ms', 8000)} AS bytes, CAST({_FRAMES('duration_ms', 8000)} * 1000 // 8000 AS BIGINT) AS duration_ms FROM cues")
def q28_synthesize_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steady(spark, sf_dir, 8000).select(_file(), "index", F.length("audio").cast("bigint").alias("bytes"), "duration_ms")


_LOW_SPAN = f"max({_FRAMES('start_ms', LOW_RATE)} + CASE WHEN end_ms > start_ms THEN {_FRAMES('(end_ms - start_ms)', LOW_RATE)} ELSE {_FRAMES('duration_ms', LOW_RATE)} END)"


@query(f"WITH {corpus.CUES_SQL} SELECT file_id, {_LOW_SPAN} AS frames, 44 + 2 * {_LOW_SPAN} AS bytes, substr(hex(CAST('RIFF' AS BLOB)), 1, 8) AS mark FROM cues GROUP BY file_id")
def q29_wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered files, decoded again."""
    whole = sinks.wav_files(render.render(_steady(spark, sf_dir, LOW_RATE), LOW_RATE, chunk=LOW_CHUNK), LOW_RATE)
    return _mapped(whole, "file_id bigint, frames bigint, bytes bigint, mark string", lambda x: [(int(x["file_id"]), len(wav.decode(x["wav"])[0]), len(x["wav"]), x["wav"][:4].hex().upper())])


@query(f"WITH {corpus.CUES_SQL}, n AS (SELECT file_id, idx, length(text) * 17 AS n, CASE (file_id + ord) % 4 {' '.join(f'WHEN {k} THEN {r}' for k, r in enumerate(_SPEEDS))} END AS rate FROM cues) SELECT file_id, idx AS \"index\", CAST(round_even(n * 22050 / CAST(rate AS DOUBLE), 0) AS BIGINT) AS n_samples FROM n")
def q30_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*map(F.lit, _SPEEDS)), ((F.col("file_id") + F.col("ord")) % 4 + 1).cast("int"))
    rows = corpus.cues(spark, sf_dir).select("file_id", "index", (F.char_length("text") * 17).alias("n"), rate.alias("rate"))
    return _mapped(rows, "file_id bigint, index bigint, n_samples bigint", lambda x: [(x["file_id"], x["index"], len(render.resample(np.arange(x["n"]).astype(np.int16), x["rate"], 22_050)))])


# A listing of voices, with lines that are none.
_LISTED = tuple(f"{name:<20}{code}    # sample" for name, code in CATALOGUE) + ("no voice here", "Bad en_US # narrow gap", "Two Words           pt-BR  # sample")
_PARSED = (*((k, n, c) for k, (n, c) in enumerate(CATALOGUE)), (len(CATALOGUE) + 2, "Two Words", "pt-BR"))
_PARSED_SQL = "(VALUES " + ", ".join(f"(CAST({k} AS INTEGER), '{n}', '{c}')" for k, n, c in _PARSED) + ") AS v(pos, name, locale)"


def _listing(spark: SparkSession) -> DataFrame:
    return voices.parse_catalogue(spark.createDataFrame(list(enumerate(_LISTED)), "pos int, line string"))


@query(f"SELECT pos, name, locale FROM {_PARSED_SQL}")
def q31_voice_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark)


@query(f"SELECT string_agg(base, ', ' ORDER BY base) AS languages FROM (SELECT DISTINCT split_part(lower(replace(locale, '-', '_')), '_', 1) AS base FROM {_PARSED_SQL})")
def q32_base_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.base_languages(_listing(spark))


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 50 = 0 THEN 'too large' WHEN doc_id % 7 = 0 THEN 'not UTF-8' END AS reject FROM documents")
def q33_upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    large = F.repeat(F.lit("x"), subtitles.UPLOAD_BYTES + 1).cast("binary")
    content = F.when(F.col("text").isNotNull(), F.when(F.col("doc_id") % 50 == 0, large).when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("C328"))).otherwise(F.col("text").cast("binary")))
    return subtitles.accept_uploads(docs.select("doc_id", content.alias("content"))).select("doc_id", "reject")


@query(f"""WITH {corpus.CUES_SQL}, e AS (SELECT file_id, idx, CASE WHEN start_ms - 150 < 0 THEN 'negative start' WHEN greatest(start_ms, end_ms) - 150 > {LOW_CAP} THEN 'beyond the timeline' WHEN (file_id + ord) % 17 = 0 THEN 'no audio' END AS error FROM cues)
  SELECT file_id, idx AS "index", error FROM e WHERE file_id IN (SELECT file_id FROM e WHERE error IS NOT NULL)""")
def q34_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cues of files with a cue that starts too early, ends too late or has no audio."""
    audio = F.when((F.col("file_id") + F.col("ord")) % 17 != 0, F.lit(b"audio"))
    rows = corpus.cues(spark, sf_dir).select("file_id", "index", (F.col("start_ms") - 150).alias("start_ms"), (F.col("end_ms") - 150).alias("end_ms"), audio.alias("audio"))
    return validate.quarantine(rows, LOW_CAP)[1].select("file_id", "index", "error")


@query(f"{_TIMED} SELECT file_id, idx AS \"index\", stretch_ratio FROM timed")
def q35_align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as a table of their own, joined by place."""
    segments = _segments(spark, sf_dir)
    durations = segments.select("file_id", "ord", (F.char_length("text").cast("bigint") * 60).alias("duration_ms"))
    return align.align_pairs(segments, durations).select(_file(), "index", "stretch_ratio")


@query(f"WITH {corpus.CUES_SQL} SELECT file_id, idx AS \"index\", CAST(CASE (file_id + ord) % 4 WHEN 0 THEN 22050 WHEN 1 THEN 16000 WHEN 2 THEN 8000 ELSE 22050 END AS INTEGER) AS rate FROM cues")
def q36_logged_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = (["starting", "[1, 2]"], ["starting", '{"audio": {"sample_rate": 16000}}'], ["{broken", '{"audio": {"sample_rate": "x"}}', '{"audio": {"sample_rate": "8000"}}'], ['{"audio": {}}', '{"audio": {"sample_rate": 8000}}'])
    rows = corpus.cues(spark, sf_dir).select("file_id", "index", ((F.col("file_id") + F.col("ord")) % 4).alias("kind"))
    return _mapped(rows, "file_id bigint, index bigint, rate int", lambda x: [(x["file_id"], x["index"], wav.logged_rate(logs[x["kind"]]))])


@query(f"{_TIMED} SELECT file_id, idx AS \"index\", CAST((length(clean) * 60 * 22050 // 1000) * 1000 // 22050 AS BIGINT) AS duration_ms FROM timed")
def q37_run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with the stand-in voice: parsed, tagged, synthesised, timed."""
    return run.run_texts(corpus.files(spark, sf_dir), synthesize.Tone()).timed.select(_file(), "index", "duration_ms")
