"""Document quality by text measures and cross-document line frequency, in DataFrame functions only.

Base measures are taken from each whole text in place, without a shuffle. Then
lines are normalised and hashed, and for every host the distinct texts that
hold a line are counted; a line in too many of them is boilerplate. A document
that is left with too little once its boilerplate lines are gone is rejected,
and the text without them can be returned.

Copies of one text on one host count once. Lines of every length are counted;
those of more than LINE_WORDS words are often paragraphs of near copies, so of
the texts that the lines in question make up almost alone (which would be
depleted) all together count as one. A document which was copied often,
changed or not, thus does not deplete itself. Lines are counted with a partial
aggregation, and the few above the limit are broadcast, or replicated to SALTS
parts before the documents' lines meet them: no line or host, however common,
is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import NARROW_ROWS, checkpointed, narrow, text_bytes

#: A document of fewer words, or with more than this percentage of repeated words, fails.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Lines of more words may be paragraphs, and are counted in groups of near copies.
LINE_WORDS = 16
#: A line is boilerplate in more than this many distinct texts of a host and more than this percentage of them.
LINE_TEXTS, LINE_PERCENT = 20, 1
#: A document that loses more than this percentage of its words, or falls under LEAST_WORDS, is depleted.
MOST_LOST = 60
SALTS = 16
#: Bytes of text whose lines are one part of a checkpoint.
PART_BYTES = 4 << 20
#: Boilerplate lines, and texts that hold them, that are broadcast; more are joined by a shuffle.
BROADCAST_LINES, BROADCAST_TEXTS = 100_000, 200_000

_SPACE = r"[\x20\x09-\x0D]+"
#: White space within a line.
_BLANKS = r"[\x20\x09\x0B-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz000000000"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def normal(line: Column) -> Column:
    """A line for comparison: A-Z lower-cased, digits made 0, white space runs one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), _SPACE, " "))


def repeated_words(w: Column) -> Column:
    """Words of the array w that lie in a window of five words found twice or more.

    Windows are compared by 64-bit hash. Only arrays with an equal pair of
    windows are sorted; neighbours in that order then mark the places.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(WINDOW))))

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            beside = lambda x, k, step: F.coalesce(F.get(s, k + step).getField("h") == x.getField("h"), F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: beside(x, k, -1) | beside(x, k, 1)), lambda x: x.getField("i")))

        marked = F.transform(F.array(order), places)
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a.getField("n") + p + WINDOW - F.greatest(a.getField("end"), p)).alias("n"))
        return F.get(F.transform(marked, lambda p: F.aggregate(p, start, step).getField("n")), F.lit(0))

    # one-element arrays bind a value once
    found = F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(F.get(found, F.lit(0)))


def _measures(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols and n_dup_lines of a text; n_words and n_repeat_words need its words."""
    full = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    size = lambda x: F.char_length(x).cast("long")
    return {
        "word_chars": size(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": size(text) - size(F.translate(text, "#*$%&|<>", "")),
        "n_dup_lines": F.get(F.transform(F.array(full), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
    }


def _lines(text: Column) -> Column:
    """The normalised lines of a text that have words, each as (hash, words)."""
    lines = F.split(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BLANKS, " "), "\n")
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")  # noqa: PLW0108
    return F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.octet_length(x) - F.octet_length(F.translate(x, " ", "")) + 1).alias("n")))


def _depleted(n: Column, lost: Column) -> Column:
    return (lost > 0) & ((n - lost < LEAST_WORDS) | (lost * 100 > n * MOST_LOST))


def _found(texts: DataFrame, often: DataFrame) -> DataFrame:
    """(_row, host, words, line, n) of the lines of texts that are among often (checkpointed)."""
    lines = texts.select("_row", "host", "words", F.explode("lines").alias("x")).select("_row", "host", "words", "x.line", "x.n")
    if often.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(often), ["host", "line"])
    salted = often.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return lines.withColumn("salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])


def boilerplate(texts: DataFrame, most: int) -> DataFrame:
    """(host, line) of the lines above both limits; texts: host, _row (a hash of host and text), words, lines, each text of a host once; most: the lines of all."""
    short = F.exists("lines", lambda x: x.getField("n") <= LINE_WORDS)
    # short lines are held against the texts that have any
    hosts = checkpointed(narrow(texts.groupBy("host").agg(F.count("*").alias("texts"), F.count(F.when(short, 1)).alias("short_texts")), most))
    lines = texts.select("host", F.explode(F.array_distinct("lines")).alias("x")).select("host", "x.line", "x.n")
    often = lines.groupBy("host", "line").agg(F.count("*").alias("found"), F.first("n").alias("n")).where(F.col("found") > LINE_TEXTS).join(hosts, "host")
    often = often.where(F.col("found") * 100 > F.when(F.col("n") <= LINE_WORDS, F.col("short_texts")).otherwise(F.col("texts")) * LINE_PERCENT)
    often = checkpointed(narrow(often.select("host", "line", F.col("n").alias("size")), most))
    sure, long = often.where(F.col("size") <= LINE_WORDS).select("host", "line"), often.where(F.col("size") > LINE_WORDS)
    if long.isEmpty():
        return sure
    held = _found(texts, often).groupBy("host", "_row").agg(F.first("words").alias("words"), F.sum("n").alias("lost"), F.collect_set(F.when(F.col("size") > LINE_WORDS, F.col("line"))).alias("long"))
    held = held.select("host", _depleted(F.col("words"), F.col("lost")).cast("int").alias("copy"), F.explode("long").alias("line"))
    groups = held.groupBy("host", "line").agg((F.sum(1 - F.col("copy")) + F.max("copy")).alias("found")).where(F.col("found") > LINE_TEXTS).join(hosts, "host")
    return checkpointed(narrow(sure.union(groups.where(F.col("found") * 100 > F.col("texts") * LINE_PERCENT).select("host", "line")), most))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] = (), cleaned_col: str | None = None) -> DataFrame:
    """Measure and judge every whole text.

    Returns (keep..., id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lost_words long, base_failed, kept boolean), one row for
    each row in; an empty table gives an empty one, and texts may be of any
    length. A null text counts as empty and fails the base rules; a null
    host is a host of its own; ids may be null or repeated; columns of df that
    are not named are not read. keep names further columns to return.
    cleaned_col names a last column for the text without its boilerplate lines
    (null stays null); the measures are those of the text as it came. The
    lines' hashes go to the shared checkpoint folder in eager steps.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    row = F.xxhash64(host, text)
    docs = df.select(row.alias("_row"), host.alias("host"), _lines(text).alias("lines")).where(F.size("lines") > 0)
    # equal texts of a host get equal answers, so each is asked once
    texts = docs.groupBy("_row").agg(F.first("host").alias("host"), F.first("lines").alias("lines"))
    texts = texts.withColumn("words", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x.getField("n")))
    texts = checkpointed(narrow(texts, text_bytes(df, text_col) * NARROW_ROWS // PART_BYTES))
    most = int(texts.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0)
    lost = _found(texts, boilerplate(texts, most)).groupBy("_row").agg(F.sum("n").alias("n_lost_words"), *([F.collect_set("line").alias("_gone")] if cleaned_col else []))
    if cleaned_col:
        # texts are not to be shuffled for the few that lose lines
        lost = checkpointed(narrow(lost, most))
        lost = F.broadcast(lost) if lost.count() <= BROADCAST_TEXTS else lost

    # the words are bound once, so that a filter on what is kept, pushed below, does not split the text again for each of its windows
    bound = F.get(F.transform(F.array(words(text)), lambda w: F.get(F.transform(F.array(repeated_words(w).cast("long")), lambda r: F.struct(r.alias("repeated"), ((F.size(w) < LEAST_WORDS) | (r * 100 > F.size(w) * MOST_REPEATED)).alias("failed"))), F.lit(0))), F.lit(0))
    measured = df.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], F.col(id_col).alias("_id"), row.alias("_row"), *([F.col(text_col).cast("string").alias("_text")] if cleaned_col else []), bound.alias("_base"), F.size(words(text)).cast("long").alias("n_words"), *(c.alias(k) for k, c in _measures(text).items()))
    measured = measured.select("*", F.col("_base.repeated").alias("n_repeat_words"), F.col("_base.failed").alias("_failed")).drop("_base")
    judged = measured.join(lost, "_row", "left").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    failed = F.col("_failed")
    depleted = _depleted(F.col("n_words"), F.col("n_lost_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")
    cleaned = []
    if cleaned_col:
        left = F.filter(F.split("_text", "\n"), lambda line: ~F.array_contains("_gone", F.xxhash64(normal(line))))
        cleaned = [F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")).alias(cleaned_col)]
    return judged.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], *([] if id_col in keep else [F.col("_id").alias(id_col)]), *names, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *cleaned)


#: The same rows in DuckDB's SQL; lines are compared as texts instead of by hash.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
), win AS (
  SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
  ) GROUP BY r
), line AS (
  SELECT r, host, t, l, len(string_split(l, ' ')) AS n FROM (
    SELECT r, host, t, unnest(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '{_SPACE}', ' ', 'g')))) AS l FROM docs
  ) WHERE l <> '' AND len(string_split(l, ' ')) <= {LINE_WORDS}
), often AS (
  SELECT c.host, c.l FROM (SELECT host, l, count(DISTINCT t) AS found FROM line GROUP BY ALL) c
  JOIN (SELECT host, count(DISTINCT t) AS texts FROM line GROUP BY host) h ON c.host = h.host
  WHERE found > {LINE_TEXTS} AND found * 100 > texts * {LINE_PERCENT}
), lost AS (
  SELECT r, sum(n) AS n FROM line JOIN often USING (host, l) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_lost_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
), j AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words, base_failed,
  NOT base_failed AND NOT (n_lost_words > 0 AND (n_words - n_lost_words < {LEAST_WORDS} OR 100 * n_lost_words > {MOST_LOST} * n_words)) AS kept
FROM j
"""
