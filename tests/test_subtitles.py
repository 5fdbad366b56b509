import time

import pytest
from pyspark.sql import functions as F

from cueforge.sources import subtitles

GOOD = "1\n00:00:00,000 --> 00:00:01,000\nHello"


def parse(spark, *bodies):
    rows = subtitles.parse(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "file_id string, body string"))
    found = {str(i): [] for i in range(len(bodies))}
    for r in rows.orderBy("file_id", "ord").collect():
        found[r.file_id].append((r["index"], r.start_ms, r.end_ms, r.text))
    return [found[str(i)] for i in range(len(bodies))]


def test_skips(spark):
    got = parse(
        spark, "", "  \n ", "1\nnot a time\nx", "one\n00:00:00,000 --> 00:00:01,000\nx", "1\n00:00:00,000 --> 00:00:01,000", f"{GOOD}\n\nbad\n00:00:00,000 --> 00:00:01,000\nx\n\n2\n00:00:02,000 --> 00:00:03,000\nBye",
        "1\n00:00:00,000  -->  00:00:01,000\nx", "1\n00:00:00.000 --> 00:00:01,000\nx", "﻿" + GOOD, None,
    )
    assert [len(x) for x in got] == [0, 0, 0, 0, 0, 2, 1, 0, 0, 0]
    assert [x[0] for x in got[5]] == [1, 2]


@pytest.mark.parametrize("code,ms", [("00:00:00,000", 0), ("01:00:00,000", 3_600_000), ("23:59:59,999", 86_399_999), ("01:02:03,456", 3_723_456), ("00:99:99,999", 6_039_999)])
def test_timecodes(spark, code, ms):
    assert parse(spark, f"1\n{code} --> {code} trailing\nx") == [[(1, ms, ms, "x")]]


def test_lines_and_digits(spark):
    got = parse(spark, "1_0\n00:00:00,000 --> 00:00:01,000\n a \nb\x85c\n \t\n\n+2\n00:00:00,000 --> 00:00:01,000\nd  ", "٣\n00:00:00,000 --> 00:00:01,000\nx", "1__0\n00:00:00,000 --> 00:00:01,000\nx", "²\n00:00:00,000 --> 00:00:01,000\nx")
    assert got == [[(10, 0, 1000, " a \nb\nc"), (2, 0, 1000, "d")], [(3, 0, 1000, "x")], [], []]


def test_file_order_is_kept(spark):
    body = "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\nt{i}" for i in (6, 5, 4))
    assert [x[0] for x in parse(spark, body)[0]] == [6, 5, 4]


def test_plain_text(spark):
    docs = spark.createDataFrame([("a", "just text"), ("b", GOOD), ("c", None), ("d", "")], "file_id string, body string")
    got = {(r.file_id, r["index"], r.start_ms, r.end_ms, r.text) for r in subtitles.parse_or_plain(docs).collect()}
    assert got == {("a", 1, 0, 0, "just text"), ("b", 1, 0, 1000, "Hello"), ("d", 1, 0, 0, "")}


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(GOOD.replace("\n", "\r\n").encode())
    (tmp_path / "b.srt").write_bytes(b"\xff\xfe")
    rows = subtitles.read_files(spark, str(tmp_path / "*.srt"), strict=False)
    assert sorted((r.file_id[-5:], r.body) for r in rows.collect()) == [("a.srt", GOOD), ("b.srt", None)]
    with pytest.raises(Exception, match="not UTF-8"):
        subtitles.read_files(spark, str(tmp_path / "b.srt")).collect()
    big = spark.createDataFrame([(1, bytearray(subtitles.UPLOAD_BYTES + 1)), (2, bytearray(b"\xff")), (3, bytearray(b"ok"))], "k int, content binary")
    assert {r.k: r.reject for r in subtitles.accept_uploads(big).select("k", "reject").collect()} == {1: "too large", 2: "not UTF-8", 3: None}


def test_parse_is_one_narrow_stage(spark):
    plan = subtitles.parse(spark.createDataFrame([("a", GOOD)], "file_id string, body string")).select(F.col("text"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_long_runs_of_white_space_take_linear_time(spark):
    """An inner run of a mebibyte of blanks, in a text, in a cue and in a number."""
    run = " " * (1 << 20)
    bodies = [("a", f"x{run}y"), ("b", f"1\n00:00:01,000 --> 00:00:02,500 tail\none{run}two"), ("c", f"1{run}1\n00:00:01,000 --> 00:00:02,500\nz")]
    docs = spark.createDataFrame(bodies, "file_id string, body string")
    began = time.perf_counter()
    got = {r.file_id: (r["index"], r.start_ms, r.end_ms, len(r.text)) for r in subtitles.parse_or_plain(docs).collect()}
    assert got == {"a": (1, 0, 0, len(run) + 2), "b": (1, 1000, 2500, len(run) + 6), "c": (1, 0, 0, len(bodies[2][1]))} and time.perf_counter() - began < 30
