import json
import subprocess
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueforge.functions import frames
from cueforge.operators import align, render, retention, synthesize, validate
from cueforge.sources import sinks, subtitles, wav
from cueforge.streaming import arrivals

RATE = 22_050
TIMED = "file_id string, ord int, index long, start_ms long, end_ms long, audio binary"


def steady(ms, value, rate=RATE):
    return wav.encode(np.full(round(ms * rate / 1000), value, np.int16), rate)


def rendered(spark, rows, chunk=4096):
    got = render.render(spark.createDataFrame(rows, TIMED), chunk=chunk)
    return {r.file_id: wav.decode(bytes(r.wav))[0] for r in sinks.wav_files(got).collect()}


def folded(rows):
    """One timeline, cue by cue."""
    out = np.zeros(0, np.int64)
    for _, _, _, start, end, audio in sorted(rows, key=lambda r: r[3]):
        samples = wav.decode(audio)[0].astype(np.int64)
        first, n = round(start * RATE / 1000), round((end - start) * RATE / 1000)
        samples = render.fit(samples.astype(np.int16), n).astype(np.int64) if 0 < n < len(samples) else samples
        size = max(len(out), first + max(len(samples), n if end > start else 0))
        out = np.pad(out, (0, size - len(out)))
        out[first : first + len(samples)] = np.clip(out[first : first + len(samples)] + samples, -32768, 32767)
    return out


def test_overlap_order_and_clamp(spark):
    rows = [("a", 0, 1, 0, 4000, steady(4000, 1000)), ("a", 1, 2, 3000, 6000, steady(3000, 1000)), ("b", 2, 3, 0, 100, steady(100, -20000)), ("b", 0, 1, 0, 100, steady(100, 30000)), ("b", 1, 2, 0, 100, steady(100, 10000)), ("c", 0, 1, 500, 500, steady(1500, 7))]
    got = rendered(spark, rows)
    assert len(got["a"]) == 6 * RATE and set(got["a"][: 3 * RATE]) == {1000} and set(got["a"][3 * RATE : 4 * RATE]) == {2000} and set(got["a"][4 * RATE :]) == {1000}
    assert set(got["b"]) == {12767} and len(got["c"]) == 2 * RATE and not got["c"][: RATE // 2].any()


def test_chunks_equal_one_fold(spark):
    rng = np.random.default_rng(1)
    rows = [("x", i, i, int(s), int(s + w), wav.encode(rng.integers(-32768, 32767, int(rng.integers(10, 9000)), np.int16))) for i, (s, w) in enumerate(zip(rng.integers(0, 900, 14), rng.integers(-20, 400, 14), strict=True))]
    want = folded(rows)
    for chunk in (1000, 1 << 19):
        assert (rendered(spark, rows, chunk)["x"] == want).all()


def test_gap_is_silence(spark):
    got = rendered(spark, [("g", 0, 1, 2000, 2100, steady(50, 5))], chunk=1000)["g"]
    assert len(got) == round(2000 * RATE / 1000) + round(100 * RATE / 1000) and not got[: 2 * RATE].any()


def test_errors(spark):
    for row, what in ((("e", 0, 7, -1, 5, steady(5, 1)), "negative"), (("e", 0, 7, 0, validate.MOST_MS + 1, steady(5, 1)), "beyond"), (("e", 0, 7, 0, 5, b""), "no audio"), (("e", 0, 7, 0, 5, b"nope"), "not valid")):
        with pytest.raises(Exception, match=what):
            rendered(spark, [row])
    with pytest.raises(ValueError, match="segment 7"):
        validate.strict(spark.createDataFrame([("e", 0, 7, -1, 5, b"")], TIMED))
    good, bad = validate.quarantine(spark.createDataFrame([("e", 0, 1, 0, 5, b"x"), ("f", 0, 1, 0, 5, b""), ("f", 1, 2, 0, validate.MOST_MS, b"x")], TIMED))
    assert (good.count(), bad.count()) == (1, 2)
    eight = wav.header(4, RATE)[:34] + b"\x08\x00" + wav.header(4, RATE)[36:] + b"abcd"
    with pytest.raises(ValueError, match="8-bit"):
        wav.decode(eight)


def test_kernels(spark):
    assert render.fit(np.array([42, 100, 200], np.int16), 1).tolist() == [42] and render.fit(np.array([99], np.int16), 6).tolist() == [99] * 6
    rng = np.random.default_rng(2)
    rows = [(rng.integers(-32768, 32767, int(n)).tolist(), int(t)) for n, t in zip(rng.integers(0, 30, 40), rng.integers(-1, 30, 40), strict=True)]
    got = spark.createDataFrame(rows, "s array<int>, t long").select("s", "t", frames.fit(F.col("s"), F.col("t")).alias("f")).collect()
    assert all(r.f == render.fit(np.array(r.s, np.int16), r.t).tolist() for r in got)
    want = {1: 22, 3: 66, 10: 220, 30: 662, 50: 1102, 1000: 22050}
    assert {r.ms: r.f for r in spark.createDataFrame([(k,) for k in want], "ms long").select("ms", frames.frames(F.col("ms"), RATE).alias("f")).collect()} == want
    stereo = wav.header(8, 8000)[:22] + b"\x02\x00" + wav.header(8, 8000)[24:] + np.array([1, 2, -3, 0], "<i2").tobytes()
    assert wav.decode(stereo)[0].tolist() == [1, -2]
    assert wav.logged_rate(["x", "[1]", '{"audio": {"sample_rate": "bad"}}', '{"audio": {"sample_rate": 16000}}']) == 16000 and wav.logged_rate([]) == RATE


def test_end_to_end(spark, tmp_path):
    body = "1\n00:00:00,000 --> 00:00:01,000\n<pitch:low>Hi there\n\n2\n00:00:01,500 --> 00:00:02,000\nA much longer line of text"
    files = spark.createDataFrame([("/in/a.srt", body), ("/in/b.srt", "")], "file_id string, body string")
    timed = align.align(synthesize.synthesize(synthesize.resolve(align.segments(subtitles.parse(files))), synthesize.Tone(), 4)).cache()
    assert [(r.ord, round(r.stretch_ratio, 3)) for r in timed.orderBy("ord").collect()] == [(0, 1.0), (1, round(500 / 1560, 3))]
    assert {r.file_id: r.segments for r in align.summary(files, timed).collect()} == {"/in/a.srt": 2, "/in/b.srt": 0}
    done = sinks.write_files(sinks.wav_files(render.render(timed)), str(tmp_path), "wav", ".wav").collect()
    done += sinks.write_files(sinks.plan_json(files, align.plan(timed)), str(tmp_path), "json", ".json").collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "a.wav", "b.json"] and len(done) == 3
    assert len(wav.decode((tmp_path / "a.wav").read_bytes())[0]) == 2 * RATE
    assert [c["text"] for c in json.loads((tmp_path / "a.json").read_text())] == ["Hi there", "A much longer line of text"] and json.loads((tmp_path / "b.json").read_text()) == []
    assert sinks.console(align.plan(timed)).orderBy("ord").first().line == "[0–1000] Hi there"
    with pytest.raises(Exception, match="differ"):
        align.align_pairs(align.segments(subtitles.parse(files)), spark.createDataFrame([("/in/a.srt", 0, 5)], "file_id string, ord int, duration_ms long")).collect()


@pytest.mark.parametrize("ratio,window,tts", [(1.0, 1000, 1000), (1.0, 2000, 500), (1000 / 1110, 1000, 1110), (0.2, 1000, 5000), (1.0, 0, 500), (1.0, -2000, 500), (1.0, 1000, 0), (0.5, 1, 2)])
def test_ratio(spark, ratio, window, tts):
    row = spark.createDataFrame([(0, window, tts)], "start_ms long, end_ms long, duration_ms long")
    assert align.align(row).first().stretch_ratio == ratio


def test_retention(spark):
    cap = retention.MOST_BYTES
    rows = [("two", i, cap // 2 + 1) for i in range(2)] + [("one", 0, cap + 1)] + [("tiny", i, 1) for i in range(17)]
    jobs = spark.createDataFrame(rows, "key string, seq long, bytes long")
    kept = {}
    for r in retention.retained(jobs, "key").collect():
        kept.setdefault(r.key, []).append(r.seq)
    assert kept["two"] == [1] and kept["one"] == [0] and sorted(kept["tiny"]) == list(range(1, 17))
    once = arrivals.keep_jobs(jobs.where("seq < 9"), None, "key")
    assert sorted(map(tuple, arrivals.keep_jobs(jobs.where("seq >= 9"), once, "key").collect())) == sorted((r.key, r.seq, r.bytes) for r in retention.retained(jobs, "key").collect())
    last = retention.last_of_stem(spark.createDataFrame([("a", 0), ("a", 5), ("b", 1)], "stem string, position int"))
    assert {(r.stem, r.position, r.inputs) for r in last.collect()} == {("a", 5, 2), ("b", 1, 1)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nHello")
    run = arrivals.cue_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("cues").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r["index"], r.text) for r in spark.table("cues").collect()] == [(1, "Hello")]


def test_formats_that_are_not_read():
    good = wav.encode(np.array([1, -2, 3, 4], np.int16), 8000)
    assert wav.decode(good[:20] + b"\xfe\xff" + good[22:])[0].tolist() == [1, -2, 3, 4]
    for data in (good[:20] + b"\x06\x00" + good[22:], good[:22] + b"\x00\x00" + good[24:], good[:16] + b"\x04\x00\x00\x00" + good[20:24] + b"data\x00\x00\x00\x00", good[:30], good[:36], b""):
        with pytest.raises(ValueError):
            wav.decode(data)
    assert wav.decode(wav.encode(np.array([1, 4, -3, -4], np.int16), 8000, channels=2))[0].tolist() == [2, -4]


def test_audio_of_no_samples_reaches_its_start(spark):
    """A cue without samples or window is silence up to its start; a file of nothing else still has a timeline."""
    none = wav.encode(np.zeros(0, np.int16), 1000)
    rows = [("a", 0, 1, 500, 500, none), ("b", 0, 1, 0, 0, none), ("c", 0, 1, 0, 3, steady(2, 7)), ("c", 1, 2, 9, 9, none)]
    chunks = render.render(spark.createDataFrame(rows, TIMED), 1000, chunk=256).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: (r.file_id, r.chunk)):
        got.setdefault(r.file_id, []).extend(np.frombuffer(r.pcm, "<i2").tolist())
    assert got["a"] == [0] * 500 and got["b"] == [] and len(got["c"]) == 9


def test_programs_are_called_as_they_ask(monkeypatch, tmp_path):
    """say and piper, with the calls recorded instead of run."""
    calls = []

    def run(command, input=b"", **options):
        calls.append((command, input, options["timeout"], options["check"]))
        if command[0] == "afconvert":
            with open(command[-1], "wb") as f:
                f.write(wav.encode(np.ones(5, np.int16)))
        return subprocess.CompletedProcess(command, 0, b"\x01\x00\x02\x00", b'noise\n{"audio": {"sample_rate": 16000}}\n')

    monkeypatch.setattr(subprocess, "run", run)
    monkeypatch.setattr("shutil.which", lambda name: f"/bin/{name}")
    audio = synthesize.Piper("m.onnx").synthesize({"text": "a; $(b)", "tags": [], "language": "xx"})
    assert wav.decode(audio)[0].tolist() == [1, 2] and wav.decode(audio)[1] == 16_000
    assert calls == [(["piper", "--model", "m.onnx", "--output_raw"], b"a; $(b)", 60, True)]
    calls.clear()
    said = synthesize.Say().synthesize({"spoken": "[[ pbas 30 ]] hi", "voice": "Ada", "rate": 130})
    assert len(wav.decode(said)[0]) == 5 and [c[0][0] for c in calls] == ["say", "afconvert"]
    assert calls[0][0][1:5] == ["-v", "Ada", "-r", "130"] and calls[0][1] == b"[[ pbas 30 ]] hi"
    calls.clear()
    synthesize.Say().synthesize({"spoken": "hi", "voice": None, "rate": None})
    assert "-v" not in calls[0][0] and "-r" not in calls[0][0]
    assert isinstance(synthesize.backend("auto", "m"), synthesize.Piper)
    monkeypatch.setattr("shutil.which", lambda name: None)
    assert isinstance(synthesize.backend("auto"), synthesize.Say)
    for by in (synthesize.Say(), synthesize.Piper("m")):
        with pytest.raises(RuntimeError, match="not found"):
            by.synthesize({"spoken": "x", "text": "x"})
    with pytest.raises(ValueError, match="unknown backend"):
        synthesize.backend("other")


def test_audio_leaves_in_parts(spark):
    class Rows:
        """Gives the function that a plan would run."""

        schema, columns = spark.createDataFrame([], "file_id string, ord int").schema, ["file_id", "ord"]
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    class Large:
        calls = 0

        def synthesize(self, segment):
            self.calls += 1
            return steady(1000 * (segment["ord"] % 5), segment["ord"])

    by = Large()
    most = getattr(synthesize, "PART_BYTES", 8 << 20)
    batches = [pa.RecordBatch.from_pydict({"file_id": ["x"] * n, "ord": pa.array(range(n), pa.int32())}) for n in (1000, 0, 7)]
    calls, found = [], []
    for part in synthesize.synthesize(Rows(), by)(iter(batches)):
        calls.append(by.calls)
        assert part.column("audio").nbytes < most + (1 << 20)
        found += part.to_pylist()
    assert calls[0] < 250 and calls[-1] == 1007
    assert [r["ord"] for r in found] == [*range(1000), *range(7)]
    assert all(r["audio"] == steady(1000 * (r["ord"] % 5), r["ord"]) and r["duration_ms"] == 1000 * (r["ord"] % 5) for r in found)


def test_tones_of_any_length_take_little_beside_them():
    want = lambda n: (8000 * np.sin(np.arange(n) * (2 * np.pi * 220 / RATE))).astype(np.int16)
    tone = synthesize.Tone()
    for chars in (0, 1, 517, 2029, 20_000, 3):
        assert tone.synthesize({"text": "x" * chars}) == wav.encode(want(chars * 60 * RATE // 1000))
    tracemalloc.start()
    try:
        size = len(tone.synthesize({"text": "x" * 20_000}))
        # the samples, their bytes and the file; one part in the making
        assert tracemalloc.get_traced_memory()[1] < 3 * size + (64 << 20)
    finally:
        tracemalloc.stop()
