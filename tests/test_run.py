import pytest

from cueforge.__main__ import main
from cueforge.operators.synthesize import Say, Tone, backend
from cueforge.plans.run import run_files, run_texts
from cueforge.sources import wav

BODY = "1\n00:00:00,000 --> 00:00:01,000\n<rate:slow>One\n\n2\n00:00:02,000 --> 00:00:03,500\nTwo"


def test_batch(spark, tmp_path, capsys):
    for folder, body in (("a", BODY), ("b", BODY.replace("Two", "Three"))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.srt").write_text(body)
    (tmp_path / "a" / "empty.srt").write_text("")
    out = tmp_path / "out"
    assert main(["batch", f"{tmp_path}/*/*.srt", "--output", str(out), "--backend", "tone"]) == 0
    assert sorted(p.name for p in out.iterdir()) == ["empty.json", "x.json", "x.wav"]
    assert "Three" in (out / "x.json").read_text() and (out / "empty.json").read_text() == "[]"
    assert len(wav.decode((out / "x.wav").read_bytes())[0]) == round(3.5 * 22050)
    lines = capsys.readouterr().out.splitlines()
    assert sorted(line.rpartition("/")[2] for line in lines) == ["empty.srt: 0 segment(s)", "x.srt: 2 segment(s)", "x.srt: 2 segment(s)"]


def test_dub_prints_the_plan(spark, tmp_path, capsys):
    (tmp_path / "x.srt").write_text(BODY)
    assert main(["dub", f"{tmp_path}/x.srt", "--backend", "tone"]) == 0
    assert capsys.readouterr().out.splitlines() == ["[0–1000] One", "[2000–3500] Two"]
    assert main(["dub", f"{tmp_path}/none.srt", "--backend", "tone"]) == 1
    assert "error:" in capsys.readouterr().err


def test_texts_and_failures(spark, tmp_path):
    texts = spark.createDataFrame([("t", "plain words")], "file_id string, body string")
    run = run_texts(texts, Tone())
    assert [(r.start_ms, r.end_ms, r.text) for r in run.plan().collect()] == [(0, 0, "plain words")]
    assert len(run.timelines().first().pcm) == 2 * (11 * 60 * 22050 // 1000)
    with pytest.raises(Exception, match="not available here|not found"):
        run_texts(texts, Say()).plan().select("stretch_ratio").collect()
    catalogue = spark.createDataFrame([(0, "Daniel", "en_GB")], "pos int, name string, locale string")
    (tmp_path / "x.srt").write_text(BODY)
    with pytest.raises(Exception, match="no voice for language xx"):
        run_files(spark, f"{tmp_path}/x.srt", Tone(), "xx", catalogue).plan().collect()
    assert run_files(spark, f"{tmp_path}/x.srt", Tone(), "en", catalogue).timed.select("voice").distinct().first().voice == "Daniel"
    with pytest.raises(ValueError):
        backend("nope")
