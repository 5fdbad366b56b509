"""Synthesis of segments by a pluggable backend, in Arrow batches."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions import prosody
from cueforge.sources import wav

#: Bytes of audio that are gathered before they leave the worker; a segment may have more.
PART_BYTES = 8 << 20
#: Frames of a tone that are drawn at a time; a worker keeps the first few such parts, as each tone is the start of a longer one.
TONE_FRAMES = 1 << 20


class Backend(Protocol):
    """Renders one segment (a row as a dict: text, tags, language, ...) to WAV bytes.

    A task may be run again, so a backend must give equal audio for equal
    segments and leave nothing behind.
    """

    def synthesize(self, segment: dict) -> bytes: ...


class Tone:
    """A stand-in for tests and plans, not speech: a steady tone of ms_per_char for each character."""

    def __init__(self, ms_per_char: int = 60, rate: int = wav.DEFAULT_RATE, amplitude: int = 8000) -> None:
        self.ms_per_char, self.rate, self.amplitude = ms_per_char, rate, amplitude

    def synthesize(self, segment: dict) -> bytes:
        n = len(segment["text"]) * self.ms_per_char * self.rate // 1000
        out = np.empty(n, "<i2")
        for k in range(0, n, TONE_FRAMES):
            out[k : k + TONE_FRAMES] = _tone(k, self.rate, self.amplitude)[: n - k]
        return wav.encode(out, self.rate)


@lru_cache(maxsize=8)
def _tone(first: int, rate: int, amplitude: int) -> np.ndarray:
    """TONE_FRAMES frames of the tone that all texts share, from a frame on."""
    return (amplitude * np.sin(np.arange(first, first + TONE_FRAMES) * (2 * np.pi * 220 / rate))).astype("<i2")


class Say:
    """The system voice of macOS; the text goes in on standard input."""

    def __init__(self, timeout_s: int = 30) -> None:
        self.timeout_s = timeout_s

    def synthesize(self, segment: dict) -> bytes:
        for tool in ("say", "afconvert"):
            if shutil.which(tool) is None:
                raise RuntimeError(f"'{tool}' not found; this voice is not available here")
        with tempfile.TemporaryDirectory() as folder:
            raw, out = Path(folder, "a.aiff"), Path(folder, "a.wav")
            options = [*(["-v", segment["voice"]] if segment.get("voice") else []), *(["-r", str(segment["rate"])] if segment.get("rate") is not None else [])]
            subprocess.run(["say", *options, "-o", str(raw), "-f", "-"], input=segment["spoken"].encode(), check=True, capture_output=True, timeout=self.timeout_s)
            subprocess.run(["afconvert", "-f", "WAVE", "-d", f"LEI16@{wav.DEFAULT_RATE}", "-c", "1", str(raw), str(out)], check=True, capture_output=True, timeout=self.timeout_s)
            return out.read_bytes()


class Piper:
    """The piper program with a voice model; tags and language have no effect."""

    def __init__(self, model: str, timeout_s: int = 60) -> None:
        self.model, self.timeout_s = model, timeout_s

    def synthesize(self, segment: dict) -> bytes:
        if shutil.which("piper") is None:
            raise RuntimeError("piper not found on PATH")
        if not self.model:
            raise RuntimeError("piper needs a voice model: --model or PIPER_MODEL")
        run = subprocess.run(["piper", "--model", self.model, "--output_raw"], input=segment["text"].encode(), check=True, capture_output=True, timeout=self.timeout_s)
        return wav.encode(run.stdout, wav.logged_rate(run.stderr.decode("utf-8", "replace").splitlines()))


def backend(name: str = "auto", model: str = "") -> Backend:
    """'say', 'piper', or 'auto': piper where its program is found, else say."""
    makers: dict[str, Callable[[], Backend]] = {"say": Say, "piper": lambda: Piper(model), "tone": Tone}
    if name == "auto":
        name = "piper" if shutil.which("piper") is not None else "say"
    if name not in makers:
        raise ValueError(f"unknown backend {name!r}")
    return makers[name]()


def resolve(segments: DataFrame) -> DataFrame:
    """Add rate, pitch (clamped) and spoken to tagged segments."""
    rate, pitch = prosody.clamp(prosody.rate(F.col("tags")), prosody.RATE_BOUNDS), prosody.clamp(prosody.pitch(F.col("tags")), prosody.PITCH_BOUNDS)
    return segments.withColumns({"rate": rate, "pitch": pitch}).withColumn("spoken", prosody.spoken(F.col("text"), F.col("pitch")))


def synthesize(segments: DataFrame, by: Backend, partitions: int | None = None) -> DataFrame:
    """Add audio and duration_ms. Slow segments are spread by (file_id, ord) over partitions if a number is given.

    Audio is many times its text, so a batch of segments comes out in parts of PART_BYTES of audio.
    """
    rows = segments.repartition(partitions, "file_id", "ord") if partitions else segments
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", audio binary, duration_ms bigint"
    names = [*rows.columns, "audio", "duration_ms"]

    def part(rows: pa.RecordBatch, audio: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(audio, pa.binary()), pa.array(map(wav.duration_ms, audio), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size, audio = 0, 0, []
            for row in batch.to_pylist():
                try:
                    audio.append(by.synthesize(row))
                except (OSError, ValueError, subprocess.SubprocessError) as error:
                    raise RuntimeError(f"Segment synthesis failed: {error}") from error
                size += len(audio[-1])
                if size >= PART_BYTES:
                    yield part(batch.slice(done, len(audio)), audio)
                    done, size, audio = done + len(audio), 0, []
            if audio:
                yield part(batch.slice(done), audio)

    return rows.mapInArrow(run, schema)
