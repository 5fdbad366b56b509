"""16-bit WAV audio as numpy samples and back, and what a synthesiser's log says of its rate."""

from __future__ import annotations

import json
import struct

import numpy as np

DEFAULT_RATE = 22_050
# Format tags of files whose samples are plain numbers.
PCM, EXTENSIBLE = 1, 0xFFFE


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a RIFF file; several channels become their mean, rounded down."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("audio is not valid: no RIFF/WAVE header")
    at, layout = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            if size < 16 or len(data) < at + 24:
                raise ValueError("audio is not valid: its format chunk is too short")
            layout = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data" and layout:
            form, channels, rate, _, _, width = layout
            if form not in (PCM, EXTENSIBLE) or not channels or not rate:
                raise ValueError(f"audio is no PCM: format {form}, {channels} channels, {rate} Hz")
            if width != 16:
                raise ValueError(f"audio has {width}-bit samples; only 16-bit ones are read")
            body = data[at + 8 : at + 8 + size]
            samples = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2")
            if channels > 1:
                samples = (samples.reshape(-1, channels).astype(np.int64).sum(1) // channels).astype(np.int16)
            return samples, rate
        at += 8 + size + size % 2
    raise ValueError("audio is not valid: no format or no data chunk")


def header(n_bytes: int, rate: int, channels: int = 1) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + n_bytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, channels, rate, 2 * channels * rate, 2 * channels, 16) + b"data" + struct.pack("<I", n_bytes)


def encode(samples: np.ndarray, rate: int = DEFAULT_RATE, channels: int = 1) -> bytes:
    """A 16-bit WAV file of interleaved samples, mono by default; raw PCM bytes are wrapped likewise."""
    body = samples if isinstance(samples, bytes) else np.asarray(samples, "<i2").tobytes()
    return header(len(body), rate, channels) + body


def duration_ms(data: bytes) -> int:
    samples, rate = decode(data)
    return len(samples) * 1000 // rate


def logged_rate(lines: list[str], default: int = DEFAULT_RATE) -> int:
    """The rate in the first log line that is a JSON object with audio; lines that do not parse are passed over."""
    for line in lines:
        try:
            found = json.loads(line)
            if isinstance(found, dict) and "audio" in found:
                return int(found["audio"].get("sample_rate", default))
        except (ValueError, TypeError, AttributeError):
            continue
    return default
