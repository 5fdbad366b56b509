"""Rendering of timelines in chunks.

A cue is decoded, resampled and fitted where it lies, and cut into the pieces
that fall into chunks of CHUNK_FRAMES frames. Chunks are then folded for
themselves: pieces in timeline order, clamped after every one, which no
partial aggregation could do. A file of hours is many chunks, so it needs no
task of its own, and a chunk's pieces are bounded by the cues that overlap it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions.frames import frames
from cueforge.operators.validate import MOST_MS, bound_error
from cueforge.sources import wav

CHUNK_FRAMES = 1 << 19


def fit(samples: np.ndarray, target: int) -> np.ndarray:
    """samples in target frames, interpolated in double precision and cut toward zero."""
    n = len(samples)
    if target <= 0 or n == 0:
        return samples[:0]
    if n == target:
        return samples
    place = np.arange(target) * ((n - 1) / (target - 1) if target > 1 else 0.0)
    low = place.astype(np.int64)
    a = samples[low].astype(np.float64)
    b = samples[np.minimum(low + 1, n - 1)].astype(np.float64)
    return np.trunc(a + (b - a) * (place - low)).astype(np.int16)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    return samples if source == target else fit(samples, round(len(samples) * target / source))


def fold(pieces: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """Pieces (offset, samples) added one by one, each sum clamped to 16 bits."""
    out = np.zeros(size, np.int32)
    for offset, samples in pieces:
        part = out[offset : offset + len(samples)]
        np.clip(part + samples, -32768, 32767, out=part)
    return out.astype(np.int16)


def render(timed: DataFrame, rate: int = wav.DEFAULT_RATE, most_ms: int = MOST_MS, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Timelines of (file_id, ord, index, start_ms, end_ms, audio), as (file_id, chunk int, pcm binary).

    A chunk's pcm is 16-bit little-endian; all but a file's last are full, and
    silence is written out. Cues outside the timeline, and cues without audio,
    fail the job; check them before with validate for an early answer.
    """
    window = F.col("end_ms") - F.col("start_ms")
    placed = timed.withColumn("_error", F.coalesce(bound_error(most_ms), F.when(F.coalesce(F.length("audio"), F.lit(0)) == 0, "no audio")))
    placed = placed.select("file_id", "ord", "index", "start_ms", "audio", "_error", frames(F.col("start_ms"), rate).alias("first"), F.when(window > 0, frames(window, rate)).alias("window"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["_error"]:
                    raise ValueError(f"segment {row['index']}: {row['_error']}")
                samples = resample(*wav.decode(row["audio"]), rate)
                first, window = row["first"], row["window"]
                if window is not None and len(samples) > window:
                    samples = fit(samples, window)
                end = first + (len(samples) if window is None else max(window, len(samples)))
                out = []
                for k in range(first // chunk, max(first, end - 1) // chunk + 1):
                    a, b = max(first, k * chunk), min(end, (k + 1) * chunk)
                    # audio of no samples still reaches its start
                    if b > a or end == first:
                        out.append((k, a - k * chunk, b - k * chunk, samples[a - first : b - first].astype("<i2").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file_id"]] * len(out), pa.string()), *(pa.array([o[i] for o in out], pa.int32()) for i in range(3)), pa.array([row["start_ms"]] * len(out), pa.int64()), pa.array([row["ord"]] * len(out), pa.int32()), pa.array([o[3] for o in out], pa.binary())],
                    names=["file_id", "chunk", "offset", "end", "start_ms", "ord", "piece"],
                )

    pieces = placed.withColumn("file_id", F.col("file_id").cast("string")).withColumn("ord", F.col("ord").cast("int")).mapInArrow(cut, "file_id string, chunk int, offset int, end int, start_ms long, ord int, piece binary")
    # chunks before a file's last are full, also those that no cue reaches
    last = pieces.groupBy("file_id").agg(F.max("chunk").alias("last"))
    gaps = last.where("last > 0").select("file_id", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("chunk"))
    full = gaps.select("file_id", "chunk", F.lit(0).alias("offset"), F.lit(chunk).alias("end"), F.lit(-1).cast("long").alias("start_ms"), F.lit(-1).alias("ord"), F.lit(b"").alias("piece"))

    def mix(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["start_ms", "ord", "offset", "end", "piece"]).to_pylist(), key=lambda r: (r["start_ms"], r["ord"]))
        pcm = fold([(r["offset"], np.frombuffer(r["piece"], "<i2")) for r in rows], max(r["end"] for r in rows))
        return pa.table({"file_id": table.column("file_id")[:1], "chunk": table.column("chunk")[:1], "pcm": pa.array([pcm.astype("<i2").tobytes()], pa.binary())})

    return pieces.unionByName(full).groupBy("file_id", "chunk").applyInArrow(mix, "file_id string, chunk int, pcm binary")
