"""Frames of a timeline, and the linear fit of samples, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames(ms: Column, rate: Column | int) -> Column:
    """Frames of a time, halves to even."""
    return F.bround(ms * (F.lit(rate) if isinstance(rate, int) else rate) / F.lit(1000.0), 0).cast("bigint")


def wav_duration_ms(n_frames: Column, rate: Column) -> Column:
    """Whole milliseconds of a number of frames."""
    return F.floor(n_frames * 1000 / rate).cast("bigint")


def fit(samples: Column, target: Column) -> Column:
    """An array of samples in target frames, interpolated and cut toward zero; equal sizes stay as they are."""
    n = F.size(samples)
    step = F.when(target > 1, (n - 1).cast("double") / (target - 1)).otherwise(F.lit(0.0))

    def at(i: Column) -> Column:
        place = i * step
        j = F.floor(place).cast("int")
        a = F.get(samples, j).cast("double")
        b = F.coalesce(F.get(samples, j + 1).cast("double"), a)
        value = a + (b - a) * (place - j)
        return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("int")

    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(target, F.lit(1)) - 1), at)
    return F.when((target <= 0) | (n == 0), F.array().cast("array<int>")).when(n == target, samples.cast("array<int>")).otherwise(drawn)


def downmix(samples: Column, channels: Column) -> Column:
    """Interleaved samples as one channel, the mean rounded down; a part frame at the end is left out."""
    whole = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.floor(F.aggregate(F.slice(samples, (i * channels + 1).cast("int"), channels), F.lit(0).cast("bigint"), lambda a, x: a + x) / channels).cast("int")
    return F.when(whole == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), mean))


def mixed(signals: Column) -> Column:
    """Signals of one frame, (start_ms, ord, value) structs, added in timeline order and clamped after every one."""
    step = lambda a, s: F.greatest(F.lit(-32768), F.least(F.lit(32767), a + s["value"]))
    return F.aggregate(F.array_sort(signals), F.lit(0), step)
