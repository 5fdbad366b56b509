"""Inline prosody tags, and the rates, pitches and spoken texts they resolve to. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueforge.functions.text import integer

#: Letters, numbers of every kind, and the underscore are word characters.
TAG = r"<([\p{L}\p{N}_]+):([\p{L}\p{N}_]+)>"

# Words a minute of named rates.
RATE_WPM = {"x-slow": 100, "slow": 130, "medium": 175, "normal": 175, "fast": 220, "x-fast": 260}
# Words a minute of emotions.
EMOTION_WPM = {"excited": 215, "happy": 195, "neutral": 175, "calm": 150, "sad": 130}
# Pitch bases of named pitches.
PITCH_BASE = {"x-low": 30, "low": 38, "medium": 46, "normal": 46, "high": 54, "x-high": 62}
# Bounds of rates and pitches.
RATE_BOUNDS, PITCH_BOUNDS = (20, 500), (-100, 100)


def tags(text: Column) -> Column:
    """The tags of a text in order, repeats kept, as an array of (name, value)."""
    name, value = (F.regexp_extract_all(text, F.lit(TAG), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(name.alias("name"), value.alias("value"))


def clean(text: Column) -> Column:
    """The text without its tags; white space stays as it is."""
    return F.regexp_replace(text, TAG, "")


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _last_good(found: Column, name: str, value) -> Column:
    """The last value that is not null among the tags of a name; null if there is none."""
    own = F.filter(found, lambda t: F.lower(t["name"]) == name)
    good = F.filter(F.transform(own, lambda t: value(F.lower(t["value"]))), lambda v: v.isNotNull())
    return F.try_element_at(good, F.lit(-1))


def _named_or_number(table: dict[str, int]):
    return lambda v: F.coalesce(F.try_element_at(_table(table), v).cast("bigint"), integer(v))


def rate(found: Column) -> Column:
    """Words a minute: the last good rate tag, else the last known emotion, else null."""
    return F.coalesce(_last_good(found, "rate", _named_or_number(RATE_WPM)), _last_good(found, "emotion", lambda v: F.try_element_at(_table(EMOTION_WPM), v).cast("bigint")))


def pitch(found: Column) -> Column:
    """The pitch base of the last good pitch tag, else null."""
    return _last_good(found, "pitch", _named_or_number(PITCH_BASE))


def clamp(value: Column, bounds: tuple[int, int]) -> Column:
    """value within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value)).cast("bigint"))


def spoken(text: Column, pitch_base: Column) -> Column:
    """The text as it is spoken, led by its pitch command if it has a pitch."""
    return F.when(pitch_base.isNotNull(), F.concat(F.lit("[[ pbas "), pitch_base.cast("string"), F.lit(" ]] "), text)).otherwise(text)
