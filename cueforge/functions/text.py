"""Text expressions with Unicode-aware white space, line and digit rules."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a class body of a Java pattern.
SPACE = r"\t-\r\x1c-\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Where a line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85" + chr(0x2028) + chr(0x2029) + "]"

_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_ASCII = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def strip(text: Column) -> Column:
    """text without white space at its ends. A trim is linear, where a pattern for runs before the end would try each place of an inner run."""
    return F.btrim(text, F.lit(_BLANKS))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of every script as 0-9. Texts without any are left as they are."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, "".join(_DIGITS), _ASCII)).otherwise(text)


def integer(text: Column) -> Column:
    """A bigint written in decimal digits, with an optional sign and single underscores between digits; else null."""
    plain = ascii_digits(strip(text))
    return F.when(plain.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.regexp_replace(plain, "_", "").try_cast("bigint"))
