"""Word and n-gram hashes of whole Arrow text columns, computed by numpy on the raw UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is the sum modulo 2**64 of a
random value for each of its bytes and the place in the word where it stands,
then mixed. Values of different places have nothing to do with each other, so
no structure of a word, however long, makes two words equal. An n-gram's hash
is a polynomial over its words' hashes. Sums run over all bytes or words at
once; no Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Roller:
    """Running polynomial sums modulo 2**64, and their windows."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        while len(self.up) < n:
            for name, root in (("up", self.base), ("down", self.inverse)):
                powers = getattr(self, name)
                setattr(self, name, np.concatenate([powers, powers * np.uint64(pow(root, len(powers), 1 << 64))]))

    def windows(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair of bounds."""
        n = len(values)
        self._reach(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Bytes that are hashed at a time.
_PART = 1 << 19
#: Places of a word whose values are kept in a table; those of later places are made when they are met.
_PLACES = 64
_OF_WORDS = (Roller(0x2545F4914F6CDD1D), Roller(0x9E3779B97F4A7C15))


def _values(place: np.ndarray, byte: np.ndarray, which: int) -> np.ndarray:
    """The random value of a byte at a place of a word, in one of two families."""
    return mix((place.astype(np.uint64) << np.uint64(8)) + byte.astype(np.uint64) + np.uint64(1 + (which << 62)))


_TABLES = tuple(_values(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES), k) for k in range(2))


@dataclass
class Words:
    """The words of some texts: doc numbers the text, start and end are byte places in data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray  # words of each text

    def hashes(self, which: int = 0) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):  # in parts of bounded bytes, or of one long word
            at = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, at + _PART, "right")))
            raw, start, end = self.data[at : self.end[b - 1]], self.start[a:b] - at, self.end[a:b] - at
            place = np.arange(len(raw)) - np.repeat(start, np.diff(start, append=len(raw)))
            value = _TABLES[which][(np.minimum(place, _PLACES - 1) << 8) | raw]
            if len(late := np.flatnonzero(place >= _PLACES)):
                value[late] = _values(place[late], raw[late], which)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(value, out=total[1:])
            out[a:b] = mix(total[end] - total[start] + (end - start).astype(np.uint64))
            a = b
        return out

    def grams(self, n: int, hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams inside a text: where each starts (a word's number), and its hash."""
        at = np.flatnonzero(self.doc[: max(0, len(self.doc) - n + 1)] == self.doc[n - 1 :]) if len(self.doc) >= n else np.zeros(0, np.int64)
        return at, _OF_WORDS[which].windows(hashes, at, at + n)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Find the words of a string column; null and empty texts have none. lower: A-Z as a-z."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bound = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bound[0] : bound[-1]] if data and len(bound) > 1 else np.zeros(0, np.uint8)
    bound = bound - bound[0]
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bound] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(start, bound))
    return Words(_LOWER[raw] if lower else raw, start, np.flatnonzero(last) + 1, np.repeat(np.arange(len(counts)), counts), counts)
