"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary that is one pre-token is encoded
alone; those that come out as one token form the set WHOLE. A pre-token in
WHOLE counts one and nothing is merged; only the rest goes through the merges
(the segment trees of bpe), each distinct one once while a worker remembers it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.bpe import CACHE_LIMIT, PIECE_CHARS, MergeTable, byte_chars, pieces, slices

# The pre-token pattern of the public word-level vocabulary.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# Lower-case forms that str.lower() gives otherwise or not yet.
_LOWER = str.maketrans({"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7dc": "\u019b"})
_SPACE = regex.compile(r"\s+")


class WordBpeCounter:
    """Counts the tokens of a vocabulary file whose words end in a suffix and whose text is lower-cased."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.table = MergeTable(model["vocab"], model["merges"], self.suffix)
        self.special = regex.compile("|".join(map(regex.escape, sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True))))
        self.words = regex.compile(WORD_LEVEL)
        self.whole = self._prove(model["vocab"])
        #: Tokens of the chunks seen; a chunk is what lies between white space.
        self.known: dict[str, int] = {}

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """The strings of the vocabulary that are one pre-token and encode alone as one token."""
        value = {c: b for b, c in enumerate(byte_chars())}
        texts = []
        for token in vocab:
            body = token.removesuffix(self.suffix)
            if body and body != token and all(c in value for c in body):
                try:
                    text = bytes(value[c] for c in body).decode()
                except UnicodeDecodeError:  # a part of a character is no pre-token
                    continue
                if self.words.findall(text) == [text]:
                    texts.append(text)
        _, counts = self.table.merge([t.encode() for t in texts])
        return frozenset(t for t, n in zip(texts, counts.tolist(), strict=True) if n == 1)

    def normal(self, text: str) -> str:
        """Composed and lower-cased code point by code point (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(_LOWER)
        return text.lower()

    def split(self, text: str) -> list[str]:
        """text cut at white space; the four separators that only str.split() takes for it stay."""
        return _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def count_all(self, texts: list[str]) -> list[int]:
        """The tokens of each text; the chunks that are new are merged together."""
        if len(self.known) > CACHE_LIMIT:
            self.known.clear()
        out = [0] * len(texts)
        late: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            parts = self.special.split(text)
            out[k] += len(parts) - 1
            for part in parts:
                for piece in pieces(part):
                    words = self.split(self.normal(piece))
                    try:
                        out[k] += sum(map(self.known.__getitem__, words))
                    except KeyError:
                        late.append((k, words))
                        size += len(piece)
                        if size >= PIECE_CHARS:
                            self._settle(late, out)
                            size = 0
        self._settle(late, out)
        return out

    def _settle(self, late: list[tuple[int, list[str]]], out: list[int]) -> None:
        fresh = list(set().union(*(words for _, words in late)).difference(self.known))
        split = [self.words.findall(w) for w in fresh]
        rest = list(set().union(*split).difference(self.whole))
        _, counts = self.table.merge([w.encode() for w in rest])
        of = dict(zip(rest, counts.tolist(), strict=True))
        self.known.update((w, sum(of.get(x, 1) for x in found)) for w, found in zip(fresh, split, strict=True))
        for k, words in late:
            out[k] += sum(map(self.known.__getitem__, words))
        late.clear()


@lru_cache(maxsize=4)
def word_level(path: str) -> WordBpeCounter:
    return WordBpeCounter(path)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_bytes long, n_tokens long).

    A narrow map, one row out for each row in, without begin or end tokens.
    Null and empty texts have 0 of both, an empty table gives an empty one, and
    long texts are counted in slices; repeated rows are counted each; ids
    may be null; other columns of df are not read. tokenizer is the path of a
    word-level vocabulary file that every executor can open.
    """
    kind = df.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_level(tokenizer)
        for batch in batches:
            counts: list[int] = []
            for texts in slices(batch.column(1)):
                counts += model.count_all(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(counts, np.int64), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(count, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long")
