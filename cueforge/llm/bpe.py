"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Every pre-token is merged by a min segment tree: leaf i holds the rank of the
pair that starts at symbol i (joined with i, so that equal ranks go to the
left), the root therefore names the leftmost lowest-rank merge, and a merge
changes three leaves and their paths, in logarithmic time, until the root
holds no mergeable pair. numpy runs the trees of many distinct pre-tokens in
step; one very long pre-token is simply a batch of one wide tree.

A worker keeps a bounded table of the chunks it has merged, so a frequent word
is merged once per worker and a document costs a table look-up per word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker remembers before it starts afresh.
CACHE_LIMIT = 200_000
#: Code points that are pre-tokenised at a time.
PIECE_CHARS = 1 << 20
#: Cells of a batch of trees.
TREE_CELLS = 1 << 18

_NONE = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)

# The pre-token pattern of the public byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class MergeTable:
    """The merges of a vocabulary as a hash table that numpy probes for many pairs at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 24) | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        taken, self.probes = {}, 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            if key in taken:  # the last rank of a repeated pair holds
                self.ranks[taken[key]] = rank
                continue
            step = 1
            while self.keys[slot] != -1:
                slot, step = (slot + 1) & ((1 << self.bits) - 1), step + 1
            self.keys[slot], self.ranks[slot], taken[key] = key, rank, slot
            self.probes = max(self.probes, step)
        chars = byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int32) if suffix else self.inner

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for those that do not merge (or hold a -1)."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), (left.astype(np.int64) << 24) | right.astype(np.int64))
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], -1)
        open_ = np.flatnonzero((found != key) & (found != -1) & (key >= 0))
        for _ in range(self.probes - 1):
            if not open_.size:
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one after another, and how many each word has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lens) - lens
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        done, width = np.flatnonzero(lens == 0), 2
        while len(done) < len(words):
            own = np.flatnonzero((lens <= width) & (lens > (width // 2 if width > 2 else 0)))
            step = max(1, TREE_CELLS // width)
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                symbols, counts[rows] = self._merge_step(flat, start[rows], lens[rows], width)
                parts.append((rows, symbols))
            done = np.concatenate([done, own])
            width *= 2
        ids, at = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, symbols in parts:
            n = counts[rows]
            ids[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return ids, counts

    def _merge_step(self, flat: np.ndarray, start: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(start)
        place = np.arange(width)
        inside = place < lens[:, None]
        byte = flat[np.where(inside, start[:, None] + place, start[:, None])]
        # a border cell on either side, so that neighbours always exist
        symbol = np.full((n, width + 2), -1, np.int32)
        symbol[:, 1:-1] = np.where(inside, np.where(place == lens[:, None] - 1, self.final[byte], self.inner[byte]), -1)
        right, left = np.tile(np.arange(1, width + 3), (n, 1)), np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self.rank(symbol[:, 1:-2].ravel(), symbol[:, 2:-1].ravel()).reshape(n, width - 1)
        tree[:, width:-1] = np.where(rank >= 0, rank * width + place[:-1], _NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        alive = np.zeros((n, width + 2), bool)
        alive[:, 1:-1] = inside
        cells, symbols, rights, lefts, live = tree.ravel(), symbol.ravel(), right.ravel(), left.ravel(), alive.ravel()
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while rows.size:
            root, cell, node = cells[rows * (2 * width) + 1], rows * (width + 2), rows * (2 * width)
            at = root % width + 1
            gone = rights[cell + at]
            after, before = rights[cell + gone], lefts[cell + at]
            fresh = self.made[root // width]
            symbols[cell + at] = fresh
            live[cell + gone] = False
            symbols[cell + gone] = -1
            rights[cell + at] = after
            lefts[cell + after] = at
            ranks = self.rank(np.concatenate([fresh, symbols[cell + before]]), np.concatenate([symbols[cell + after], fresh]))
            ranks = np.where(ranks >= 0, ranks * width, _NONE)
            mine, prior = ranks[: len(rows)], ranks[len(rows) :]
            has = before > 0
            leaf = np.concatenate([node + width + at - 1, node + width + gone - 1, (node + width + before - 1)[has]])
            cells[leaf[: len(rows)]] = np.where(mine != _NONE, mine + at - 1, _NONE)
            cells[leaf[len(rows) : 2 * len(rows)]] = _NONE
            cells[leaf[2 * len(rows) :]] = np.where(prior != _NONE, prior + before - 1, _NONE)[has]
            base = np.concatenate([node, node, node[has]])
            index = leaf - base
            step = width
            while step > 1:
                even = base + (index & ~1)
                index >>= 1
                cells[base + index] = np.minimum(cells[even], cells[even + 1])
                step //= 2
            rows = rows[cells[rows * (2 * width) + 1] != _NONE]
        return symbol[alive], alive.sum(1)


class ByteLevelBpe:
    """A byte-level vocabulary file: encode text to ids, ids to text.

    Added special strings inside a text become their own ids, as the file's
    library does by default.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.table = MergeTable(vocab, spec["model"]["merges"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        value = {c: b for b, c in enumerate(byte_chars())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(BYTE_LEVEL)
        #: The ids of the chunks seen, at the start of a text part and after a space. Text is cut at its
        #: spaces: one between two characters that are no white space starts a pre-token, so what lies
        #: between two such is merged alone. None: white space at an end, so the part goes by the pattern.
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; what the texts bring that is new is merged in batches."""
        if len(self.first) + len(self.rest) > CACHE_LIMIT:
            self.first.clear()
            self.rest.clear()
        out: list[list[bytes]] = [[] for _ in texts]
        late: list[tuple[list[bytes], int, list[str]]] = []
        size = 0
        for text, ids in zip(texts, out, strict=True):
            for j, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
                if j % 2:
                    ids.append(np.array([self.special[part]], "<u4").tobytes())
                    continue
                for piece in pieces(part):
                    head, *tail = piece.split(" ")
                    try:
                        ids.append(b"".join([self.first[head], *map(self.rest.get, tail)]))
                    except (KeyError, TypeError):  # a chunk is new, or is no chunk
                        late.append((ids, len(ids), [head, *tail]))
                        ids.append(b"")
                        size += len(piece)
                        if size >= PIECE_CHARS:
                            self._settle(late)
                            size = 0
        self._settle(late)
        return [b"".join(x) for x in out]

    def _settle(self, late: list[tuple[list[bytes], int, list[str]]]) -> None:
        heads = {words[0] for _, _, words in late}.difference(self.first)
        tails = set().union(*(words[1:] for _, _, words in late)).difference(self.rest)
        self.learn(list(heads), list(tails))
        for ids, at, words in late:
            try:
                ids[at] = b"".join([self.first[words[0]], *map(self.rest.get, words[1:])])
            except TypeError:
                found = self.words.findall(" ".join(words))
                own = list(set(found))
                of = dict(zip(own, self._merged(own), strict=True))
                ids[at] = b"".join(map(of.__getitem__, found))
        late.clear()

    def _merged(self, words: list[str]) -> list[bytes]:
        ids, counts = self.table.merge([w.encode() for w in words])
        packed, end = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *end], end, strict=False)]

    def learn(self, heads: list[str], tails: list[str]) -> None:
        """Merge each distinct pre-token of chunks that are new; None for what is no chunk."""
        split = [*map(self.words.findall, heads), *(self.words.findall(f" {w}") for w in tails)]
        fresh = list(set().union(*split))
        of = dict(zip(fresh, self._merged(fresh), strict=True))
        whole = [b"".join(map(of.__getitem__, x)) for x in split]
        self.first.update((w, None if w[-1:].isspace() else ids) for w, ids in zip(heads, whole, strict=False))
        self.rest.update((w, None if not w or w[0].isspace() or w[-1].isspace() else ids) for w, ids in zip(tails, whole[len(heads) :], strict=True))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def pieces(text: str) -> Iterator[str]:
    """text in parts of bounded length, cut where no pre-token can go on.

    A cut lies before a space that follows a character that is no white space
    and precedes one: a pre-token has a space in that position only at its
    start. A text without such a place is one part.
    """
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = _CUT.search(text, at + PIECE_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_CUT = regex.compile(r"(?<=[A-Za-z.,]) (?=[A-Za-z])")


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelBpe:
    return ByteLevelBpe(path)


def slices(column: pa.Array, most: int = PIECE_CHARS) -> Iterator[list[str]]:
    """The values of a string column (null: empty), in lists of bounded total length."""
    held: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Encode every whole text: (id, n_tokens long, ids binary of little-endian unsigned 32-bit ids).

    With decoded_col, the ids are decoded again in the same worker into that
    further string column. A narrow map, one row out for each row in: null and
    empty texts give no ids; repeated rows are encoded each; ids may be null;
    other columns of df are not read. tokenizer is the path of a byte-level
    vocabulary file that every executor can open.
    """
    kind = df.schema[id_col].dataType
    names = [id_col, "n_tokens", "ids", *([decoded_col] if decoded_col else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_level(tokenizer)
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                ids = model.encode_all(texts)
                columns = [batch.column(0).slice(done, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(map(model.decode, ids), pa.string())] if decoded_col else [])], names=names)
                done += len(texts)

    schema = f"`{id_col}` {kind.simpleString()}, n_tokens long, ids binary" + (f", `{decoded_col}` string" if decoded_col else "")
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of a column of packed ids (as bpe_encode gives) to df; null or empty ids give ''."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = byte_level(tokenizer)
        return pa.array((model.decode(x.as_py() or b"") for x in ids), pa.string())

    return df.withColumn(out_col, decode(F.col(ids_col)))
