"""Corpus statistics by chunks of documents.

A statistic over n-grams of the whole corpus, wanted again beside each
document, would cost a shuffled row for every word if written as a join.
Here documents are dealt once to chunks of bounded size; each chunk asks for
its distinct keys only, packed by hash bucket (sorted, delta-coded); a bucket
gathers one small piece from each chunk, answers in the order asked, and the
chunk reads its documents again with the answers. A key that is everywhere
costs one entry a chunk, so no key can make a bucket large, and nothing is
held for the corpus as a whole.

There is a piece for each pair of a chunk and a bucket, and as many buckets as
chunks. Chunks therefore grow with the square root of the corpus once pieces
would be smaller than PIECE_BYTES, so that pieces grow in number with the
corpus and not with its square: 8 MB up to 0.3 TB of text, 160 MB at 100 TB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import chunk_of, text_bytes

#: Bytes of text of a chunk of documents at least, where the text is large enough for several, and of text for each piece.
CHUNK_BYTES, PIECE_BYTES = 8 << 20, 256
#: Rows that a partition holds back before it packs them.
PACK_BYTES = 24 << 20
#: Bytes of text of a chunk that are worked on at a time, where that can be.
PART_BYTES = 2 << 20


def pack(values: np.ndarray) -> bytes:
    """Integers as their byte planes, compressed; small when the values are small."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as packed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


class Chunks:
    """Documents dealt to chunks: frame has (chunk int, docs binary), partitioned by chunk."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, more: dict | None = None, chunk_bytes: int = CHUNK_BYTES) -> None:
        """more: further columns (name: expression) that docs carry beside id and text."""
        own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = text_bytes(df, text_col)
        self.count = max(own, math.ceil(size / max(chunk_bytes, math.isqrt(size * PIECE_BYTES))))
        #: As many buckets of keys as chunks: a piece for each pair of them.
        self.buckets = Buckets(self.count)
        more = more or {}
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(e.alias(k) for k, e in more.items()))
        number = F.get(F.lit(spread_keys(self.count)), chunk_of(self.count, "id", "text"))
        rows = rows.select(number.alias("chunk"), *rows.columns)

        def deal(batches):
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size >= PACK_BYTES:
                    yield from _packed(held)
                    held, size = [], 0
            if held:
                yield from _packed(held)

        self.frame = self.dealt(rows.mapInArrow(deal, "chunk int, docs binary"), "chunk")
        self.groups = self.frame.groupBy("chunk")

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """rows, each of its chunk or bucket in a partition of its own."""
        return rows.repartition(self.count, key)

    def numbers(self) -> DataFrame:
        """All numbers of chunks, as (chunk int)."""
        return self.frame.sparkSession.range(1).select(F.explode(F.lit(spread_keys(self.count))).alias("chunk"))


def spread_keys(n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n partitions, one to each.

    Plain numbers would leave a third of the partitions empty and give others
    several. The hash is the public 32-bit Murmur3 with seed 42.
    """
    found = np.full(n, -1, np.int64)
    for start in range(0, 1 << 31, 4 * n + 64):
        x = np.arange(start, start + 4 * n + 64, dtype=np.uint64)
        rotl = lambda v, r: ((v << np.uint64(r)) | (v >> np.uint64(32 - r))) & _LOW
        times = lambda v, k: (v * np.uint64(k)) & _LOW
        h = np.uint64(42) ^ times(rotl(times(x, 0xCC9E2D51), 15), 0x1B873593)
        h = ((rotl(h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _LOW) ^ np.uint64(4)
        h = times(h ^ (h >> np.uint64(16)), 0x85EBCA6B)
        h = times(h ^ (h >> np.uint64(13)), 0xC2B2AE35)
        slot = (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32).astype(np.int64) % n
        first = np.unique(slot, return_index=True)
        new = found[first[0]] < 0
        found[first[0][new]] = x[first[1][new]].astype(np.int64)
        if (found >= 0).all():
            break
    return found.tolist()


_LOW = np.uint64(0xFFFFFFFF)


class Buckets:
    """Where ascending 64-bit hashes fall when dealt to a number of buckets by their high bits."""

    def __init__(self, count: int) -> None:
        self.count = count
        #: The number that a row of each bucket bears.
        self.keys = spread_keys(count)
        self.place = {key: b for b, key in enumerate(self.keys)}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.count)) >> np.uint64(32)

    def cuts(self, hashes: np.ndarray) -> np.ndarray:
        """For ascending hashes, the bounds of each bucket's part: count + 1 places."""
        return np.searchsorted(self.of(hashes), np.arange(self.count + 1, dtype=np.uint64))


def _packed(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches)
    chunk = table.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    keys, first = np.unique(chunk[order], return_index=True)
    rest = table.drop_columns(["chunk"])
    for key, a, b in zip(keys.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        sink = pa.BufferOutputStream()
        part = rest.take(pa.array(order[a:b])).combine_chunks()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_table(part)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], names=["chunk", "docs"])


def documents(table: pa.Table) -> pa.Table:
    """The documents of a chunk's rows. What is asked for them must not depend on their order."""
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x.as_py())).read_all() for x in table.column("docs")]).combine_chunks()


def parts(docs: pa.Table, most: int = PART_BYTES) -> Iterator[pa.Table]:
    """Documents in order, in parts of a bounded length of text (or of one document)."""
    if not docs.num_rows:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column(docs, "text")), 0).to_numpy(zero_copy_only=False), np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), docs.num_rows], strict=True):
        yield docs.slice(a, b - a).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a combined table as one array."""
    got = table.column(name)
    return got.chunk(0) if got.num_chunks == 1 else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


def sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending distinct keys and, for each column of values, its sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))
