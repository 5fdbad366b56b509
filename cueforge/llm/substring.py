"""Removal of passages that an earlier document has, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words and
every rolling window of BLOCK words probes them. BLOCK is 7 so that each run of
WINDOW = 13 words holds a whole reference block, wherever it starts. A block
that a second document's window hits is an anchor; hits are then extended to
exact repeats: all runs of WINDOW words around an anchor are held against the
other documents by 96-bit hashes, and neighbouring hits together are a maximal
repeat. The words that it covers are removed where an earlier document has it.

Documents are read by chunks (see chunked), a part of a chunk at a time: probes
travel as packed 32-bit remainders, and only what surrounds anchors travels
with its whole hash. A passage that a third of all documents share costs one
entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from cueforge.llm.chunked import Chunks, column, documents, pack, pack_sorted, parts, unpack, unpack_sorted
from cueforge.llm.wordhash import Words, words_of

WINDOW = 13
BLOCK = (WINDOW + 1) // 2


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and whether each is in two documents or more."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) if len(first) else np.zeros(0, bool)


def _rolling(docs: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, their hashes, and the rolling windows of BLOCK words: places and hashes."""
    words = words_of(column(docs, "text"))
    hashes = words.hashes()
    return words, hashes, *words.grams(BLOCK, hashes)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a 13-word window whose words also start in a document of smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input, whole
    texts, never on what is left. Returns (id, n_words long, n_removed long,
    kept string: the words left, joined by one space), one row for each row in.
    Null, empty and short texts lose nothing. Rows of one id do not act on each
    other. A null id is neither earlier nor later than another: such rows keep
    all their words. An empty table gives an empty one. Texts may be of any
    length: a task holds a chunk of texts and works on a part of it at a time,
    at least on one text. Ids are integers, or a TypeError is raised; other
    columns of df are not read.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a column of integers")
    kind = df.schema[id_col].dataType.simpleString()
    chunks = Chunks(df, id_col, text_col)
    buckets = chunks.buckets

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """A chunk's probes and reference blocks, by bucket."""
        found: list[tuple[np.ndarray, ...]] = []
        for part in parts(documents(table)):
            words, _, at, rolling = _rolling(part)
            doc = words.doc[at]
            inside = at - (np.cumsum(words.counts) - words.counts)[doc]
            found.append((*_distinct(rolling, doc), np.unique(rolling[inside % BLOCK == 0])))
        if not found:
            return _table([], ("bucket", "chunk", "probes", "many", "blocks"))
        probes, twice = _count(*(np.concatenate(x) for x in list(zip(*found, strict=True))[:2]))
        blocks = np.unique(np.concatenate([x[2] for x in found]))
        out = []
        for b, (i, j, k, m) in enumerate(zip(*(x for h in (probes, blocks) for x in (buckets.cuts(h)[:-1], buckets.cuts(h)[1:])), strict=True)):
            if j > i:
                low, first = np.unique(probes[i:j].astype(np.uint32), return_inverse=True)
                many = (np.bincount(first) > 1) | (np.bincount(first, twice[i:j]) > 0)
                out.append((buckets.keys[b], int(key[0].as_py()), pack_sorted(low), np.packbits(many).tobytes(), pack_sorted(np.unique(blocks[k:m].astype(np.uint32)))))
        return _table(out, ("bucket", "chunk", "probes", "many", "blocks"))

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        """A bucket's answer: for each chunk, its probes that hit a block and are in two documents."""
        pieces = [unpack_sorted(x.as_py(), np.uint32) for x in table.column("probes")]
        many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many"), pieces, strict=True)]
        probes, again = _count(np.concatenate(pieces), np.concatenate(many))
        blocks = np.unique(np.concatenate([unpack_sorted(x.as_py(), np.uint32) for x in table.column("blocks")]))
        hot = np.intersect1d(probes[again], blocks, assume_unique=True)
        out = []
        for chunk, p in zip(table.column("chunk").to_pylist(), pieces, strict=True):
            if len(own := np.intersect1d(p, hot, assume_unique=True)):
                out.append((chunk, key[0].as_py(), pack_sorted(own)))
        return _table(out, ("chunk", "bucket", "answer"))

    def candidates(docs: pa.Table, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """The windows of WINDOW words that hold an anchor: place among the chunk's words, document, both parts of the hash; and each document's words."""
        hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *((np.uint64(buckets.place[key]) << np.uint64(32)) | unpack_sorted(x.as_py(), np.uint32).astype(np.uint64) for key, x in zip(answers.column("bucket").to_pylist(), answers.column("answer"), strict=True))]))
        found, counts = [], []
        n_words = n_docs = 0
        for part in parts(docs):
            words, hashes, at, rolling = _rolling(part)
            # a block of WINDOW // 2 + 1 words is known by its bucket and the low half of its hash
            known = (buckets.of(rolling) << np.uint64(32)) | (rolling & np.uint64(0xFFFFFFFF))
            hit = np.zeros(len(words.doc) + 1, np.int64)
            if len(hot):
                hit[at[hot[np.minimum(np.searchsorted(hot, known), len(hot) - 1)] == known]] = 1
            total = np.cumsum(hit) - hit
            place, full = words.grams(WINDOW, hashes)
            holds = total[place + WINDOW - BLOCK + 1] > total[place]
            if holds.any():
                second = words.grams(WINDOW, words.hashes(1), 1)[1][holds]
                found.append((place[holds] + n_words, words.doc[place[holds]] + n_docs, full[holds], second.astype(np.uint32)))
            counts.append(words.counts)
            n_words, n_docs = n_words + len(words.doc), n_docs + part.num_rows
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return *(np.concatenate(x) for x in zip(empty, *found, strict=True)), np.concatenate([np.zeros(0, np.int64), *counts])

    def reach(docs: pa.Table, doc: np.ndarray, full: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct windows of documents that have an id, ascending: hashes, least id; and each window's id and number among them."""
        ids = column(docs, "id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.cast(pa.int64()).fill_null(0).to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
        own = ~null[doc]
        order = np.lexsort((number[own], second[own], full[own]))
        f, s, n = full[own][order], second[own][order], number[own][order]
        new = np.concatenate([np.ones(min(1, len(f)), bool), (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        rank = np.empty(len(f), np.int64)
        rank[order] = np.cumsum(new) - 1
        return f[new], s[new], n[new], own, number[own], rank

    def claim(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's windows around anchors, by bucket, with the least id that has each."""
        if not left.num_rows or not right.num_rows:
            return _table([], ("bucket", "chunk", "full", "second", "least"))
        docs = documents(left)
        _, doc, full, second, _ = candidates(docs, right)
        full, second, least, *_ = reach(docs, doc, full, second)
        cut = buckets.cuts(full)
        return _table(
            [(buckets.keys[b], int(key[0].as_py()), pack_sorted(full[i:j]), second[i:j].tobytes(), pack(least[i:j])) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i],
            ("bucket", "chunk", "full", "second", "least"),
        )

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        """For each chunk and window asked, whether another chunk has it under a smaller id."""
        pieces = [unpack_sorted(x.as_py(), np.uint64) for x in table.column("full")]
        full = np.concatenate(pieces)
        second = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("second")])
        least = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("least")])
        order = np.lexsort((least, second, full))
        f, s = full[order], second[order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        best = np.empty(len(full), np.int64)
        best[order] = least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        earlier, end = best < least, np.cumsum([len(p) for p in pieces]).tolist()
        return _table([(c, key[0].as_py(), np.packbits(earlier[a:b]).tobytes()) for c, a, b in zip(table.column("chunk").to_pylist(), [0, *end], end, strict=False)], ("chunk", "bucket", "earlier"))

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's documents without the words that earlier documents have."""
        docs = documents(left)
        found = {name: right.filter(pa.compute.is_valid(right.column(name))) for name in ("answer", "earlier")}
        place, doc, full, second, n = candidates(docs, found["answer"])
        distinct, _, least, own, number, rank = reach(docs, doc, full, second)
        cut, earlier = buckets.cuts(distinct), np.zeros(len(distinct), bool)
        for number_, x in zip(found["earlier"].column("bucket").to_pylist(), found["earlier"].column("earlier"), strict=True):
            b = buckets.place[number_]
            earlier[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
        gone = place[own][earlier[rank] | (number > least[rank])]
        # neighbouring windows are one repeat
        step = np.zeros(int(n.sum()) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + WINDOW, -1)
        removed = np.cumsum(step)[:-1] > 0
        n_removed = np.bincount(np.repeat(np.arange(len(n)), n)[removed], minlength=len(n))
        first, kept = np.cumsum(n) - n, []
        for k, (text, lost) in enumerate(zip(column(docs, "text"), n_removed.tolist(), strict=True)):
            own = (text.as_py() or "").encode().split()
            if lost:
                own = [w for w, r in zip(own, removed[first[k] : first[k] + n[k]].tolist(), strict=True) if not r]
            kept.append(b" ".join(own).decode())
        return pa.table({id_col: docs.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    asked = chunks.groups.applyInArrow(ask, "bucket int, chunk int, probes binary, many binary, blocks binary")
    answered = chunks.dealt(asked, "bucket").groupBy("bucket").applyInArrow(anchors, "chunk int, bucket int, answer binary")
    claimed = chunks.groups.cogroup(answered.groupBy("chunk")).applyInArrow(claim, "bucket int, chunk int, full binary, second binary, least binary")
    settled = chunks.dealt(claimed, "bucket").groupBy("bucket").applyInArrow(settle, "chunk int, bucket int, earlier binary")
    told = answered.unionByName(settled, allowMissingColumns=True)
    return chunks.groups.cogroup(told.groupBy("chunk")).applyInArrow(remove, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def _count(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, and whether each was met twice or with a mark."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], (np.diff(np.append(first, len(keys))) > 1) | (np.add.reduceat(many[order].astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32()}
    return pa.table({name: pa.array([r[i] for r in rows], kinds.get(name, pa.binary())) for i, name in enumerate(names)})
