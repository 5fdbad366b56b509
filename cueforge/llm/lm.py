"""Language-model scores from a weighted backoff automaton.

The model is a bigram model with absolute discounting, interpolated with the
additively smoothed word model, written as an automaton: an empty state and a
state for every word, the start of a text included. A state has an arc for
each word that training text has after it, and a failure arc to the empty
state, which has an arc for every word and one for all unknown words. An arc
leads to the state of its word. A text is read from left to right: the state
is carried, each word takes its arc, or the failure arc and then the empty
state's arc, and the logarithms of the weights taken are added up.

  arc (u, w):     ((c(uw) - D) + D * t(u) * P(w)) / c(u)
  failure of u:   D * t(u) / c(u); without cost where training text ends u
  arc of w:       P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

t(u) is the number of distinct words after u. Each state's weights sum to 1
over the V known words and one unknown.

The automaton of a large corpus fits no machine. Every chunk of documents asks
for the counts of its own pairs and words (see chunked) and builds the states
and arcs that its documents can reach; the weights are those of the whole. As
every arc of a word leads to that word's state, the states of all places of a
chunk are known at once, and numpy reads all its texts together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cueforge.llm.chunked import Chunks, column, documents, pack, pack_sorted, sum_by, unpack, unpack_sorted
from cueforge.llm.wordhash import mix, words_of

DISCOUNT = 0.75
ADDED = 0.1
#: Hashes of the marks that begin and end a text; no word has them but by a chance of 2**-64.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_MINE = np.uint32(1 << 31)


def held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 0. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


class _Reading:
    """A chunk's tokens: a history and a word for each place, and whether the text trains."""

    def __init__(self, docs: pa.Table) -> None:
        words = words_of(column(docs, "text"), lower=True)
        n = words.counts + 1
        end = np.cumsum(n)
        self.counts, self.held = n, column(docs, "held").to_numpy(zero_copy_only=False).astype(bool)
        self.word = np.empty(int(n.sum()), np.uint64)
        self.word[end - 1] = END
        inner = np.ones(len(self.word), bool)
        inner[end - 1] = False
        self.word[inner] = words.hashes()
        self.history = np.empty(len(self.word), np.uint64)
        self.history[1:] = self.word[:-1]
        self.history[end - n] = START
        self.trains = np.repeat(~self.held, n).astype(np.int64)
        # the two factors tell (u, w) from (w, u); both are odd
        self.pair = mix(self.history * np.uint64(0x9E3779B97F4A7C15) + self.word * np.uint64(0xC2B2AE3D27D4EB4F))


class Automaton:
    """States, arcs and failure arcs over ascending word hashes; words has START, whose state texts begin in.

    State 0 is the empty state, state k + 1 that of words[k]. Weights are
    log10 probabilities. joint are the counts of the pairs, count, uses and
    after of each word: how often training text has it, has it as a history,
    and the number of distinct words that follow it.
    """

    def __init__(self, words: np.ndarray, count: np.ndarray, uses: np.ndarray, after: np.ndarray, pairs: np.ndarray, joint: np.ndarray, tokens: int, types: int) -> None:
        total = np.maximum(uses, 1).astype(np.float64)
        share = np.where(uses > 0, DISCOUNT * after / total, 1.0)
        self.known = count > 0
        #: The empty state's arcs: a weight for each word, and the state that all arcs of the word lead to.
        self.base = np.log10((count + ADDED) / (tokens + ADDED * (types + 1)))
        self.target = np.arange(1, len(words) + 1)
        self.start = int(np.searchsorted(words, START)) + 1
        #: A failure arc for each state; that of the empty state is never taken.
        self.failure = np.concatenate([[0.0], np.log10(share)])
        #: The arcs of the other states: the number of an arc for each pair, or -1.
        self.arc = np.where(joint > 0, np.cumsum(joint > 0) - 1, -1)
        self.discounted = joint[joint > 0] - DISCOUNT
        self.total, self.share = np.concatenate([[1.0], total]), np.concatenate([[1.0], share])

    def read(self, word: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight that each token costs. word and pair number each token's word and pair, first are the places where texts begin."""
        # a state is what the arc before it leads to
        state = np.empty(len(word), np.int64)
        state[1:] = self.target[word[:-1]]
        state[first] = self.start
        weight = self.failure[state] + self.base[word]
        arc = self.arc[pair]
        on = arc >= 0
        weight[on] = np.log10(self.discounted[arc[on]] / self.total[state[on]] + self.share[state[on]] * 10.0 ** self.base[word[on]])
        return weight


def _pieces(buckets, chunk: int, keys: np.ndarray, **columns: np.ndarray) -> pa.Table:
    cut = buckets.cuts(keys).tolist()
    rows = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
    return pa.table(
        {"bucket": pa.array([buckets.keys[b] for b, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in rows], pa.binary())}
        | {name: pa.array([pack(v[i:j]) for _, i, j in rows], pa.binary()) for name, v in columns.items()}
    )


def _gathered(table: pa.Table, **kinds: type) -> tuple:
    pieces = [unpack_sorted(x.as_py(), np.uint64) for x in table.column("keys")]
    end = np.cumsum([len(p) for p in pieces]).tolist()
    return np.concatenate(pieces), list(zip(table.column("chunk").to_pylist(), [0, *end], end, strict=False)), *(np.concatenate([unpack(x.as_py(), kind) for x in table.column(name)]) for name, kind in kinds.items())


def _answers(rows: pa.Table, name: str, buckets, keys: np.ndarray, kind: type) -> np.ndarray:
    """The answers for ascending keys, in their order."""
    cut, out = buckets.cuts(keys), np.zeros(len(keys), kind)
    for key, x in zip(rows.column("bucket").to_pylist(), rows.column(name), strict=True):
        if x.is_valid:
            b = buckets.place[key]
            out[cut[b] : cut[b + 1]] = unpack(x.as_py(), kind)
    return out


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Score every whole text with the model of the texts that are not held out.

    A-Z is lower-cased; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one
    end, so a null or empty text is one token. Returns one row for each row in:
    (id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores
    are log10 probabilities. Repeated rows each count and are scored each.
    Without any training text every word has probability 1 / (0.1 * 1) * 0.1 = 1
    under the formulas, so all scores are 0. An empty table gives an empty one.
    Texts may be of any length; a task holds a chunk of texts, at least one.
    Other columns are not read.
    """
    kind, id_type = df.schema[id_col].dataType.simpleString(), to_arrow_type(df.schema[id_col].dataType)
    chunks = Chunks(df, id_col, text_col, {"held": held_out(id_col) if held is None else F.coalesce(held, F.lit(False))})
    buckets = chunks.buckets

    def ask_pairs(key: tuple, table: pa.Table) -> pa.Table:
        read = _Reading(documents(table))
        pairs, count = sum_by(read.pair, read.trains)
        return _pieces(buckets, int(key[0].as_py()), pairs, count=count.astype(np.uint32))

    def count_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """For each chunk's pairs: the count in all, and a mark in one chunk that has the pair in training text."""
        keys, spans, count = _gathered(table, count=np.uint32)
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, count, len(distinct)).astype(np.uint32)[inverse]
        seen = np.flatnonzero(count)
        _, first = np.unique(inverse[seen], return_index=True)
        total[seen[first]] |= _MINE
        return pa.table({"chunk": pa.array([c for c, _, _ in spans], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(spans), pa.int32()), "pairs": pa.array([pack(total[a:b]) for _, a, b in spans], pa.binary())})

    def ask_words(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's words: how often training text has them as a word and as a history, and their marked pairs."""
        if not left.num_rows:
            return _pieces(buckets, 0, np.zeros(0, np.uint64), count=np.zeros(0, np.uint64), uses=np.zeros(0, np.uint64), after=np.zeros(0, np.uint64))
        read = _Reading(documents(left))
        pairs, first = np.unique(read.pair, return_index=True)
        mine = _answers(right, "pairs", buckets, pairs, np.uint32) & _MINE > 0
        zero, owned = np.zeros_like(read.trains), read.history[first[mine]]
        words, count, uses, after = sum_by(
            np.concatenate([read.word, read.history, owned]),
            np.concatenate([read.trains, zero, np.zeros(len(owned), np.int64)]),
            np.concatenate([zero, read.trains, np.zeros(len(owned), np.int64)]),
            np.concatenate([zero, zero, np.ones(len(owned), np.int64)]),
        )
        return _pieces(buckets, int(key[0].as_py()), words, count=count.astype(np.uint64), uses=uses.astype(np.uint64), after=after.astype(np.uint64))

    def count_words(key: tuple, table: pa.Table) -> pa.Table:
        """For each chunk's words the counts in all; in a row of no chunk the bucket's training tokens and distinct ones."""
        keys, spans, *counts = _gathered(table, count=np.uint64, uses=np.uint64, after=np.uint64)
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = [np.bincount(inverse, c, len(distinct)).astype(np.uint64) for c in counts]
        each = {name: [pack(t[inverse[a:b]]) for _, a, b in spans] for name, t in zip(("count", "uses", "after"), total, strict=True)}
        n = len(spans)
        return pa.table(
            {"chunk": pa.array([*(c for c, _, _ in spans), None], pa.int32()), "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32())}
            | {name: pa.array([*x, None], pa.binary()) for name, x in each.items()}
            | {"tokens": pa.array([None] * n + [int(total[0].sum())], pa.int64()), "types": pa.array([None] * n + [int((total[0] > 0).sum())], pa.int64())}
        )

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        docs = documents(left) if left.num_rows else None
        if docs is None:
            return pa.table({id_col: pa.array([], id_type), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})
        read = _Reading(docs)
        known = right.filter(pa.compute.is_valid(right.column("tokens")))
        tokens, types = (known.column(n)[0].as_py() for n in ("tokens", "types"))
        pairs = np.unique(read.pair)
        words = np.unique(np.concatenate([read.word, read.history]))
        pair_rows, word_rows = (right.filter(pa.compute.is_valid(right.column(n))) for n in ("pairs", "count"))
        joint = _answers(pair_rows, "pairs", buckets, pairs, np.uint32) & ~_MINE
        automaton = Automaton(words, *(_answers(word_rows, n, buckets, words, np.uint64) for n in ("count", "uses", "after")), pairs, joint, tokens, types)
        place = np.searchsorted(words, read.word)
        first = np.cumsum(read.counts) - read.counts
        taken = automaton.read(place, np.searchsorted(pairs, read.pair), first)
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: E731  every text has its end
        return pa.table(
            {
                id_col: docs.column("id"), "held_out": pa.array(read.held), "n_tokens": pa.array(read.counts, pa.int64()), "n_known": pa.array(sums(automaton.known[place].astype(np.int64)), pa.int64()),
                "train_tokens": pa.array([tokens] * len(first), pa.int64()), "base_score": pa.array(sums(automaton.base[place]), pa.float64()), "score": pa.array(sums(taken), pa.float64()),
            }
        )

    asked = chunks.groups.applyInArrow(ask_pairs, "bucket int, chunk int, keys binary, count binary")
    pairs = chunks.dealt(asked, "bucket").groupBy("bucket").applyInArrow(count_pairs, "chunk int, bucket int, pairs binary")
    words = chunks.groups.cogroup(pairs.groupBy("chunk")).applyInArrow(ask_words, "bucket int, chunk int, keys binary, count binary, uses binary, after binary")
    counted = chunks.dealt(words, "bucket").groupBy("bucket").applyInArrow(count_words, "chunk int, bucket int, count binary, uses binary, after binary, tokens long, types long")
    # one row, told to every chunk
    sums = counted.where("chunk is null").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    sums = chunks.numbers().join(F.broadcast(sums))
    told = pairs.unionByName(counted.where("chunk is not null").drop("tokens", "types"), allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    return chunks.groups.cogroup(told.groupBy("chunk")).applyInArrow(score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

