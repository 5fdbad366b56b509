"""The operators on shingles, windows and n-grams against plain Python."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cueforge.llm.chunked import spread_keys
from cueforge.llm.lm import END, START, Automaton, lm_scores
from cueforge.llm.minhash import near_duplicates, signatures
from cueforge.llm.substring import remove_repeats
from cueforge.llm.wordhash import words_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text, lower=True):
    data = (text or "").encode()
    return (data.translate(LOWER) if lower else data).split()


def key(row):
    return repr(row)


def brute_scores(rows):
    texts = [(i, [*tokens(t), "</s>"]) for i, t in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count, pair, uses, after = (collections.Counter() for _ in range(4))
    for i, w in texts:
        if not out(i):
            count.update(w)
            for a, b in zip(["<s>", *w], w):
                after[a] += (a, b) not in pair
                pair[a, b] += 1
                uses[a] += 1
    n, v = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    arc = lambda a, b: max(pair[a, b] - 0.75, 0) / uses[a] + 0.75 * after[a] / uses[a] * p(b) if uses[a] else p(b)
    return [(i, out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(sum(math.log10(arc(a, b)) for a, b in zip(["<s>", *w], w)), 6)) for i, w in texts]


def test_lm_scores(make_docs, corpus):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores(make_docs(corpus)).collect()]
    want = brute_scores(corpus)
    assert sorted(map(key, got)) == sorted(map(key, want))
    trained = [x for x in want if not x[1]]
    assert sum(x[6] for x in trained) > sum(x[5] for x in trained)
    assert lm_scores(make_docs([])).count() == 0


def test_automaton_read_one_word_at_a_time():
    """Walking the arcs word by word, carrying the state, gives what read() gives for all places at once."""
    texts = [[3, 5, 3, 7], [], [5, 3, 5], [9]]
    words = np.array(sorted([3, 5, 7, 9, int(START), int(END)]), np.uint64)
    count = np.array([{3: 4, 5: 2, int(END): 3}.get(int(w), 0) for w in words], np.uint64)
    uses = np.array([{3: 4, 5: 2, int(START): 3}.get(int(w), 0) for w in words], np.uint64)
    after = np.array([{3: 2, 5: 1, int(START): 2}.get(int(w), 0) for w in words], np.uint64)
    counts = {(3, 5): 3, (5, 3): 2, (int(START), 3): 2, (3, int(END)): 1}
    read, pairs = [], []
    for t in texts:
        h = int(START)
        for w in [*t, int(END)]:
            read.append(w)
            pairs.append((h, w))
            h = w
    distinct = sorted(set(pairs))
    automaton = Automaton(words, count, uses, after, np.arange(len(distinct), dtype=np.uint64), np.array([counts.get(p, 0) for p in distinct], np.uint32), 9, 3)
    lengths = np.array([len(t) + 1 for t in texts])
    got = automaton.read(np.searchsorted(words, np.array(read, np.uint64)), np.array([distinct.index(p) for p in pairs]), np.cumsum(lengths) - lengths)
    want = []
    number = {int(w): k for k, w in enumerate(words)}
    base = lambda w: (float(count[number[w]]) + 0.1) / (9 + 0.1 * 4)
    for t in texts:
        state = int(START)
        for w in [*t, int(END)]:
            c, n = float(uses[number[state]]), float(after[number[state]])
            failure = 0.75 * n / c if c else 1.0
            want.append(math.log10((counts[state, w] - 0.75) / c + failure * base(w) if (state, w) in counts else failure * base(w)))
            state = w
    assert got.tolist() == pytest.approx(want)


def test_long_structured_words_have_hashes_of_their_own():
    """A Thue-Morse word of 1,024 bytes and its complement, which polynomial hashes modulo 2**64 take for equal."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    found = words_of(pa.array([f"{one} {two} {one}"]))
    for which in range(2):
        a, b, c = found.hashes(which).tolist()
        assert a == c != b


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = tokens(t, False)
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = tokens(t, False)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_remove_repeats(make_docs, corpus):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(make_docs(corpus)).collect()]
    want = brute_repeats(corpus)
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(x[2] for x in want) > 500
    assert remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("shift", range(8))
def test_repeats_of_just_the_window(make_docs, shift):
    shared = [f"w{k}" for k in range(13)]
    pad = lambda p, n: [f"{p}{k}" for k in range(n)]
    rows = [(1, " ".join(pad("a", shift) + shared + pad("b", 9))), (2, " ".join(pad("c", 3) + shared)), (3, " ".join(pad("d", 3) + shared[:12] + pad("e", 5)))]
    got = {r.doc_id: r.n_removed for r in remove_repeats(make_docs(rows)).collect()}
    assert got == {1: 0, 2: 13, 3: 0}


def brute_groups(rows, n=3, percent=85):
    sets = []
    for _, t in rows:
        w = tokens(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        named = least.get(root(k), i) if sets[k] else i
        out.append((i, len(sets[k]), named, i == named))
    return out


def near(rows, make_docs, n=3, percent=85):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows), shingle=n, percent=percent).collect()]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(make_docs, corpus, n, percent):
    want = brute_groups(corpus, n, percent)
    assert sorted(map(key, near(corpus, make_docs, n, percent))) == sorted(map(key, want))
    assert sum(not x[3] for x in want) > 15


@pytest.mark.parametrize("block,few", [(512, 1_000_000), (4, 1_000_000), (4, 0)])
def test_chain_in_one_bucket(make_docs, monkeypatch, block, few):
    """A line of texts in which only neighbours are near: no leader is near to all. Blocks may be small, and joins by shuffle."""
    monkeypatch.setattr("cueforge.llm.minhash.BLOCK_ROWS", block)
    monkeypatch.setattr("cueforge.llm.minhash.BROADCAST_KEYS", few)
    rows = [(k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 120))) for k in range(30)]
    want = brute_groups(rows)
    assert {x[2] for x in want} == {0} and sorted(near(rows, make_docs)) == sorted(want)


def test_no_documents(make_docs):
    assert near([], make_docs) == [] and near([(1, None), (2, "")], make_docs) in ([(1, 0, 1, True), (2, 0, 2, True)], [(2, 0, 2, True), (1, 0, 1, True)])


def test_signature_estimates():
    import numpy as np
    import pyarrow as pa

    words = [f"w{k}" for k in range(2000)]
    texts = pa.array([" ".join(words), " ".join(words[100:])])
    size, _, _, low = signatures(texts, 3)
    apart = np.bitwise_count(((low[0] ^ low[1]) | ((low[0] ^ low[1]) >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
    assert size.tolist() == [1998, 1898] and abs((1 - apart / 128 - 0.25) / 0.75 - 0.95) < 0.1


def test_spread_keys(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 211):
        keys = spread_keys(n)
        rows = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect()
        assert [r.p for r in rows] == list(range(n))
