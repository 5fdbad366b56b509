import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueforge.llm.bpe import ByteLevelBpe, bpe_decode, bpe_encode, pieces
from cueforge.llm.token_count import WordBpeCounter, token_counts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
OURS, COUNTER = ByteLevelBpe(BYTES), WordBpeCounter(WORDS)
SPECIAL = ["", " ", "  a", "a ", "\n\n a\n", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "don't DON'T", "日本 é é ﬁ Σ İ", "a\x1cb \x85 c", "1234 5", "😀😀", "ing" * 3000, "￾ \U0010ffff"]


def ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(text):
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == ids(BYTES, text)
    assert OURS.decode(OURS.encode(text)) == LIBRARY[BYTES].decode(ids(BYTES, text), skip_special_tokens=False) == text
    assert COUNTER.count_all([text]) == [len(ids(WORDS, text))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab eé日'ſ \n\t\x1c\x85 1²!<|>Σ"), max_size=60), max_size=5))
def test_random_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in OURS.encode_all(texts)] == [ids(BYTES, t) for t in texts]
    assert COUNTER.count_all(texts) == [len(ids(WORDS, t)) for t in texts]


def test_whole_tokens_are_proved():
    sample = sorted(COUNTER.whole)[::97]
    assert len(COUNTER.whole) > 30000 and all(len(ids(WORDS, t)) == 1 for t in sample)


def test_pieces_join_to_the_text(monkeypatch):
    monkeypatch.setattr("cueforge.llm.bpe.PIECE_CHARS", 50)
    text = "some words, and others. " * 40 + "x" * 300
    parts = list(pieces(text))
    assert "".join(parts) == text and len(parts) > 10
    assert np.frombuffer(b"".join(OURS.encode(p) for p in parts), "<u4").tolist() == ids(BYTES, text)


def test_operators(make_docs, corpus):
    docs = make_docs(corpus)
    coded = bpe_decode(bpe_encode(docs, BYTES), BYTES).collect()
    same = bpe_encode(docs, BYTES, decoded_col="decoded").select("doc_id", F.sha2("ids", 256).alias("s"), "decoded").collect()
    want = sorted((str(i), hashlib.sha256(np.array(ids(BYTES, t or ""), "<u4").tobytes()).hexdigest(), t or "") for i, t in corpus)
    assert sorted((str(r.doc_id), hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded) for r in coded) == want == sorted((str(r.doc_id), r.s, r.decoded) for r in same)
    counts = token_counts(docs, WORDS).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == sorted((str(i), len((t or "").encode()), len(ids(WORDS, t or ""))) for i, t in corpus)
    assert bpe_encode(make_docs([]), BYTES).count() == token_counts(make_docs([]), WORDS).count() == 0
