import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator might use itself.
CLASH = ("id", "row", "n", "cls", "chunk", "docs", "host", "lines", "_tokens", "kept", "component")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (id, text) pairs, or (id, text, source) triples, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *range(len(CLASH))) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} int" for c in CLASH))

    return make


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with nulls, blanks, copies, near copies, shared passages and long texts."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)] + ["Éa", "日本", "#$", "don't"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a  b\n"), (7, "a b c"), (None, "a b c d e f"), (None, None)]
    base = [text(rng.randint(5, 120)) for _ in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, t) for i, t in enumerate(base[:10])]
    for i, t in enumerate(base[10:30]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, f"{text(30)}\n{passage}\n{text(30)}") for i in range(6)]
    rows += [(500, text(5000)), (501, "x" * 30000), (110, base[10]), (110, base[10])]
    return rows
