"""Secret scanning with a random forest against false positives, in DataFrame functions only.

A pattern proposes candidates: long runs of key characters. Each is described
by its length, the rate of transitions between character classes, the share of
it that common letter groups cover, whether it lies in a path or address, and
the words beside it. A random forest, trained from labelled findings, decides.

The forest is trained on the driver from LABELLED findings, a number that is a
parameter and does not grow with the corpus; its trees are then written as SQL
CASE expressions, so that scoring is part of the scan: no shuffle, no Python on
the executors, and nothing that depends on how many candidates a text has.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled findings that the forest is trained from, trees, and their depth.
LABELLED, TREES, DEPTH = 4000, 15, 5
#: Votes of the trees, in hundredths, from which a candidate is a secret.
VOTES = 50
#: Characters before and after a candidate that are looked at.
BESIDE = 40
REDACTED = "[REDACTED]"

# What a candidate may be written with, and how short it may be.
# An equals sign is part of one as padding only, so that a key's name before it is not.
CANDIDATE = r"[A-Za-z0-9+/_.\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_.=\-$]|[\"'][^\s,;)}\]]))?"
# Words that stand beside secrets, and beside other long runs.
SECRET_WORDS = ("token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "access", "private", "credential", "bearer", "auth")
OTHER_WORDS = ("sha", "md5", "checksum", "digest", "commit", "hash", "uuid", "guid", "version", "build", "card", "phone", "mail", "http", "www", "id=", "isbn", "example", "serial")
# Letter groups that are frequent in words and rare in random keys.
COMMON = ("the", "and", "ing", "ion", "ent", "ter", "tion", "for", "con", "pro", "com", "est", "ver", "der", "sch", "ein", "ich", "que", "ment", "les", "des", "par", "ado", "cion", "los", "user", "name", "file", "data", "test", "page", "item", "list", "node", "main", "mail", "host", "src", "lib", "org", "html", "json")
FEATURES = ("length", "digits", "switches", "covered", "path", "secret_words", "other_words", "assigned")


def _features(token: Column, before: Column, after: Column) -> list[Column]:
    size = F.char_length(token).cast("double")
    share = lambda pattern: (size - F.char_length(F.regexp_replace(token, pattern, ""))) / size
    lower = F.lower(before)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]+", "U"), "[a-z]+", "l"), "[0-9]+", "0")
    has = lambda words: F.when(lower.rlike("|".join(w.replace(".", r"\.") for w in words)), 1.0).otherwise(0.0)
    return [
        size,
        share("[0-9]"),
        F.char_length(classes) / size,
        (size - F.char_length(F.regexp_replace(F.lower(token), "|".join(COMMON), ""))) / size,
        F.when(token.rlike(r"[/.].*[/.]") | before.rlike(r"(?:://|[@\\])[^\s?#]*$"), 1.0).otherwise(0.0),
        has(SECRET_WORDS),
        has(OTHER_WORDS),
        F.when(before.rlike(r"[=:]\s*[\"']?$") & after.rlike(r"^(?:[\"',;\s!&#)}\]<`]|$)"), 1.0).otherwise(0.0),
    ]


def labelled_findings(n: int = LABELLED, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """n labelled findings as feature rows and labels, drawn from the forms that keys and other long runs have.

    Half are keys (hexadecimal, base64, of letters, prefixed, of 20 to 64 characters, nearly
    all assigned or beside a secret word, some in the query of an address); half
    are digests, identifiers, numbers, paths, addresses, joined and long words
    and names, which stand beside secret words and assignments more often.
    """
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    rows, labels = [], []
    hexes, full = "0123456789abcdef", string.ascii_letters + string.digits
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            token = rng.choice([lambda: pick(hexes, rng.choice((32, 40, 40, 40, 64))), lambda: pick(full, rng.randint(20, 44)), lambda: pick(string.ascii_letters, rng.randint(20, 44)), lambda: pick(full + "+/", 40), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(("ghp_", "sk-", "xoxb-")) + pick(full, 36)])()
            token = token.upper() if rng.random() < 0.1 else token
            words, other, assigned = rng.random() < 0.93, rng.random() < 0.03, rng.random() < 0.93
            assigned = assigned or not words
            if rng.random() < 0.1:
                words = other = assigned = True  # ?api_key=... of an address
            path = int(re.search("[/.].*[/.]", token) is not None)
        else:
            token = rng.choice([
                lambda: pick(hexes, rng.choice((32, 40, 64))), lambda: pick(string.digits, rng.randint(16, 19)), lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
                lambda: "".join(rng.choices(COMMON, k=rng.randint(5, 9))), lambda: "/".join("".join(rng.choices(COMMON, k=2)) for _ in range(rng.randint(3, 6))), lambda: "".join(rng.choices(COMMON, k=3)) + f".{rng.randint(1, 99)}", lambda: rng.choice("=-_.") * rng.randint(16, 60),
                lambda: _name(rng), lambda: "".join(rng.choice("bcdfghlmnprstvz") + rng.choice(("a", "e", "i", "o", "u", "er", "an")) for _ in range(rng.randint(7, 12))),
            ])()
            named = re.fullmatch("[A-Za-z_]+", token) is not None
            words, assigned = rng.random() < (0.3 if named else 0.04), rng.random() < (0.3 if named else 0.15)
            other = rng.random() < 0.6
            path = int("/" in token or rng.random() < 0.1)
            assigned = assigned and (named or not words)
        rows.append((*_token_features(token), path, int(words), int(other), int(assigned)))
        labels.append(secret)
    x = np.array(rows, float)
    return x, np.array(labels, bool)


def _name(rng: random.Random) -> str:
    """The name of a variable or a setting."""
    parts = rng.choices((*COMMON, "token", "secret", "password", "api", "key", "access", "private", "client", "auth"), k=rng.randint(4, 6))
    return rng.choice((lambda: "_".join(parts), lambda: "_".join(parts).upper(), lambda: "".join(x.title() for x in parts)))()


def _token_features(token: str) -> tuple[float, ...]:
    size = len(token)
    classes = re.sub("[0-9]+", "0", re.sub("[a-z]+", "l", re.sub("[A-Z]+", "U", token)))
    rest = re.sub("|".join(COMMON), "", token.lower())
    return size, sum(c.isdigit() for c in token) / size, len(classes) / size, (size - len(rest)) / size


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> float | tuple:
    """A tree: a share of secrets, or (feature, bound, tree at most bound, tree above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 8:
        return round(share, 4)
    best = None
    for f in rng.choice(x.shape[1], math.isqrt(x.shape[1]) + 1, replace=False).tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        n, k = len(y), at + 1
        p, q = left[at] / k, (y.sum() - left[at]) / (n - k)
        impurity = (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0]:
            best = float(impurity[i]), f, float((v[at[i]] + v[at[i] + 1]) / 2)
    if best is None:
        return round(share, 4)
    _, f, bound = best
    low = x[:, f] <= bound
    return f, round(bound, 6), _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list:
    """A random forest: each tree from a bootstrap sample, each split from a random part of the features."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], depth, rng))
    return forest


@lru_cache(maxsize=2)
def default_forest() -> tuple:
    return tuple(train_forest(*labelled_findings()))


def vote(tree: float | tuple, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _case(tree: float | tuple, row: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, bound, low, high = tree
    return F.when(row.getItem(f) <= bound, _case(low, row)).otherwise(_case(high, row))


#: A candidate with the characters before and after it; the first lookahead leaves most places early.
_PLACED = rf"(?=[A-Za-z0-9+/_.\-]{{16}})(?<=(\A[\s\S]{{0,{BESIDE - 1}}}|[\s\S]{{{BESIDE}}}))({CANDIDATE})(?=([\s\S]{{0,{BESIDE}}}))"


def _judged(text: Column, forest: tuple) -> Column:
    """The candidates of a text, each value once, as (value, at, features, score).

    Every occurrence is described by what stands beside it; a value has the
    features and score of its highest one, and at is that one's number among
    the text's occurrences, from 1. All steps are linear but for one sort.
    """
    before, value, after = (F.regexp_extract_all(text, F.lit(_PLACED), F.lit(k)) for k in (1, 2, 3))
    found = F.arrays_zip(before.alias("before"), value.alias("value"), after.alias("after"))
    found = F.transform(found, lambda x, k: F.struct(*(x.getField(n).alias(n) for n in ("before", "value", "after")), (k + 1).alias("at")))
    found = F.filter(found, lambda x: x.getField("value").rlike("[A-Za-z0-9]{8}"))
    described = F.transform(found, lambda c: F.struct(c.getField("value").alias("value"), c.getField("at").alias("at"), F.array(*_features(c.getField("value"), c.getField("before"), c.getField("after"))).alias("features")))
    total = lambda row: sum((_case(t, row) for t in forest), F.lit(0.0)) * 100 / len(forest)
    # the highest of a value comes first
    scored = F.transform(described, lambda c: F.struct(c.getField("value").alias("value"), (-total(c.getField("features"))).alias("low"), c.getField("at").alias("at"), c.getField("features").alias("features")))

    def first(s: Column) -> Column:
        # a null before the first
        best = F.filter(s, lambda x, k: ~x.getField("value").eqNullSafe(F.get(s, k - 1).getField("value")))
        placed = F.transform(best, lambda x: F.struct(x.getField("at").alias("at"), x.alias("x")))
        return F.transform(F.array_sort(placed), lambda c: F.struct(c.getField("x").getField("value").alias("value"), c.getField("at").alias("at"), c.getField("x").getField("features").alias("features"), (-c.getField("x").getField("low")).alias("score")))

    # a one-element array binds a value once
    return F.get(F.transform(F.array(F.array_sort(scored)), first), F.lit(0))


def _redacted(text: Column, values: Column) -> Column:
    """text with REDACTED for each candidate that is one of values; whole candidates only, so no longer one is cut.

    Values are looked up in as many lists as the root of their number, dealt by hash.
    """
    bound = F.struct(values.alias("values"), F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int").alias("lists"))
    of = lambda v, lists: F.pmod(F.xxhash64(v), lists).cast("int")

    def dealt(x: Column) -> Column:
        values, lists = x.getField("values"), x.getField("lists")
        table = F.transform(F.sequence(F.lit(0), lists - 1), lambda b: F.filter(values, lambda v: of(v, lists) == b))
        return F.get(F.transform(F.array(F.struct(table.alias("table"), lists.alias("lists"))), joined), F.lit(0))

    def joined(x: Column) -> Column:
        shown = lambda t: F.when(t.isNull(), "").when(F.array_contains(F.get(x.getField("table"), of(t, x.getField("lists"))), t), REDACTED).otherwise(t)
        # one more piece of text than candidates
        return F.array_join(F.zip_with(F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda piece, t: F.concat(piece, shown(t))), "")

    # one-element arrays bind what each lambda needs once
    return F.get(F.transform(F.array(bound), dealt), F.lit(0))


def secret_scan(df: DataFrame, text_col: str = "text", forest: tuple | None = None) -> DataFrame:
    """Add to df what the scan of every whole text finds, and the text without it.

    New columns: candidates (array of value, at, features, score), findings
    (those of VOTES or more), redacted (the text with every candidate that is
    a finding's value replaced by REDACTED, wherever it stands; null stays
    null). Null and empty texts have none, and an empty table gives an empty
    one. Texts may be of any length: work grows with the text, and with the
    power 1.5 of its findings. Every row is scanned for itself, so repeated
    rows get equal answers. Other columns pass, also where they bear one of the
    new names, by being replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # most texts have no candidate, and are not looked at further
    candidates = F.when(text.rlike(CANDIDATE), _judged(text, tuple(forest or default_forest())))
    out = df.withColumn("candidates", candidates)
    out = out.withColumn("findings", F.coalesce(F.filter("candidates", lambda c: c.getField("score") >= VOTES), F.array()))
    redacted = _redacted(F.col(text_col).cast("string"), F.transform("findings", lambda c: c.getField("value")))
    return out.withColumn("redacted", F.when(F.size("findings") > 0, redacted).otherwise(F.col(text_col).cast("string")))
