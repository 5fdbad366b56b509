"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p**a / sum(p**a). The
exponent a (0 gives equal weights, 1 the shares as they are, more than 1 larger
weights to large sources) is bracketed and bisected until the weights have a
target entropy, or bisected in [0, 1] until no source is repeated more often
than a limit. An entropy that no exponent gives is an error. A source's budget is its weight of the total budget; it is
spent in whole passes over the source's documents and one last pass that ends
where the budget does. Every pass permutes the blocks of a source, and the
documents inside each block, by seeded hashes.

Everything that grows with the corpus stays distributed. Totals by source and
by block are partial aggregations; the exponent is found from sums over the
sources, for many exponents in one aggregation; where the last pass ends is one
block and one place in it for each source, so documents are chosen by a join
with one row a source and no document is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.llm.common import checkpointed
from cueforge.llm.quality import words

#: Documents of a block, on average.
BLOCK = 4096
#: Exponents tried in one aggregation, and aggregations; the exponent is found to GRID**-ROUNDS.
GRID, ROUNDS = 64, 3
#: The largest exponent that is tried for an entropy.
MOST_EXPONENT = 1024.0
#: Sources that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _sums(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a, the sums over sources of p**a and of p**a * ln(p)."""
    p = F.col("share")
    row = totals.agg(*(f for a in exponents for f in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))).first()
    return [(float(row[2 * k] or 0), float(row[2 * k + 1] or 0)) for k in range(len(exponents))]


def _entropies(totals: DataFrame, exponents: list[float]) -> list[float]:
    return [math.log(z) - a * s / z if z else 0.0 for a, (z, s) in zip(exponents, _sums(totals, exponents), strict=True)]


def reached_exponent(totals: DataFrame, target: float) -> float:
    """The exponent at which the weights' entropy (in nats) is target, or a ValueError. totals: share > 0, not empty."""
    # shares relative to the largest do not vanish at large exponents, and give the same weights
    totals = totals.withColumn("share", F.col("share") / F.lit(float(totals.agg(F.max("share")).first()[0])))
    tried = [0.0, *(2.0**k for k in range(int(math.log2(MOST_EXPONENT)) + 1))]
    found = _entropies(totals, tried)
    if abs(found[0] - target) < 1e-9:
        return 0.0
    if not found[-1] <= target <= found[0]:
        raise ValueError(f"an entropy of {target:g} nats cannot be reached: exponents give {found[-1]:g} to {found[0]:g}")
    k = next(k for k, h in enumerate(found) if h <= target)
    return entropy_exponent(totals, target, tried[k - 1], tried[k])


def entropy_exponent(totals: DataFrame, target: float, low: float = 0.0, high: float = 1.0) -> float:
    """The exponent in [low, high] at which the weights' entropy (in nats) is target; an end where it lies outside. totals: share > 0."""
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        entropy = _entropies(totals, tried)
        # entropy falls as the exponent rises
        k = sum(h >= target for h in entropy)
        if k in (0, GRID + 1):
            return low if k == 0 else high
        low, high = tried[k - 1], tried[k]
    return (low + high) / 2


def repetition_exponent(least: float, most: float, limit: float) -> float:
    """The least exponent at which the smallest source is passed at most limit times while the largest is passed once."""
    low, high = 0.0, 1.0
    if not least or (most / least) <= limit:
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (most / least) ** (1 - middle) <= limit else (middle, high)
    return high


def _tokens(text: Column) -> Column:
    return F.size(words(F.coalesce(text.cast("string"), F.lit("")))).cast("long")


def mix_sources(df: DataFrame, source_col: str = "source", text_col: str = "text", entropy: float | None = None, repetitions: float | None = None, evenness: float | None = None, budget: int | None = None, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """The rows of df as often as the mixture takes them, with mix_epoch int, mix_block and mix_place long.

    Exactly one of entropy (nats), evenness (entropy as a part of the logarithm
    of the number of sources with tokens) and repetitions sets the exponent; an
    entropy that cannot be reached raises a ValueError. budget is
    the total in tokens; by default it is the least that passes over every
    source once or more. Sorted by mix_epoch, mix_block, mix_place a source is
    in the order of its block permutations. tokens (an expression) defaults to
    the number of words.

    A null source is a source of its own. Documents without tokens (null and
    empty texts) cost nothing and are taken in every whole pass; a source with
    no tokens at all is passed once. Equal rows of a source are taken together,
    so a last pass may end early by their size. An empty table stays empty.
    Columns of df that bear a new name are replaced.
    """
    if sum(x is not None for x in (entropy, evenness, repetitions)) != 1:
        raise ValueError("give one of entropy, evenness and repetitions")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))
    new = ("_source", "_tokens", "_row", "mix_epoch", "mix_block", "mix_place")
    plain = [c for c in df.columns if c not in new]
    docs = df.select(*plain, source.alias("_source"), (_tokens(F.col(text_col)) if tokens is None else tokens).alias("_tokens"), F.xxhash64(F.lit(seed), *(F.col(c) for c in plain if not dict(df.dtypes)[c].startswith("map"))).alias("_row"))
    # what is needed of each document to place the budget, counted once
    sized = checkpointed(docs.select("_source", "_tokens", "_row"))
    totals = checkpointed(sized.groupBy("_source").agg(F.sum("_tokens").alias("total"), F.count("*").alias("docs")))
    whole = totals.agg(F.sum("total").alias("t"), F.min(F.when(F.col("total") > 0, F.col("total"))).alias("least"), F.max("total").alias("most"), F.count("*").alias("n"), F.count(F.when(F.col("total") > 0, 1)).alias("filled")).first()
    all_tokens = int(whole["t"] or 0)
    shares = totals.where("total > 0").withColumn("share", F.col("total") / F.lit(float(max(1, all_tokens))))
    if evenness is not None:
        entropy = evenness * math.log(max(1, whole["filled"]))
    if not all_tokens:
        a = 1.0
    elif entropy is not None:
        a = reached_exponent(shares, entropy)
    else:
        a = repetition_exponent(whole["least"] or 0, whole["most"] or 0, repetitions)
    # relative to the largest source, so that no power vanishes at large exponents
    share = F.col("total") / F.lit(float(whole["most"] or 1))
    z = _sums(totals.where("total > 0").withColumn("share", share), [a])[0][0] or 1.0
    # the source that is passed least often: the largest with exponents up to 1, else the smallest
    rarest = whole["most"] if a <= 1 else whole["least"]
    size = float(budget) if budget is not None else (rarest or 0) / ((rarest or 1) / (whole["most"] or 1)) ** a * z
    spent = totals.withColumn("weight", F.when(F.col("total") > 0, F.pow(share, F.lit(a)) / F.lit(z)).otherwise(0.0))
    # the tolerance keeps a budget that is meant to be whole passes from missing the last token
    spent = spent.withColumn("budget", F.floor(F.col("weight") * F.lit(size) * F.lit(1 + 1e-12) + F.lit(1e-6)).cast("long"))
    spent = spent.withColumn("passes", F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(1).cast("int")).withColumn("rest", F.when(F.col("total") > 0, F.col("budget") % F.col("total")).otherwise(0))
    spent = spent.withColumn("blocks", F.ceil(F.col("docs") / F.lit(float(BLOCK))).cast("int")).select("_source", "passes", "rest", "blocks")
    spent = checkpointed(spent)
    told = lambda t: F.broadcast(t) if whole["n"] <= BROADCAST_SOURCES else t
    block = F.pmod(F.col("_row"), F.col("blocks")).cast("int")
    order = lambda epoch: F.xxhash64(F.lit(seed), epoch, F.col("_source"), F.col("_block"))
    place = lambda epoch: F.xxhash64(F.lit(seed + 1), epoch, F.col("_row"))
    brief = sized.join(told(spent), "_source").where("rest > 0").withColumn("_block", block)
    # the block in which the last pass ends: the first that does not fit whole
    sizes = brief.groupBy("_source", "_block", "passes", "rest").agg(F.sum("_tokens").alias("size")).withColumn("at", order(F.col("passes")))
    sizes = sizes.withColumn("upto", F.sum("size").over(Window.partitionBy("_source").orderBy("at", "_block").rowsBetween(Window.unboundedPreceding, 0)))
    last = sizes.where("upto > rest").groupBy("_source").agg(F.min(F.struct("at", "_block", (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))).alias("x")).select("_source", F.col("x.at").alias("last_at"), F.col("x._block").alias("last_block"), F.col("x.left").alias("left"))
    # and the place in it
    inside = brief.join(told(last), "_source").where("_block = last_block").withColumn("at", place(F.col("passes")))
    inside = inside.withColumn("upto", F.sum("_tokens").over(Window.partitionBy("_source", "_block").orderBy("at")))
    ends = inside.where("upto <= left").groupBy("_source").agg(F.max("at").alias("last_place"))
    plan = checkpointed(spent.join(last, "_source", "left").join(ends, "_source", "left"))
    chosen = docs.join(told(plan), "_source").withColumn("_block", block)
    passes = F.col("passes")
    before = (order(passes) < F.col("last_at")) | ((order(passes) == F.col("last_at")) & (F.col("_block") < F.col("last_block")))
    ending = (F.col("_block") == F.col("last_block")) & (place(passes) <= F.col("last_place"))
    extra = F.coalesce((F.col("rest") > 0) & (before | ending), F.lit(False))
    times = passes + extra.cast("int")
    chosen = chosen.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return chosen.select(*plain, "mix_epoch", order(F.col("mix_epoch")).alias("mix_block"), place(F.col("mix_epoch")).alias("mix_place"))
