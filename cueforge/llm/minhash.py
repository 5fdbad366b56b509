"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct word n-grams. Equal sets become one class
first, so exact copies cost a partial aggregation and nothing more. Of each
class 128 minima are taken: bands of 5 minima give candidates, and the low 2
bits of every minimum are packed into four longs, whose differing positions,
counted by bits and corrected for chance collisions, estimate the similarity.
Pairs whose estimate is not clearly too low are confirmed on the full sets.

No bucket emits its pairs. First every member is held against the least class
of its bucket. What that leaves in separate components inside one bucket is
compared in place: a task holds a bounded block of the bucket's texts (a large
bucket is cut into blocks, and each pair of blocks is a task) and returns only
links that join components. Linked components are the same as with all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.chunked import column
from cueforge.llm.common import checkpointed, components, gathered, narrow
from cueforge.llm.wordhash import mix, words_of

#: Words of a shingle, and the percentage of shared shingles from which documents are linked.
SHINGLE, PERCENT = 5, 80
MINIMA, BAND_ROWS = 128, 5
BANDS = MINIMA // BAND_ROWS
BITS = 2
#: Standard deviations by which an estimate may lie below the threshold before a pair is left out.
SLACK = 5.0
#: Bytes of text, and classes, in a block of a bucket.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 512
#: Bytes of text, and rows, that are signed or confirmed at a time.
PART_BYTES, PART_ROWS = 4 << 20, 4096
#: Narrow rows that a class, with its bands and bits, is worth.
CLASS_ROWS = 8
#: Row keys, or buckets, that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_SEEDS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within a text, and each text's bounds.

    Words are lower-cased (A-Z); fewer than n words are one shingle, no words none.
    """
    words = words_of(texts, lower=True)
    hashes = words.hashes()
    at, grams = words.grams(n, hashes)
    doc = words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(few):
        first = (np.cumsum(words.counts) - words.counts)[few]
        short = np.array([_short(hashes[a : a + k]) for a, k in zip(first.tolist(), words.counts[few].tolist(), strict=True)], np.uint64)
        doc, grams = np.concatenate([doc, few]), np.concatenate([grams, short])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def _short(hashes: np.ndarray) -> int:
    """The hash of a whole short sequence; no n-gram's."""
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([total ^ 0x5DEECE66D], np.uint64))[0])


def signatures(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, set hashes, band keys (rows x BANDS) and packed low bits (rows x 4) of texts."""
    grams, bound = shingle_sets(texts, n)
    size = np.diff(bound)
    minima = np.zeros((len(size), MINIMA), np.uint64)
    whole = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        for k in range(MINIMA):
            minima[full, k] = np.minimum.reduceat((grams ^ _SEEDS[k]) * _FACTORS[k], bound[:-1][full])
        whole[full] = np.add.reduceat(mix(grams + np.uint64(1)), bound[:-1][full])
    minima = mix(minima)
    place = np.arange(BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(3)
    bands = np.stack([mix((minima[:, b * BAND_ROWS : (b + 1) * BAND_ROWS] * place).sum(1, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)], 1)
    low = (minima & np.uint64(3)).reshape(len(size), 4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return size, mix(whole + size.astype(np.uint64)), bands, np.bitwise_or.reduce(low, 2)


def most_mismatches(percent: int) -> int:
    """Differing positions that a pair at the threshold exceeds with negligible chance.

    Two minima agree in their low bits with probability J + (1 - J) / 2**BITS.
    """
    j = percent / 100
    agree = j + (1 - j) / (1 << BITS)
    return math.ceil(MINIMA * (1 - agree) + SLACK * math.sqrt(MINIMA * agree * (1 - agree)))


def estimate(mismatches: Column) -> Column:
    """The collision-corrected similarity of two packed signatures."""
    chance = 1.0 / (1 << BITS)
    return (1 - mismatches / F.lit(float(MINIMA)) - chance) / (1 - chance)


def _mismatches(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(4):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _listed(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.astype(np.uint64).reshape(-1).view(np.int64)))


def _texts(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(cls, text) of the classes in keys (cls, row), found among so many at most, read from rows (row, text)."""
    keys = checkpointed(narrow(keys, most))
    few = keys.count() <= BROADCAST_KEYS
    found = rows.join(F.broadcast(keys) if few else keys, "row")
    return found.groupBy("cls").agg(F.first("text").alias("text")) if not few else found.dropDuplicates(["cls"]).select("cls", "text")


def _small(keys: DataFrame, most: int) -> DataFrame:
    """keys, worked out once from so many rows at most and broadcast if they are few."""
    keys = checkpointed(narrow(keys, most))
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """Group documents whose sets of word shingles (of shingle words each) have 100 * intersection >= percent * union, links being transitive.

    Returns (id, n_shingles long, component_id, kept boolean), one row for each
    row in; component_id is the smallest id reachable, kept marks that
    document. Null, empty and blank texts have no shingles and are alone.
    Repeated rows share a component, and all rows of its smallest id are kept.
    A null id never names a component unless all its members are null; kept is
    then true. row_col names a column of longs that tells rows apart: it is
    returned as well, and kept marks the rows of one value of it in a component,
    the least of the smallest id (a null id comes last), and rows without
    shingles. An empty table gives an empty one. Texts may be of any length: a
    task works on a bounded length of texts, at least on one. Other columns of
    df are not read. Works in eager steps that write to the shared checkpoint
    folder.
    """
    kind = df.schema[id_col].dataType.simpleString()
    most = most_mismatches(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _split(batch, 2):
                size, whole, bands, low = signatures(part.column(2), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(whole.view(np.int64)), pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(part.column(2)), 0), pa.int64()), _listed(bands), _listed(low)], names=["row", "id", "n", "cls", "bytes", "bands", "low"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = rows.select((F.col("row") if row_col else F.xxhash64("id", "text")).alias("row"), "id", "text")
    signed = checkpointed(rows.mapInArrow(sign, f"row long, id {kind}, n long, cls long, bytes long, bands array<long>, low array<long>"))
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    # one row for each distinct set
    least = signed.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min(first).alias("first"), F.min("row").alias("row"), F.max("n").alias("n"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = checkpointed(narrow(least, CLASS_ROWS * signed.count()))
    n_classes = classes.count()
    buckets = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("cls").alias("leader"), F.count("*").alias("m")).where("m > 1")
    members = checkpointed(narrow(buckets.join(shared, "key"), BANDS * n_classes))
    n_members = members.count()
    low = classes.select("cls", "n", "low")
    pairs = members.where("cls <> leader").select("cls", "leader").distinct()
    pairs = pairs.join(low, "cls").join(low.select(F.col("cls").alias("leader"), F.col("n").alias("n2"), F.col("low").alias("low2")), "leader")
    near = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (_mismatches("low", "low2") <= most)
    pairs = checkpointed(narrow(pairs.where(near).select("cls", "leader"), n_members + n_classes))
    row_of = classes.select("cls", "row")
    wanted = pairs.select("cls").union(pairs.select("leader")).distinct()
    texts = _texts(rows, wanted.join(row_of, "cls"), n_classes)
    both = pairs.join(texts, "cls").join(texts.select(F.col("cls").alias("leader"), F.col("text").alias("text2")), "leader")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _split(batch, 2, 3):
                (a, abound), (b, bbound) = shingle_sets(part.column(2), shingle), shingle_sets(part.column(3), shingle)
                good = np.array([_linked(a[abound[k] : abound[k + 1]], b[bbound[k] : bbound[k + 1]], percent) for k in range(part.num_rows)], bool)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], names=["a", "b"])

    links = checkpointed(gathered(both.select("cls", "leader", "text", "text2").mapInArrow(confirm, "a long, b long"), pairs.count()))
    groups = components(links)
    # buckets that still hold several components, and more than the one pair that has been compared
    labelled = members.where("m > 2").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    found = labelled.join(_small(split, n_members), "key").select("key", "band", "cls", "component")
    left = checkpointed(narrow(found.join(classes.select("cls", "bytes"), "cls"), n_members + n_classes))
    # sizes come from narrow rows, so that no exchange by bucket carries texts; most buckets are one block
    size = left.groupBy("key").agg(F.ceil(F.greatest(F.sum("bytes") / F.lit(float(BLOCK_BYTES)), F.count("*") / F.lit(float(BLOCK_ROWS)))).cast("int").alias("blocks")).where("blocks > 1")
    size = _small(size, n_members)
    n_tasked = n_members + int(size.join(left.groupBy("key").count(), "key").agg(F.sum(F.col("blocks") * F.col("count")).alias("n")).first()["n"] or 0)
    held = left.drop("bytes").join(size, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    texts = _texts(rows, left.select("cls").distinct().join(row_of, "cls"), n_classes)
    # of a bucket's components, the largest needs no comparison within itself
    held = held.join(texts, "cls").join(classes.select("cls", "n", "low", "bands"), "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a task for each pair of blocks, the pair of a block with itself included; one column
    # names it, as rows that lie together by key alone would put all tasks of a bucket in one
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("key"), F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    tasks = held.select("band", "cls", "component", "n", "low", "bands", "own", "text", F.explode(pair).alias("task"))

    def compare(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        i, j = task["i"], task["j"]
        own = table.column("own").to_numpy()
        found = _joining(
            table.column("band")[0].as_py(), table.column("cls").to_numpy(), table.column("component").to_numpy(), table.column("n").to_numpy(), *(np.array(table.column(x).to_pylist(), np.int64).view(np.uint64) for x in ("low", "bands")),
            shingle_sets(column(table, "text"), shingle), None if i == j else own == i, most, percent,
        )
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    # a task returns fewer links than it has rows
    more = checkpointed(gathered(tasks.groupBy("task").applyInArrow(compare, "a long, b long"), n_tasked))
    if not more.isEmpty():
        groups = components(links.union(more))
    named = classes.select("cls", "id", "first").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.min("first").getField("row").alias("first_row"))
    named = named.join(least, "component").select("cls", "component_id", "first_row")
    out = signed.select("id", "n", "row", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    named_id = F.coalesce("component_id", "id")
    kept = F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)) if row_col else F.col("id").eqNullSafe(named_id)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), named_id.alias("component_id"), kept.alias("kept"), *([F.col("row").alias(row_col)] if row_col else []))


def _split(batch: pa.RecordBatch, *text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded length of text (or one row) and a bounded number of rows each."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for k in text:
        size += np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(size) // PART_BYTES + np.arange(batch.num_rows) // PART_ROWS
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _joining(band: int, cls: np.ndarray, component: np.ndarray, n: np.ndarray, low: np.ndarray, bands: np.ndarray, sets: tuple[np.ndarray, np.ndarray], side: np.ndarray | None, most: int, percent: int) -> list[tuple[int, int]]:
    """Links between classes of one bucket that join components.

    side: for a task of two blocks, which rows are of the first; pairs within
    a block are another task's. A pair whose classes share an earlier band is
    left to that band's bucket.
    """
    grams, bound = sets
    values, gram = np.unique(grams, return_inverse=True)
    names, group = np.unique(component, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    largest = np.bincount(group).argmax()
    rest = np.flatnonzero(group != largest)
    rank = np.full(len(cls), len(cls))
    rank[rest] = np.arange(len(rest))
    found, mark = [], np.zeros(len(values), bool)
    for x in rest.tolist():
        able = (rank > rank[x]) & (group != group[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent)
        if side is not None:
            able &= side != side[x]
        y = np.flatnonzero(able)
        apart = low[y] ^ low[x]
        apart = np.bitwise_count((apart | (apart >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
        near = (apart <= most) & ~(bands[y, :band] == bands[x, :band]).any(1)
        y = y[near][np.argsort(apart[near], kind="stable")]
        if not len(y):
            continue
        own = gram[bound[x] : bound[x + 1]]
        mark[own] = True
        for k in y.tolist():
            a, b = root(int(group[x])), root(int(group[k]))
            if a != b:
                both = int(np.count_nonzero(mark[gram[bound[k] : bound[k + 1]]]))
                if 100 * both >= percent * (int(n[x]) + int(n[k]) - both):
                    parent[a] = b
                    found.append((int(cls[x]), int(cls[k])))
        mark[own] = False
    return found
