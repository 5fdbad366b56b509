"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector is rotated by a seeded random orthogonal matrix and kept as the
signs of its coordinates, together with the inner product f of the vector and
its sign code. For another rotated vector q, <code, q> / f estimates the inner
product without bias, and its error stays below
EPSILON * sqrt((1 - f*f) / (f*f * (d - 1))) with a confidence that EPSILON
sets. A pair is recomputed in double precision if the bound lets it reach the
threshold; all others are left out.

Candidates come from cells: CELLS_OF nearest of a set of centres that lie
apart, sampled by hash. Their number grows with the vectors, then with the root
of their number, and is bounded by MOST_BYTES, as they are broadcast. Every
vector is indexed; equal vectors are one row
with a weight. A large cell is cut into blocks, and each pair of blocks is a
task, which returns weighted link counts for its vectors and the links that
join components, never its pairs. A pair in several common cells is counted in
the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import checkpointed, components

#: Vectors for each centre; centres from which on their number grows with ROOT times the root of the number of vectors; bytes of centres, which are broadcast.
PER_CENTRE, MANY_CENTRES, ROOT, MOST_BYTES = 128, 65_536, 8, 1 << 30
#: Centres are no nearer to each other than this cosine.
CENTRES_APART = 0.7
#: Cells that each vector is put in.
CELLS_OF = 8
#: Confidence of the error bound, in standard units.
EPSILON = 4.0
#: Vectors in a block of a cell.
BLOCK = 2048
#: Cells whose numbers of blocks are broadcast; there are as many as centres, for each length of vectors.
BROADCAST_CELLS = 1_000_000
_TILE = 512


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal d x d matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes (packed bits), correction factors, and the rotated vectors of unit rows."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1]), turned


def bounds(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded rows with rotated rows, and each coded row's error bound."""
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    estimate = (signs @ turned.astype(np.float32).T) / np.float32(np.sqrt(d)) / factor[:, None].astype(np.float32)
    return estimate, EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(1, d - 1)))


def usable(vector: Column) -> Column:
    """Whether a vector can be linked: no null or non-finite component, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """A list column whose rows are of one length, as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centre_count(n: int, d: int) -> int:
    """How many centres are sampled for n vectors of up to d components."""
    return max(8, min(n // PER_CENTRE, max(MANY_CENTRES, ROOT * math.isqrt(n)), MOST_BYTES // (4 * max(1, d))))


def _centres(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, sampled centres that lie apart. The sample is bounded (centre_count), whatever the number of vectors."""
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    rows = classes.select("vector").orderBy(F.xxhash64("cls"), "cls").limit(centre_count(size["n"], size["d"] or 1)).toArrow()
    vectors = rows.column("vector").combine_chunks()
    vectors = vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    return {d: _apart(_units(vectors.filter(pa.array(lengths == d))).astype(np.float32)) for d in np.unique(lengths).tolist()}


def _apart(unit: np.ndarray) -> np.ndarray:
    """Of unit rows, those that lie apart from all rows kept before them; worked out a tile of rows at a time."""
    held, n = np.empty_like(unit), 0
    for k in range(0, len(unit), _TILE):
        tile = unit[k : k + _TILE]
        free = np.ones(len(tile), bool)
        for j in range(0, n, 16 * _TILE):
            free &= (tile @ held[j : min(n, j + 16 * _TILE)].T).max(1) < CENTRES_APART
        near = tile @ tile.T >= CENTRES_APART
        for i in np.flatnonzero(free).tolist():
            if free[i]:
                held[n] = tile[i]
                n += 1
                free &= ~near[i]
    return held[:n].copy()


def embedding_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Link vectors of cosine >= threshold: (id, n_links long, component_id, kept boolean), a row for each row in.

    Null and zero vectors and those with null or non-finite components link
    with nothing; so do vectors of different lengths. Equal vectors always
    link. A null id is linked and counted, but names a component only if all
    ids in it are null. Rows of one id are rows of their own. An empty table
    gives an empty one. Other columns of df are not read. Steps are eager and
    write to the shared checkpoint folder.
    """
    vector = F.col(vector_col).cast("array<double>")
    # -0.0 is 0.0
    vector = F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = df.select(F.col(id_col).alias("id"), F.when(usable(vector), vector).alias("vector")).withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = checkpointed(classes)
    sent = df.sparkSession.sparkContext.broadcast(_centres(classes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                unit = _units(part.column(2)).astype(np.float32)
                middle = centres.get(d, unit[:0])
                if len(middle) <= CELLS_OF:
                    near = np.tile(np.arange(max(1, len(middle))), (len(unit), 1))[:, :1] if len(middle) < 2 else np.tile(np.arange(len(middle)), (len(unit), 1))
                else:
                    near = np.concatenate([np.argpartition(-(unit[k : k + 1024] @ middle.T), CELLS_OF, axis=1)[:, :CELLS_OF] for k in range(0, len(unit), 1024)])
                near = np.sort(near, 1).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), cells, pa.array(np.full(len(unit), d), pa.int32())], names=["cls", "weight", "vector", "cells", "d"])

    # cells are found once, whatever reads them
    placed = checkpointed(classes.select("cls", "weight", "vector").mapInArrow(assign, "cls long, weight long, vector array<double>, cells array<int>, d int"))
    placed = placed.withColumn("cell", F.explode("cells"))
    size = checkpointed(placed.groupBy("d", "cell").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("blocks")))
    placed = placed.join(F.broadcast(size) if size.count() <= BROADCAST_CELLS else size, ["d", "cell"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # one column names a task, as rows that lie together by cell alone would put all tasks of a cell in one
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("d"), F.col("cell"), F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    tasks = placed.select("cls", "weight", "vector", "cells", "own", F.explode(pair).alias("task"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        task = table.column("task")[0].as_py()
        i, j, cell = task["i"], task["j"], task["cell"]
        cls, weight, own = (table.column(c).to_numpy() for c in ("cls", "weight", "own"))
        cells = table.column("cells").chunk(0).flatten().to_numpy().reshape(len(cls), -1)
        counts, joins = _block(cell, cls, weight, _units(table.column("vector").chunk(0)), cells, None if i == j else own == i, threshold)
        linked = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array([*cls[linked].tolist(), *(int(cls[x]) for x, _ in joins)], pa.int64()),
            "b": pa.array([None] * len(linked) + [int(cls[y]) for _, y in joins], pa.int64()),
            "n": pa.array([*counts[linked].tolist(), *[None] * len(joins)], pa.int64()),
        })

    found = checkpointed(tasks.groupBy("task").applyInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null"))
    named = classes.select("cls", "id", "weight").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = rows.select("id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _block(cell: int, cls: np.ndarray, weight: np.ndarray, unit: np.ndarray, cells: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of the vectors of a task, and links that span its components.

    side: for a task of two blocks, which rows are of the first; pairs within a block are another task's.
    """
    codes, factor, turned = encode(unit)
    counts, joins, parent = np.zeros(len(cls), np.int64), [], np.arange(len(cls))
    left = np.arange(len(cls)) if side is None else np.flatnonzero(side)
    right = left if side is None else np.flatnonzero(~side)
    for k in range(0, len(left), _TILE):
        x = left[k : k + _TILE]
        y = right[k:] if side is None else right
        estimate, error = bounds(codes[x], factor[x], turned[y])
        p, q = np.nonzero(estimate + error[:, None] >= threshold)
        p, q = x[p], y[q]
        if side is None:
            p, q = p[p < q], q[p < q]
        for s in range(0, len(p), 1 << 18):
            a, b = p[s : s + (1 << 18)], q[s : s + (1 << 18)]
            linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[linked], b[linked]
            # the first common cell counts the pair
            common = (cells[a][:, :, None] == cells[b][:, None, :]).any(2)
            first = cells[a, common.argmax(1)] == cell
            a, b = a[first], b[first]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            _span(parent, a, b, joins)
    return counts, joins


def _span(parent: np.ndarray, a: np.ndarray, b: np.ndarray, joins: list[tuple[int, int]]) -> None:
    """Add to joins the links of a and b that join sets of parent."""

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    apart = np.flatnonzero(parent[a] != parent[b])
    for k in apart.tolist():
        u, v = root(int(a[k])), root(int(b[k]))
        if u != v:
            parent[u] = v
            joins.append((int(a[k]), int(b[k])))
