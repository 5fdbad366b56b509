"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where lineage is cut in local mode if the session names no folder.
LOCAL_CHECKPOINTS = "/tmp/cueforge-checkpoints"
#: Narrow rows that one task takes before they are worth a second.
NARROW_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or in local mode one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder or spark.sparkContext.master.startswith("local"):
        return folder or LOCAL_CHECKPOINTS
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut df's lineage with a reliable checkpoint in the folder the cluster names.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset in local mode (a test session) is one set here. The files are
    shared, so a lost executor costs nothing.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df, whose last step goes through at most that many narrow rows, in as many parts as so many are worth, whatever the shuffle's number.

    Each part is a file of a checkpoint. Where Hadoop has no native library, the
    local file system starts two processes for a file, as copies of the executor.
    """
    return df.coalesce(_parts(rows))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most that many narrow rows that are much work, dealt once more into as many parts as the rows are worth."""
    return df.repartition(_parts(rows))


def _parts(rows: int) -> int:
    return max(1, -(-rows // NARROW_ROWS))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """The bytes of a column's texts, added up by one job that reads that column; estimates go by types' widths and stored sizes."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0)


def chunk_of(n_chunks: int, *columns: str) -> Column:
    """A chunk number from the row's own values: the same in every pass over the table.

    The text is hashed too, so that one id (or null) on many rows spreads.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(n_chunks)).cast("int")


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each
    round is two aggregations by node over the edges, both partially combined,
    and the number of rounds grows with the logarithm of the longest path. A
    node with many neighbours is only ever min-aggregated and joined, never
    collected. Each round's edges go to the shared checkpoint folder.

    Null ends are dropped; loops are ignored; nodes without an edge to another
    node are absent from the result; an empty edge list gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(narrow(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), e.count()))
    n, total = _signature(e)
    while n:
        # large star: a node's larger neighbours are tied to the least of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        small = small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        # two for each edge of the large star, which has two for each edge at most
        e = checkpointed(narrow(small, 4 * n))
        now = _signature(e)
        if now == (n, total):
            break
        n, total = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return int(row["n"]), int(row["s"])


def fresh_name(prefix: str) -> str:
    """A column name that no input column has."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
