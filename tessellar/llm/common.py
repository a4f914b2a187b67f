"""What the operators share: shared storage, words, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only where that is unset and Spark runs in one process, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL_ROOT.setdefault("root", tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores where its files give fewer partitions than there are; large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batches, rows: int = 256):
    """Arrow batches in slices of at most ``rows`` rows: what a task holds as Python objects stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast only if it is counted to have at most ``rows`` narrow rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unsized(df: DataFrame) -> DataFrame:
    """``df``, joined by sort and merge: for a side that grows with the input, whose size Spark takes from small files, before they are decoded and exploded."""
    return df.hint("merge")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node of its connected component.

    Alternating large-star and small-star rounds on the edge table; each round is
    a grouped minimum with partial aggregation, joined back: a hub's edges meet its one minimum in a join that
    Spark may split.  Stops when a round changes nothing; the rounds grow with the logarithm of a component's
    size, and if they do not suffice it raises an error.
    """
    e = stored(_oriented(edges.select("a", "b")), "cc")
    last = _digest(e)
    for _ in range(rounds):
        # Large star: a node's larger neighbours go to its smallest neighbour (or itself).
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = _oriented(large)
        # Small star: a node's smaller neighbours go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(low, "b")
        small = star.select(F.col("m").alias("a"), "b").unionByName(star.select(F.col("m").alias("a"), F.col("a").alias("b")))
        new = stored(_oriented(small), "cc")
        # A fixed point: every edge already leads to the smallest node of its star.
        e, before, last = new, last, _digest(new)
        if last == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (
        e.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node").unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    )


def _oriented(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _digest(e: DataFrame):
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)
