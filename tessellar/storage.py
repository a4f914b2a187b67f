"""Snapshots: a written table stands for a commit, and cuts the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, name: str = "snapshot", path: str | None = None) -> DataFrame:
    """Write and read back: what follows survives lost executors and recomputes nothing."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table that is dealt anew at most.
SPREAD = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A table as read, for costly work row by row: dealt over all cores where its files give fewer partitions than there are.

    Tables that may be larger than ``SPREAD`` by their partitions stay as they are: a shuffle of whole texts would cost more than it gains.
    """
    n, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(n) if parts < n and parts * _split_bytes(df.sparkSession) <= SPREAD else df


def _split_bytes(spark: SparkSession) -> int:
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(size[-1:], 0)
    return int(size[:-1] if unit else size) << unit
