"""Token ids as Parquet list columns: a corpus encoded, laid out in id order, and read back selectively.

Files are ranges of ``doc_id``.  Within a file documents ascend; ids are a list
column with dictionary encoding (a vocabulary is small beside a row group), the
long columns are delta-encoded (version-2 pages), row groups have a set size,
and page indexes let a reader skip pages of unwanted documents.  Metadata
(``doc_id``, ``n_tokens``, ``part``, ``start_in_part``) are columns of their
own, so counting tokens never reads ids.

A file's own running count is written with its rows; the ids of all files before
it come from a sum per file, so no task ever sees more than one file.

Edge cases: a null text is an empty one and has only the end id; null ids come
first; rows that repeat an id are documents each, in order of their texts' hash; very long texts are one row; an empty
table writes no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, sliced, small

SCHEMA = "part int, doc_id long, n_tokens long, start_in_part long, ids array<int>"
META = "part int, doc_id long, n_tokens long, start_in_part long"
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10


def encode(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Documents in id order, a partition per file, with their ids; ``SCHEMA``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokenize import encoder

        enc, part, so_far = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            ids = [enc.encode(t) + end for t in b.column("text").to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            edges = np.concatenate([[0], np.cumsum(n)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), b.column("doc_id"), pa.array(n), pa.array(so_far + edges[:-1]), lists],
                ["part", "doc_id", "n_tokens", "start_in_part", "ids"],
            )
            so_far += int(edges[-1])

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", "_tie") if parts else rows.repartitionByRange("doc_id", "_tie")
    return ranged.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(tokens: DataFrame, path: str, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """The file format: see the module's head."""
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.block.size", str(row_group))
        .option("parquet.page.size", str(page))
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .parquet(path)
    )


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, n_tokens, start_in_part, start) without reading ids; ``start`` counts all ids of documents before."""
    meta = spark.read.schema(META).parquet(path)
    return meta.join(small(_before(meta)), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document with its ids and ``start``; filters on doc_id reach the pages through their indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    before = _before(spark.read.schema(META).parquet(path))
    return rows.join(small(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def _before(meta: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before a file; a row per file."""
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("before"))


def digests(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``ids`` replaced by ids_crc32: the checksum of the ids as little-endian unsigned 32-bit integers."""
    keep = [f for f in tokens.schema.fields if f.name != ids]

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in sliced(batches):
            lists = b.column(ids)
            values, edges = lists.values.to_numpy(zero_copy_only=False).view("<u4"), lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(values[i:j]) for i, j in zip(edges[:-1], edges[1:])), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(crc)], [*[f.name for f in keep], "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", ids_crc32 long"
    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None, path: str | None = None) -> DataFrame:
    """Encode, write, and read back: (doc_id, start, n_tokens, ids) from the files."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write(encode(docs, tokenizer, end_id, parts), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")
