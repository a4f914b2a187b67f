"""Incremental ingest: a folder of NDJSON files as a stream, each batch staged, decided and kept as what it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellar import schema
from tessellar.operators import ingest, maintain
from tessellar.sources import files


def batch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """NDJSON lines that arrive in a folder."""
    return spark.readStream.schema(schema.BATCH_LINE).json(folder)


def into(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``merge`` with its number; a number seen again is the same batch, so a merge keyed by it is exactly once."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The tables that batches of lines change, with the columns kept of each and its key; a table without one only grows.
STATE = {
    "memories": ("id bigint, namespace string, name string, type string, description string, body string, created_at bigint, updated_at bigint, deleted_at bigint", ["id"]),
    "versions": ("memory_id bigint, version bigint, name string, body string, change_reason string, created_at bigint", None),
    "chunks": ("memory_id bigint, chunk_idx int, chunk_text string, start_offset int, end_offset int, token_count int", None),
    "urls": ("memory_id bigint, url string, start bigint", None),
    "entities": ("id bigint, namespace string, name string, type string, description string", ["id"]),
    "relationships": ("id bigint, namespace string, source_id bigint, target_id bigint, relation string, weight double", ["id"]),
    "bridge": ("memory_id bigint, entity_id bigint", None),
}
OUTCOMES = "place bigint, file_path string, name string, status string, action string, reason string, memory_id bigint"


class Store:
    """Tables as the changes of numbered batches, in folders ``table/batch=n``.

    A batch reads what the batches before it left and writes only its own folders, over what an ended attempt left there,
    so a batch that runs again changes nothing twice, and no batch rewrites a table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self, name: str, ddl: str, before: int | None) -> DataFrame:
        # The schema is given, so a table without a batch is empty.
        self.spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{self.root}/{name}/batch=-1")
        rows = self.spark.read.schema(f"{ddl}, batch bigint").parquet(f"{self.root}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table as the batches before one left it, or all."""
        ddl, key = STATE[name]
        rows = self._rows(name, ddl, before)
        if key is not None:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))).where("_n = 1").drop("_n")
        elif name == "chunks":
            # A memory's chunks are those of its last write.
            last = self._rows("memories", STATE["memories"][0], before).groupBy(F.col("id").alias("memory_id")).agg(F.max("batch").alias("batch"))
            rows = rows.join(last, ["memory_id", "batch"], "left_semi")
        elif name == "bridge":
            return rows.select("memory_id", "entity_id").distinct()
        return rows.drop("batch")

    def tables(self, before: int | None = None) -> ingest.Tables:
        return ingest.Tables(**{name: self.table(name, before) for name in STATE})

    def outcomes(self) -> DataFrame:
        """(batch, place, file_path, name, status, action, reason, memory_id) of every line."""
        return self._rows("outcomes", OUTCOMES, None).where("batch >= 0")

    def tally(self) -> DataFrame:
        """(status, action, n) over all batches."""
        return self.outcomes().groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))

    def _write(self, name: str, ddl: str, rows: DataFrame, batch: int) -> None:
        shaped = self.spark.createDataFrame([], ddl).unionByName(rows, allowMissingColumns=True)
        shaped.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], ddl).schema.fields]).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def merge(self, namespace: str, at: Callable[[int], int], force: bool = False, whole: bool = False) -> Callable[[DataFrame, int], None]:
        """What ``into`` calls with each batch of lines (value, file_path, file_block_start); ``at`` gives a batch's time, the same in each attempt."""

        def one(lines: DataFrame, batch: int) -> None:
            old = self.tables(before=batch)
            placed = maintain.numbered(lines.where(F.trim("value") != "").withColumn("_in", F.monotonically_increasing_id()), ["file_path", "file_block_start", "_in"], "line")
            staged = ingest.stage_lines(files.parsed_lines(placed)).join(placed.select(F.col("line").alias("place"), "file_path"), "place")
            outcomes = ingest.decide(staged, old.memories, namespace, force, lines=True, whole=whole)
            new = ingest.changes(outcomes, old, namespace, at(batch))
            for name, (ddl, _) in STATE.items():
                self._write(name, ddl, getattr(new, name), batch)
            self._write("outcomes", OUTCOMES, outcomes, batch)

        return one


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw lines that arrive in a folder, with the file and block of each, for ``Store.merge``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select("value", "_metadata.file_path", "_metadata.file_block_start")
