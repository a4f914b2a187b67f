"""Chunk and URL tables beside the memories: replaced, listed and deleted by memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import scans, vector


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks with those of the new ones' memories in place of their old ones."""
    return chunks.join(new.select("memory_id").distinct(), "memory_id", "left_anti").select(*chunks.columns).unionByName(new, allowMissingColumns=True)


def list_chunks(chunks: DataFrame, memory_id: int) -> DataFrame:
    return chunks.where(F.col("memory_id") == memory_id).orderBy("chunk_idx")


def delete_of(rows: DataFrame, memories: DataFrame) -> DataFrame:
    """Chunks or URLs without those of the given memories (memory_id)."""
    return rows.join(memories.select("memory_id").distinct(), "memory_id", "left_anti").select(*rows.columns)


def memory_urls(memories: DataFrame) -> DataFrame:
    """(memory_id, url, start): each URL of a body once, at its first byte offset."""
    found = memories.select(F.col("id").alias("memory_id"), F.explode(X.extract_urls(F.col("body"))).alias("u"))
    return found.groupBy("memory_id", F.col("u.url").alias("url")).agg(F.min("u.start").cast("bigint").alias("start"))


def upsert_urls(urls: DataFrame, new: DataFrame) -> DataFrame:
    """New (memory_id, url) rows are added; known ones stay."""
    return urls.unionByName(new.join(urls, ["memory_id", "url"], "left_anti").select(*urls.columns))


def missing_chunk_vectors(chunks: DataFrame, memories: DataFrame, vectors: DataFrame, dim: int, namespace: str | None = None) -> DataFrame:
    """(item_key): chunks without a vector of the width; with a namespace only those of its live memories, without one also those whose memory is gone."""
    own = chunks
    if namespace is not None:
        own = chunks.join(scans.live(scans.in_namespace(memories, namespace)).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    lack = own.join(vector.of_width(vectors, dim).select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return lack.select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("item_key"))
