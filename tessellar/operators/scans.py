"""Scans, lookups, versions and overview aggregates of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as X


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def in_namespace(df: DataFrame, *names: str) -> DataFrame:
    """Rows of the namespaces; of all, if none is named."""
    return df.where(F.col("namespace").isin(*names)) if names else df


def of_type(df: DataFrame, kind: str | None) -> DataFrame:
    return df.where(F.col("type") == kind) if kind else df


def page(df: DataFrame, order: list[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """An ordered page; a negative limit is none."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit >= 0 else out


def list_memories(memories: DataFrame, namespace: str, kind: str | None = None, limit: int = 50, offset: int = 0, include_deleted: bool = False) -> DataFrame:
    """Newest first, ties by id."""
    rows = of_type(in_namespace(memories, namespace), kind)
    rows = rows if include_deleted else live(rows)
    chosen = rows.select("id", "name", "type", "description", F.substring("body", 1, 200).alias("snippet"), F.octet_length("body").cast("bigint").alias("body_length"), "updated_at", F.col("deleted_at").isNotNull().alias("is_deleted"))
    return page(chosen, [F.desc("updated_at"), F.col("id")], limit, offset)


def count_memories(memories: DataFrame, namespace: str, kind: str | None = None, include_deleted: bool = False) -> DataFrame:
    rows = of_type(in_namespace(memories, namespace), kind)
    return (rows if include_deleted else live(rows)).agg(F.count(F.lit(1)).alias("n"))


def keyset_page(df: DataFrame, after: int, limit: int) -> DataFrame:
    return df.where(F.col("id") > after).orderBy("id").limit(limit)


def by_name(memories: DataFrame, namespace: str, name: str) -> DataFrame:
    return live(memories).where((F.col("namespace") == namespace) & (F.col("name") == name))


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Live memories of the ids in column ``id``."""
    return live(memories).join(ids.select("id").distinct(), "id", "left_semi")


def picked(memories: DataFrame, ids: list) -> DataFrame:
    """Memories of a bounded list of ids, which reaches the scan as a filter."""
    return memories.where(F.col("id").isin(ids) if ids else F.lit(False))


def any_state(memories: DataFrame, namespace: str, name: str) -> DataFrame:
    own = memories.where((F.col("namespace") == namespace) & (F.col("name") == name))
    return own.select("id", F.col("deleted_at").isNotNull().alias("is_deleted"))


def with_current_version(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, name, updated_at, version): zero without versions."""
    top = versions.groupBy("memory_id").agg(F.max("version").alias("version"))
    return live(memories).join(top, F.col("id") == F.col("memory_id"), "left").select("id", "namespace", "name", "updated_at", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"))


def duplicate_bodies(memories: DataFrame) -> DataFrame:
    """(id, body_hash, first_id, copies) of live memories whose body another live one of the namespace has."""
    hashed = live(memories).select("id", "namespace", X.content_hash(F.col("body")).alias("body_hash"))
    groups = hashed.groupBy("namespace", "body_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(groups, ["namespace", "body_hash"]).select("id", "namespace", "body_hash", "first_id", "copies")


def history(versions: DataFrame, with_bodies: bool = True) -> DataFrame:
    """Versions with the bytes added and removed since the one before; without bodies every difference is zero."""
    w = Window.partitionBy("memory_id").orderBy("version")
    size = F.octet_length("body").cast("bigint") if with_bodies else F.lit(0).cast("bigint")
    sized = versions.withColumn("_size", size).withColumn("_before", F.lag("_size", 1, 0).over(w))
    diff = F.col("_size") - F.col("_before")
    return sized.select(
        "memory_id",
        F.col("version").cast("bigint").alias("version"),
        X.change_action(F.col("change_reason")).alias("action"),
        F.greatest(diff, F.lit(0)).alias("added"),
        F.greatest(-diff, F.lit(0)).alias("removed"),
        X.epoch_to_iso(F.col("created_at")).alias("created_at_iso"),
    )


def next_versions(versions: DataFrame) -> DataFrame:
    """(memory_id, next_version, latest_edit): the latest version that is no restore is null if all are."""
    return versions.groupBy("memory_id").agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("bigint").alias("next_version"),
        F.max(F.when(F.col("change_reason") != "restore", F.col("version"))).cast("bigint").alias("latest_edit"),
    )


def latest_bodies(versions: DataFrame) -> DataFrame:
    """(memory_id, version, body) of the latest version that is no restore."""
    best = versions.where("change_reason <> 'restore'").groupBy("memory_id").agg(F.max_by(F.struct("version", "body"), "version").alias("v"))
    return best.select("memory_id", F.col("v.version").cast("bigint").alias("version"), F.col("v.body").alias("body"))


def stats(memories: DataFrame, versions: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row of totals."""
    m = memories.agg(
        F.count_if(F.col("deleted_at").isNull()).alias("live"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_distinct("namespace").alias("namespaces"),
        F.round(F.coalesce(F.avg(F.when(F.col("deleted_at").isNull(), F.length("body"))), F.lit(0.0)), 6).alias("avg_body_len"),
    )
    one = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((versions, "versions"), (entities, "entities"), (relationships, "relationships"))]
    for x in one:
        # Each side is a single row.
        m = m.crossJoin(x)
    return m


def namespaces(memories: DataFrame) -> DataFrame:
    return memories.select("namespace").distinct().orderBy("namespace")


def type_histogram(memories: DataFrame) -> DataFrame:
    return live(memories).groupBy("namespace", "type").agg(F.count(F.lit(1)).alias("n"))


def purge_candidates(memories: DataFrame, now: int, days: int) -> DataFrame:
    """Soft-deleted at or before the cutoff."""
    return memories.where(F.col("deleted_at") <= now - days * 86400)


def deleted_before(memories: DataFrame, before: int) -> DataFrame:
    """Soft-deleted strictly before: unlike a purge."""
    return memories.where(F.col("deleted_at") < before)


def purge_metrics(memories: DataFrame, now: int, days: int) -> DataFrame:
    return purge_candidates(memories, now, days).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length("body") + F.length("description") + F.length("name")), F.lit(0)).cast("bigint").alias("chars"),
        F.min("deleted_at").alias("oldest"),
    )
