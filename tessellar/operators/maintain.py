"""Writes and maintenance: each takes snapshots and returns new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import graph, scans
from tessellar.storage import snapshot


def merge_by_key(base: DataFrame, new: DataFrame, keys: list[str], replace: list[str] | None = None, keep_old: list[str] = (), flag: str | None = None) -> DataFrame:
    """An upsert: rows of ``new`` insert, or replace columns of the base row with their key.

    ``keep_old`` columns take the new value only where it is not null.  With ``flag`` a column tells inserted, updated or unchanged.
    """
    cols = base.columns
    replace = replace if replace is not None else [c for c in new.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    b = base.withColumn("_old", F.lit(True))
    met = b.join(n, keys, "full_outer")
    isnew = F.coalesce("_new", F.lit(False))

    def value(c: str) -> Column:
        if c in keys or f"_n_{c}" not in met.columns:
            return F.col(c)
        fresh = F.col(f"_n_{c}")
        if c in keep_old:
            return F.when(isnew, F.coalesce(fresh, F.col(c))).otherwise(F.col(c))
        if c in replace:
            return F.when(isnew, fresh).otherwise(F.col(c))
        return F.coalesce(c, fresh)

    out = [value(c).alias(c) for c in cols]
    if flag:
        out.append(F.when(~isnew, "unchanged").when(F.col("_old").isNull(), "inserted").otherwise("updated").alias(flag))
    return met.select(*out)


def append_versions(versions: DataFrame, memories: DataFrame, reason: str | Column, at: int) -> DataFrame:
    """The version log with one more row for each given memory; the reason may be a column of theirs."""
    top = versions.groupBy("memory_id").agg(F.max("version").alias("_top"))
    reason = F.lit(reason) if isinstance(reason, str) else reason
    new = memories.select(F.col("id").alias("memory_id"), "name", "body", reason.alias("change_reason")).join(top, "memory_id", "left")
    row = new.select("memory_id", (F.coalesce("_top", F.lit(0)) + 1).cast(versions.schema["version"].dataType).alias("version"), "name", "body", "change_reason", F.lit(at).cast("bigint").alias("created_at"))
    return versions.unionByName(row, allowMissingColumns=True)


def numbered(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with their place (from 1) in the order: ranges are counted apart, so no task sees more than its own."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    laid = snapshot(parts.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    # A row per partition.
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def remember(memories: DataFrame, versions: DataFrame, new: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Insert or force-merge memories (namespace, name, ...), and log a version of each: (memories, versions).

    New ids follow the largest, in order of namespace and name; a new memory's version is a create, a known one's an edit.
    """
    known = memories.select("namespace", "name", F.col("id").alias("_id"))
    rows = new.join(known, ["namespace", "name"], "left")
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(rows.where("_id is null"), ["namespace", "name"], "_n").crossJoin(F.broadcast(top)).withColumn("_id", F.col("_top") + F.col("_n")).drop("_top", "_n").withColumn("_reason", F.lit("create"))
    both = fresh.unionByName(rows.where("_id is not null").withColumn("_reason", F.lit("edit"))).withColumnRenamed("_id", "id")
    both = both.withColumns({"updated_at": F.lit(at).cast("bigint"), "deleted_at": F.lit(None).cast("bigint")})
    merged = merge_by_key(memories, both.drop("_reason").withColumn("created_at", F.lit(at).cast("bigint")), ["namespace", "name"], replace=[c for c in both.columns if c not in ("namespace", "name", "id", "created_at", "_reason")])
    return merged, append_versions(versions, both, F.col("_reason"), at)


def forget(memories: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Soft deletion of live memories."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    gone = F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(at).cast("bigint")).otherwise(F.col("deleted_at"))
    return memories.join(hit, "id", "left").withColumn("deleted_at", gone).select(*memories.columns)


def restore(memories: DataFrame, versions: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Bodies of the latest versions that are no restore, and the deletion cleared."""
    last = scans.latest_bodies(versions).select(F.col("memory_id").alias("id"), F.col("body").alias("_body")).join(ids.select("id").distinct(), "id", "left_semi")
    met = memories.join(last.withColumn("_hit", F.lit(True)), "id", "left")
    return met.withColumns(
        {"body": F.when(F.col("_hit"), F.col("_body")).otherwise(F.col("body")), "deleted_at": F.when(F.col("_hit"), F.lit(None).cast("bigint")).otherwise(F.col("deleted_at")), "updated_at": F.when(F.col("_hit"), F.lit(at).cast("bigint")).otherwise(F.col("updated_at"))}
    ).select(*memories.columns)


def purge(memories: DataFrame, now: int, days: int, *children: tuple[DataFrame, str]) -> tuple[DataFrame, list[DataFrame]]:
    """Hard deletion past retention: the memories left, and each child table without their rows."""
    gone = scans.purge_candidates(memories, now, days).select("id")
    kept = memories.join(gone, "id", "left_anti")
    return kept, [t.join(gone.withColumnRenamed("id", key), key, "left_anti") for t, key in children]


def edit(memories: DataFrame, id_: int, at: int, expected: int | None = None, **changes: str) -> DataFrame:
    """One memory's columns changed, if it is live and, where asked, still has the expected time."""
    hit = (F.col("id") == id_) & F.col("deleted_at").isNull()
    if expected is not None:
        hit = hit & (F.col("updated_at") == expected)
    new = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
    return memories.withColumns(new | {"updated_at": F.when(hit, F.lit(at).cast("bigint")).otherwise(F.col("updated_at"))})


def rename(memories: DataFrame, namespace: str, old: str, new: str, at: int) -> DataFrame:
    """A soft-deleted holder of the new name goes; a live one is an error of the caller's."""
    own = F.col("namespace") == namespace
    kept = memories.where(~(own & (F.col("name") == new) & F.col("deleted_at").isNotNull()))
    hit = own & (F.col("name") == old) & F.col("deleted_at").isNull()
    return kept.withColumns({"updated_at": F.when(hit, F.lit(at).cast("bigint")).otherwise(F.col("updated_at")), "name": F.when(hit, F.lit(new)).otherwise(F.col("name"))})


def split_body(memories: DataFrame, pieces: Column, at: int) -> tuple[DataFrame, DataFrame]:
    """Children (``-part-0`` on) of memories whose ``pieces`` are several, and (child, parent) edges that replace."""
    parts = memories.withColumn("_p", pieces).where(F.size("_p") > 1).select("id", "namespace", "name", "type", "description", F.posexplode("_p").alias("i", "body"), F.size("_p").alias("n"))
    child = F.concat("name", F.lit("-part-"), F.col("i").cast("string"))
    rows = parts.select("namespace", child.alias("name"), "type", X.partition_description(F.col("description"), F.col("i") + 1, F.col("n")).alias("description"), "body", F.lit(at).cast("bigint").alias("created_at"))
    edges = parts.select("namespace", child.alias("child"), F.col("name").alias("parent"), F.lit("replaces").alias("relation"))
    return rows, edges


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """By namespace and normalised name: the type is overwritten, a description only where given."""
    named = new.withColumn("name", X.normalize_entity_name(F.col("name")))
    return merge_by_key(entities, named, ["namespace", "name"], replace=["type"], keep_old=["description"])


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """By source, target and relation: the weight is overwritten, a description only where given."""
    fine = new.where((F.col("source_id") != F.col("target_id")) & F.col("weight").between(0.0, 1.0)).withColumn("relation", X.normalize_relation(F.col("relation")))
    return merge_by_key(edges, fine, ["source_id", "target_id", "relation"], replace=["weight"], keep_old=["description"])


def create_or_fetch_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges that do not exist yet are added; existing ones stay as they are."""
    return edges.unionByName(new.join(edges, ["source_id", "target_id", "relation"], "left_anti"), allowMissingColumns=True)


def unlink(edges: DataFrame, source: int | None = None, target: int | None = None, relation: str | None = None, entity: int | None = None) -> DataFrame:
    """Edges without one edge, all between two entities, or all of an entity."""
    if entity is not None:
        return edges.where((F.col("source_id") != entity) & (F.col("target_id") != entity))
    hit = (F.col("source_id") == source) & (F.col("target_id") == target)
    return edges.where(~(hit & (F.col("relation") == relation) if relation else hit))


def merge_entities(entities: DataFrame, edges: DataFrame, bridge: DataFrame, sources: list[int], target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources become the target: edges retargeted, loops and duplicates (the first by weight stays) gone, bridges retargeted."""

    def to(c: str) -> Column:
        return F.when(F.col(c).isin(sources), F.lit(target)).otherwise(F.col(c)).cast("bigint")

    moved = edges.withColumns({"source_id": to("source_id"), "target_id": to("target_id")}).where("source_id <> target_id")
    e = dedupe_edges(moved)
    b = bridge.select("memory_id", to("entity_id").alias("entity_id")).distinct()
    return entities.where(~F.col("id").isin(sources)), e, b


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and relation: that of the smallest id, or the heaviest where edges have none."""
    keys = ["source_id", "target_id", "relation"]
    rest = [c for c in edges.columns if c not in keys]
    order = [F.col("id")] if "id" in rest else [(-F.col("weight"))]
    one = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r"))
    return one.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in edges.columns])


def normalize_entities(entities: DataFrame) -> DataFrame:
    """(id, name, new_name, action, survivor): what normalising names would do; of colliding ones the smallest id survives."""
    named = entities.withColumn("new_name", X.normalize_entity_name(F.col("name")))
    low = named.groupBy("namespace", "new_name").agg(F.min("id").alias("survivor"))
    action = F.when(F.col("id") != F.col("survivor"), "merge").when(F.col("name") != F.col("new_name"), "rename").otherwise("keep")
    return named.join(low, ["namespace", "new_name"]).select("id", "name", "new_name", action.alias("action"), "survivor")


def normalized(entities: DataFrame, edges: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names normalised and colliding entities merged into the smallest id: (entities, edges, bridges), as ``normalize_entities`` says."""
    plan = snapshot(normalize_entities(entities), "plan")
    to = plan.select(F.col("id").alias("_from"), F.col("survivor").alias("_to"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(to, df[column] == to["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

    kept = entities.join(plan.where("action <> 'merge'").select("id", "new_name"), "id").withColumn("name", F.col("new_name")).select(*entities.columns)
    retargeted = moved(moved(edges, "source_id"), "target_id").where("source_id <> target_id").select(*edges.columns)
    return kept, dedupe_edges(retargeted), moved(bridge, "entity_id").select(*bridge.columns).distinct()


def reclassify(entities: DataFrame, kind_from: str | None, kind_to: str | None, names: list[str] | None = None, description: str | None = None) -> DataFrame:
    """Entities of a type, of some names or all take another type, a description, or both."""
    hit = F.lit(True)
    if kind_from:
        hit = hit & (F.col("type") == kind_from)
    if names:
        hit = hit & F.col("name").isin(names)
    new = {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (("type", kind_to), ("description", description)) if v is not None}
    return entities.withColumns(new)


def reclassify_relation(edges: DataFrame, entities: DataFrame, old: str, new: str, source_type: str | None = None, target_type: str | None = None) -> DataFrame:
    """Edges of a relation take another, optionally only between types; those that then exist already go."""
    # Only edges of the relation look for types, and only at the ends that are asked for: an end that very many edges share is no key of a join in vain.
    own = F.coalesce(F.col("relation") == old, F.lit(False))
    met, hit = edges.where(own), F.lit(True)
    for end, kind in (("source_id", source_type), ("target_id", target_type)):
        if kind:
            ids = entities.where(F.col("type") == kind).select(F.col("id").alias(end)).distinct()
            met = met.join(ids.withColumn(f"_{end}", F.lit(True)), end, "left")
            hit = hit & F.col(f"_{end}").isNotNull()
    changed = met.where(hit).withColumn("relation", F.lit(new)).select(*edges.columns)
    stay = edges.where(~own).unionByName(met.where(~hit).select(*edges.columns))
    return stay.unionByName(dedupe_edges(changed.join(stay, ["source_id", "target_id", "relation"], "left_anti").select(*edges.columns)))


def rename_entity(entities: DataFrame, id_: int, name: str) -> DataFrame:
    return entities.withColumn("name", F.when(F.col("id") == id_, X.normalize_entity_name(F.lit(name))).otherwise(F.col("name")))


def delete_entities(entities: DataFrame, edges: DataFrame, bridge: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities gone with their edges and bridges."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return entities.join(gone, "id", "left_anti"), e.select(*edges.columns), bridge.join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").select(*bridge.columns)


def prune_relation(edges: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """Edges without a relation, and the ids of the entities it touched."""
    hit = edges.where(F.col("relation") == relation)
    return edges.where(F.col("relation") != relation), graph.endpoints(hit).select("id").distinct()


def prune_links(bridge: DataFrame, entities: DataFrame, namespace: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bridge, removed) without the links of an entity, or of all of a namespace."""
    own = entities.where(F.col("namespace") == namespace)
    own = own if name is None else own.where(F.col("name") == name)
    ids = own.select(F.col("id").alias("entity_id"))
    return bridge.join(ids, "entity_id", "left_anti").select(*bridge.columns), bridge.join(ids, "entity_id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def cleanup_orphans(entities: DataFrame, edges: DataFrame, bridge: DataFrame) -> DataFrame:
    return entities.join(graph.orphans(entities, edges, bridge).select("id"), "id", "left_anti")


def link_memories(bridge: DataFrame, new: DataFrame) -> DataFrame:
    return bridge.unionByName(new.select(*bridge.columns)).distinct()


def unlink_memories(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    return bridge.join(gone, [c for c in gone.columns if c in bridge.columns], "left_anti")


def memory_entities(bridge: DataFrame, entities: DataFrame, memory_id: int) -> DataFrame:
    return entities.join(bridge.where(F.col("memory_id") == memory_id).select(F.col("entity_id").alias("id")), "id", "left_semi").orderBy("name")


def entity_memories(bridge: DataFrame, memories: DataFrame, entity_id: int) -> DataFrame:
    return scans.live(memories).join(bridge.where(F.col("entity_id") == entity_id).select(F.col("memory_id").alias("id")), "id", "left_semi").orderBy("name")
