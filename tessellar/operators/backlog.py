"""Enrichment backlogs: what is missing, as anti- and semi-joins that yield work keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import graph, maintain, scans, vector
from tessellar.storage import snapshot


def unbound_memories(memories: DataFrame, bridge: DataFrame) -> DataFrame:
    """Live memories without an entity."""
    return scans.live(memories).join(bridge.select(F.col("memory_id").alias("id")), "id", "left_anti")


def bound_memories(memories: DataFrame, bridge: DataFrame, names: DataFrame) -> DataFrame:
    """Live memories of a name list that have an entity."""
    return scans.live(memories).join(names.select("name").distinct(), "name", "left_semi").join(bridge.select(F.col("memory_id").alias("id")), "id", "left_semi")


def undescribed_entities(entities: DataFrame, force: bool = False) -> DataFrame:
    d = F.col("description")
    return entities.where((X.null_description(d) | X.low_quality(d)) if force else X.null_description(d))


def short_bodies(memories: DataFrame, n: int = 500) -> DataFrame:
    return scans.live(memories).where(X.short_body(F.col("body"), n))


def reembed(memories: DataFrame, memory_vectors: DataFrame, entities: DataFrame, entity_vectors: DataFrame, dim: int, chunks: DataFrame | None = None, chunk_vectors: DataFrame | None = None) -> DataFrame:
    """(target, item_key): memories by name, entities and chunks by prefixed key, that lack a vector of the width.

    Chunks count even where their memory is gone or deleted.
    """
    m = vector.missing(memory_vectors, memories, dim).select(F.lit("memory").alias("target"), F.col("name").alias("item_key"))
    e = entities.join(vector.of_width(entity_vectors, dim).select(F.col("entity_id").alias("id")), "id", "left_anti").select(F.lit("entity").alias("target"), F.concat(F.lit("entity:"), "name").alias("item_key"))
    out = m.unionByName(e)
    if chunks is not None:
        c = chunks if chunk_vectors is None else chunks.join(vector.of_width(chunk_vectors, dim).select(F.col("chunk_id").alias("id")), "id", "left_anti")
        out = out.unionByName(c.select(F.lit("chunk").alias("target"), F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("item_key")))
    return out


def heavy_edges(edges: DataFrame, entities: DataFrame, least: float = 0.7) -> DataFrame:
    """Named edges strong enough to calibrate, heaviest first."""
    return _named(edges.where(F.col("weight") >= least), entities).orderBy(F.desc("weight"), "source_id", "target_id", "relation")


def generic_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return _named(edges.where(F.col("relation") == "applies_to"), entities).orderBy("source_id", "target_id")


def _named(edges: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select("id", "name")
    return (
        edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
        .join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id")
        .select("source_id", "target_id", "source_name", "target_name", "relation", "weight")
    )


def hash_sample(df: DataFrame, n: int) -> DataFrame:
    """A sample that is the same on every run: by a multiplicative hash of the id."""
    return df.orderBy((F.col("id") * F.lit(2654435761)) % F.lit(2147483647), "id").limit(n)


def generic_descriptions(memories: DataFrame, n: int) -> DataFrame:
    return hash_sample(scans.live(memories).where(X.generic_description(F.col("description"))), n)


def memory_names(memories: DataFrame) -> DataFrame:
    """Every live memory: the scan of classification, audit, synthesis and extraction."""
    return scans.live(memories).select("id", "namespace", "name")


def entity_pairs(entities: DataFrame, edges: DataFrame, bridge: DataFrame, most: int = 50) -> DataFrame:
    """(item_key): isolated pairs to connect."""
    return graph.isolated_pairs(entities, edges, bridge, most).select(X.pair_key(F.col("a"), F.col("b")).alias("item_key"))


def without_skipped(keys: DataFrame, queue: DataFrame, operation: str) -> DataFrame:
    """Work keys (item_key) without those that were skipped for the operation already."""
    skipped = queue.where((F.col("operation") == operation) & (F.col("status") == "skipped")).select("item_key")
    return keys.join(skipped, "item_key", "left_anti")


def counts(**scans_: DataFrame) -> DataFrame:
    """(operation, backlog) of named scans."""
    out = None
    for name, df in scans_.items():
        one = df.agg(F.count(F.lit(1)).alias("backlog")).select(F.lit(name).alias("operation"), "backlog")
        out = one if out is None else out.unionByName(one)
    return out


def all_counts(namespace: str, memories: DataFrame, bridge: DataFrame, memory_vectors: DataFrame, entities: DataFrame, entity_vectors: DataFrame, edges: DataFrame, dim: int, force: bool = False) -> DataFrame:
    """(operation, backlog) of every operation in a namespace, by the scans that yield its work."""
    m, e, r = (df.where(F.col("namespace") == namespace) for df in (memories, entities, edges))
    described = e if "description" in e.columns else e.withColumn("description", F.lit(None).cast("string"))
    alone = graph.shared_memories(bridge.join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")).join(edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")), ["a", "b"], "left_anti")
    live = scans.live(m)
    return counts(
        MemoryBindings=unbound_memories(m, bridge),
        EntityDescriptions=undescribed_entities(described, force),
        BodyEnrich=short_bodies(m),
        ReEmbed=reembed(m, memory_vectors, e, entity_vectors, dim),
        WeightCalibrate=heavy_edges(r, entities),
        RelationReclassify=generic_edges(r, entities),
        EntityConnect=alone,
        EntityTypeValidate=e,
        DescriptionEnrich=live.where(X.generic_description(F.col("description"))),
        BodyExtract=live,
    )


def quality_estimate(entities: DataFrame, bridge: DataFrame, memories: DataFrame, sample: int = 100, snippets: int = 5, threshold: float = 0.12) -> DataFrame:
    """One row: over a sample of described entities, how many are grounded in their recent memories, the mean coverage, and half of each as quality."""
    from pyspark.sql import Window

    chosen = hash_sample(entities.where(~X.null_description(F.col("description"))), sample)
    w = Window.partitionBy("entity_id").orderBy(F.desc("updated_at"), F.desc("memory_id"))
    own = bridge.join(chosen.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(scans.live(memories).select(F.col("id").alias("memory_id"), "body", F.coalesce("updated_at", "created_at").alias("updated_at")), "memory_id")
    top = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= snippets).groupBy("entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "body"))), lambda s: s["body"]), "\n").alias("evidence"))
    met = chosen.join(top, chosen["id"] == top["entity_id"], "left")
    d, e = F.col("description"), F.coalesce("evidence", F.lit(""))
    scored = met.select(X.grounded(d, e, threshold).cast("double").alias("ok"), F.when(F.length(e) < 40, 1.0).otherwise(X.grounding_coverage(d, F.trim(e))).alias("score"))
    return scored.agg(F.count(F.lit(1)).alias("sampled"), F.round(F.avg("ok"), 6).alias("accept_rate"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn("quality", F.round(F.col("accept_rate") * 0.5 + F.col("mean_score") * 0.5, 6))


def write_back(results: DataFrame, memories: DataFrame, versions: DataFrame, entities: DataFrame, vectors: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories, versions, entities, vectors) after results (seq, operation, item_id, text, embedding) of enrichment.

    One written set of what holds, the last result of each item, is split into keyed merges: ``EntityDescriptions`` replace
    descriptions, ``BodyEnrich`` replaces bodies, each a version more, and ``ReEmbed`` or a body's own embedding replaces
    a vector; of two vectors the later one.  Results of items that are not there, or deleted, change nothing.
    """
    last = results.groupBy("operation", "item_id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("text", "embedding"), "seq").alias("r"))
    held = snapshot(last.select("seq", "operation", F.col("item_id").alias("id"), "r.text", "r.embedding"), "results")
    time = F.lit(at).cast("bigint")
    described = held.where("operation = 'EntityDescriptions'").join(entities.select("id"), "id", "left_semi").select("id", F.col("text").alias("description"))
    described = described.withColumn("updated_at", time) if "updated_at" in entities.columns else described
    own = held.where("operation in ('BodyEnrich', 'ReEmbed')").join(scans.live(memories).select("id"), "id", "left_semi")
    bodies = own.where("operation = 'BodyEnrich'").select("id", F.col("text").alias("body"), time.alias("updated_at"))
    after = maintain.merge_by_key(memories, bodies, ["id"])
    logged = maintain.append_versions(versions, after.join(bodies.select("id"), "id", "left_semi"), "edit", at)
    fresh = own.where("embedding is not null").groupBy(F.col("id").alias("memory_id")).agg(F.max_by("embedding", "seq").alias("embedding"))
    return after, logged, maintain.merge_by_key(entities, described, ["id"]), vector.upsert(vectors, fresh, "memory_id")


#: The order in which operations run: gates first.
FIRST, LAST = ["MemoryBindings", "EntityDescriptions"], ["ReEmbed", "EntityConnect"]


def ordered_operations(names: list[str]) -> list[str]:
    def place(n: str) -> int:
        return FIRST.index(n) if n in FIRST else len(FIRST) + (1 + LAST.index(n) if n in LAST else 0)

    return sorted(names, key=place)
