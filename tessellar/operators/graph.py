"""The entity graph: degrees, bounded walks, paths, and what they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.operators import scans
from tessellar.storage import snapshot


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, edge columns): an edge once per different endpoint, so a self-loop counts once."""
    return edges.withColumn("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of every entity with an edge."""
    return endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def entity_degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def list_entities(entities: DataFrame, edges: DataFrame, namespace: str | None = None, kind: str | None = None, sort: str = "degree", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entities with their live degree, ties by id."""
    own = scans.of_type(scans.in_namespace(entities, *([namespace] if namespace else [])), kind)
    rows = entity_degrees(own, edges).select("id", "namespace", "name", "type", "degree")
    return scans.page(rows, [F.desc(sort) if descending else F.asc(sort), F.col("id")], limit, offset)


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, the average degree 2E/N and the largest degree."""
    n = entities.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    top = degrees(edges).agg(F.coalesce(F.max("degree"), F.lit(0)).cast("bigint").alias("max_degree"))
    avg = F.when(F.col("nodes") == 0, 0.0).otherwise(F.round(2.0 * F.col("edges") / F.col("nodes"), 6))
    return n.crossJoin(e).crossJoin(top).withColumn("avg_degree", avg)


def super_hubs(entities: DataFrame, edges: DataFrame, above: int = 50, sample: int = 5) -> DataFrame:
    """(hubs, name, degree): the largest of the entities whose degree exceeds a bound, with their number."""
    hubs = degrees(edges).where(F.col("degree") > above).join(entities.select("id", "name"), "id")
    total = hubs.agg(F.count(F.lit(1)).alias("hubs"))
    return hubs.orderBy(F.desc("degree"), "id").limit(sample).crossJoin(total).select("hubs", "id", "name", "degree")


def relation_ratios(edges: DataFrame) -> DataFrame:
    """(relation, n, ratio): the relations by frequency, ties by name."""
    n = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    return n.crossJoin(total).select("relation", "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio")).orderBy(F.desc("n"), "relation")


def health(edges: DataFrame) -> DataFrame:
    """One row: shares of mentions and of applies_to, the top relation's share, and which of them warn."""
    by = relation_ratios(edges)
    top = by.limit(1).select(F.col("relation").alias("top_relation"), F.col("ratio").alias("top_ratio"))
    shares = edges.agg(*[F.round(F.coalesce(F.avg((F.col("relation") == r).cast("double")), F.lit(0.0)), 6).alias(f"{r}_ratio") for r in ("mentions", "applies_to")])
    return shares.crossJoin(top).withColumns({"mentions_warning": F.col("mentions_ratio") > 0.5, "top_relation_warning": F.col("top_ratio") > 0.4})


def recompute_degrees(cached: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: (updated, zeroed, unchanged) of entities (id, degree) against the edges."""
    now = cached.select("id", F.col("degree").alias("old")).join(degrees(edges), "id", "left").withColumn("new", F.coalesce("degree", F.lit(0)))
    return now.agg(
        F.count_if((F.col("old") != F.col("new")) & (F.col("new") > 0)).alias("updated"),
        F.count_if((F.col("old") != F.col("new")) & (F.col("new") == 0)).alias("zeroed"),
        F.count_if(F.col("old") == F.col("new")).alias("unchanged"),
    )


def orphans(entities: DataFrame, edges: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entities without an edge and without a memory."""
    return entities.join(endpoints(edges).select("id"), "id", "left_anti").join(bridge.select(F.col("entity_id").alias("id")), "id", "left_anti")


def entities_by_relation(entities: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    ids = endpoints(edges.where(F.col("relation") == relation)).select("id")
    return entities.join(ids, "id", "left_semi").select("name").distinct().orderBy("name")


def memory_context(memory: DataFrame, versions: DataFrame, bridge: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A memory's row with its version (1 without any), its entities, and the edges that touch one of them with both names."""
    top = versions.join(memory.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy(F.col("memory_id").alias("id")).agg(F.max("version").cast("bigint").alias("version"))
    own = entities.join(seed_entities(bridge, memory), "id", "left_semi")
    met = touching(edges, own)
    names = entities.select("id", "name")
    named = met.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    return memory.join(top, "id", "left").withColumn("version", F.coalesce("version", F.lit(1).cast("bigint"))), own, named.select("source", "target", "relation", "weight")


def within(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose endpoints both are among the entities."""
    ids = entities.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an endpoint among the ids, once each."""
    return endpoints(edges).join(ids.select("id"), "id", "left_semi").drop("id").distinct()


def neighbours(edges: DataFrame, bidirectional: bool = False, floor: float | None = None, relation: str | None = None, namespace: str | None = None) -> DataFrame:
    """(from_id, to_id, relation, weight): the steps a walk may take; the floor is inclusive."""
    e = edges
    if namespace is not None:
        e = e.where(F.col("namespace") == namespace)
    if floor is not None:
        e = e.where(F.col("weight") >= floor)
    if relation is not None:
        e = e.where(F.col("relation") == relation)
    out = e.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "relation", "weight")
    if bidirectional:
        out = out.unionByName(e.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), "relation", "weight"))
    return out


def walk(steps: DataFrame, seeds: DataFrame, max_hops: int, cap: int | None = None) -> DataFrame:
    """(id, hop, from_id, relation, weight, path, product) of every entity within ``max_hops`` of a seed, at its least hop.

    Each level joins the frontier to the steps, leaves out what was visited before,
    and keeps one arrival per entity: the strongest edge of the smallest source.
    ``path`` runs from the seed; ``product`` multiplies its weights.  With ``cap``
    a source keeps its strongest unvisited neighbours.  Levels are written, so plans stay flat.
    """
    node = "array(id)"
    level = seeds.select(F.col("id").cast("long").alias("id")).distinct()
    level = level.select("id", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("from_id"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("weight"), F.expr(node).alias("path"), F.lit(1.0).alias("product"))
    visited = level
    for hop in range(1, max_hops + 1):
        reach = level.select(F.col("id").alias("from_id"), F.col("path").alias("_path"), F.col("product").alias("_product")).join(steps, "from_id")
        fresh = reach.join(visited.select(F.col("id").alias("to_id")), "to_id", "left_anti")
        if cap is not None:
            w = Window.partitionBy("from_id").orderBy(F.desc("weight"), "to_id")
            fresh = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
        # The arrival: an aggregate, so it combines before the shuffle even at a hub.
        best = fresh.groupBy("to_id").agg(F.min(F.struct("from_id", (-F.col("weight")).alias("w"), "relation", "_path", "_product")).alias("m"))
        level = best.select(
            F.col("to_id").alias("id"),
            F.lit(hop).alias("hop"),
            F.col("m.from_id").alias("from_id"),
            F.col("m.relation").alias("relation"),
            (-F.col("m.w")).alias("weight"),
            F.concat("m._path", F.array("to_id")).alias("path"),
            (F.col("m._product") * -F.col("m.w")).alias("product"),
        )
        level = snapshot(level, "level")
        visited = visited.unionByName(level)
    return visited


def hops(steps: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(id, hop) without paths."""
    return walk(steps, seeds, max_hops).select("id", F.col("hop").cast("bigint").alias("hop"))


def observed_edges(steps: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(from_id, to_id, relation, weight, hop): every step out of the entities nearer than ``max_hops``, to visited ones too."""
    near = hops(steps, seeds, max(0, max_hops - 1))
    return near.select(F.col("id").alias("from_id"), (F.col("hop") + 1).alias("hop")).join(steps, "from_id").select("from_id", "to_id", "relation", "weight", "hop")


def seed_entities(bridge: DataFrame, memories: DataFrame) -> DataFrame:
    """(id): the entities of seed memories."""
    return bridge.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()


def reach_memories(edges: DataFrame, bridge: DataFrame, memories: DataFrame, seeds: DataFrame, max_hops: int, floor: float | None = 0.3, extra_entities: DataFrame | None = None) -> DataFrame:
    """(id, hop): live memories bound to entities that a directed walk from the seeds' entities reaches, beside the seeds."""
    start = seed_entities(bridge, seeds)
    if extra_entities is not None:
        start = start.unionByName(extra_entities.select("id")).distinct()
    found = hops(neighbours(edges, floor=floor), start, max_hops).where("hop > 0")
    hit = bridge.join(found, bridge["entity_id"] == found["id"]).groupBy("memory_id").agg(F.min("hop").alias("hop")).withColumnRenamed("memory_id", "id")
    return hit.join(scans.live(memories).select("id"), "id", "left_semi").join(seeds.select("id"), "id", "left_anti")


def related(edges: DataFrame, bridge: DataFrame, memories: DataFrame, seeds: DataFrame, max_hops: int = 2, floor: float | None = None, limit: int = 10, entity_seeds: DataFrame | None = None) -> DataFrame:
    """(id, name, hop, weight): memories near a seed memory, or near seed entities, in either direction, each by its nearest, then strongest entity."""
    start = seed_entities(bridge, seeds) if entity_seeds is None else seed_entities(bridge, seeds).unionByName(entity_seeds.select("id")).distinct()
    found = walk(neighbours(edges, bidirectional=True, floor=floor), start, max_hops).where("hop > 0").select(F.col("id").alias("entity_id"), F.col("hop").cast("bigint").alias("hop"), "weight")
    best = bridge.join(found, "entity_id").groupBy("memory_id").agg(F.min(F.struct("hop", (-F.col("weight")).alias("w"))).alias("m"))
    rows = best.join(scans.live(memories).select(F.col("id").alias("memory_id"), "name"), "memory_id").join(seeds.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    return rows.select(F.col("memory_id").alias("id"), "name", F.col("m.hop").alias("hop"), F.round(-F.col("m.w"), 6).alias("weight")).orderBy("hop", F.desc("weight"), "id").limit(limit)


def chains(walked: DataFrame, limit: int | None = 20) -> DataFrame:
    """(from_id, to_id, path, product): evidence paths of two steps or more, heaviest first; all of them without a limit."""
    out = walked.where("hop >= 2").select(F.get("path", F.lit(0)).alias("from_id"), F.col("id").alias("to_id"), "path", F.round("product", 6).alias("product")).orderBy(F.desc("product"), "to_id")
    return out if limit is None else out.limit(limit)


def context(entities: DataFrame, edges: DataFrame, names: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities named like results, with degrees, and the edges among them."""
    own = entity_degrees(entities.join(names.select("name").distinct(), "name", "left_semi"), edges)
    among = within(edges, own).orderBy(F.desc("weight"), "source_id", "target_id", "relation").limit(limit)
    return own, among


def shared_memories(bridge: DataFrame, slice_size: int = 256) -> DataFrame:
    """(a, b, n): pairs of entities, a before b, and the memories they share.

    A memory's entities are dealt into slices by hash; pairs come from one slice, or from two that meet, in rows of bounded size, and are counted
    before they are shuffled.  So a memory with very many entities spreads over as many rows as it has pairs of slices.
    """
    links = bridge.select("memory_id", "entity_id").distinct()
    wide = links.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > slice_size).select("memory_id", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))
    dealt = links.join(wide, "memory_id", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("slice", F.when(F.col("slices") == 1, 0).otherwise(F.pmod(F.xxhash64("entity_id"), F.col("slices")).cast("int")))
    slices = dealt.groupBy("memory_id", "slices", "slice").agg(F.array_sort(F.collect_list("entity_id")).alias("own"))

    def pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
        met = rows.select(F.explode(x).alias("x"), y).select("x", F.explode(y).alias("y")).where("x < y" if x == y else "x <> y")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    inside = pairs(slices, "own", "own")
    many = slices.where("slices > 1")
    sent = many.where("slice > 0").select("memory_id", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("slice") - 1)).alias("slice"))
    across = pairs(many.join(sent, ["memory_id", "slice"]), "own", "other")
    return inside.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(bridge: DataFrame, edges: DataFrame, seen: DataFrame | None = None, most: int = 50) -> DataFrame:
    """(a, b, n): unlinked pairs of entities that share memories, most shared first."""
    pairs = shared_memories(bridge)
    linked = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    out = pairs.join(linked, ["a", "b"], "left_anti")
    if seen is not None:
        out = out.join(seen.select("a", "b"), ["a", "b"], "left_anti")
    return out.orderBy(F.desc("n"), "a", "b").limit(most)


def hub_island(entities: DataFrame, edges: DataFrame, bridge: DataFrame, hubs: int = 32, islands: int = 500, most: int = 50) -> DataFrame:
    """(a, b): the largest hubs with entities that have a memory but no edge, in order of hub and island; both sides are limited lists."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(hubs).withColumn("h", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    alone = entities.join(endpoints(edges).select("id"), "id", "left_anti").join(bridge.select(F.col("entity_id").alias("id")), "id", "left_semi").select("id").orderBy("id").limit(islands)
    pairs = top.select(F.col("id").alias("hub"), "h").crossJoin(F.broadcast(alone.select(F.col("id").alias("island"))))
    return pairs.select(F.least("hub", "island").alias("a"), F.greatest("hub", "island").alias("b"), "h", "island").orderBy("h", "island").limit(most).select("a", "b")


def isolated_pairs(entities: DataFrame, edges: DataFrame, bridge: DataFrame, most: int = 50) -> DataFrame:
    """Pairs by shared memories first, filled up with hub and island pairs, none twice."""
    first = cooccurrence(bridge, edges, most=most).select("a", "b", F.lit(0).alias("p"), (-F.col("n")).alias("o"))
    fill = hub_island(entities, edges, bridge, most=most).select("a", "b", F.lit(1).alias("p"), F.lit(0).cast("long").alias("o"))
    one = first.unionByName(fill).groupBy("a", "b").agg(F.min(F.struct("p", "o")).alias("m"))
    return one.orderBy("m.p", "m.o", "a", "b").limit(most).select("a", "b")
