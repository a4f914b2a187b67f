"""Registered queries of writes, queue transitions, enrichment scans and text rules: each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import backlog, fulltext, graph, maintain, queue, resolve, shape, tables, vector
from tessellar.plans.catalogue import _LIVE_KNN, _TOKS, _like, plan, query_vector
from tessellar.sources import files

AT = 1720000000

# Memories.


@plan(
    f"""with n as (select namespace, name, 'again ' || name as body from memories where id % 10 = 0 union all select 'global', 'fresh-' || cast(id as varchar), 'new body' from memories where id % 25 = 3),
 f as (select n.*, row_number() over (order by n.namespace, n.name) as k from n left join memories m on m.namespace = n.namespace and m.name = n.name where m.id is null)
 select coalesce(m.id, (select max(id) from memories) + f.k) as id, coalesce(m.namespace, n.namespace) as namespace, coalesce(m.name, n.name) as name, coalesce(n.body, m.body) as body,
 case when n.name is null then m.deleted_at end as deleted_at, case when n.name is null then m.updated_at else {AT} end as updated_at
 from memories m full join n on m.namespace = n.namespace and m.name = n.name left join f on f.namespace = n.namespace and f.name = n.name"""
)
def remember(c):
    return maintain.remember(c.memories, c.memory_versions, _incoming(c), AT)[0].select("id", "namespace", "name", "body", "deleted_at", "updated_at")


def _incoming(c):
    new = c.memories.where("id % 10 = 0").select("namespace", "name", F.concat(F.lit("again "), "name").alias("body"))
    return new.unionByName(c.memories.where("id % 25 = 3").select(F.lit("global").alias("namespace"), F.concat(F.lit("fresh-"), F.col("id").cast("string")).alias("name"), F.lit("new body").alias("body")))


@plan(
    """with n as (select namespace, name from memories where id % 10 = 0 union all select 'global', 'fresh-' || cast(id as varchar) from memories where id % 25 = 3),
 f as (select n.*, m.id as old, row_number() over (partition by m.id is null order by n.namespace, n.name) as k from n left join memories m on m.namespace = n.namespace and m.name = n.name),
 w as (select coalesce(old, (select max(id) from memories) + k) as memory_id, name, old is null as fresh from f),
 v as (select memory_id, max(version) as top from memory_versions group by memory_id)
 select memory_id, cast(version as bigint) as version, name, change_reason from memory_versions
 union all select w.memory_id, coalesce(v.top, 0) + 1, w.name, case when fresh then 'create' else 'edit' end from w left join v on v.memory_id = w.memory_id"""
)
def remember_versions(c):
    logged = maintain.remember(c.memories, c.memory_versions, _incoming(c), AT)[1]
    return logged.select("memory_id", F.col("version").cast("bigint").alias("version"), "name", "change_reason")


@plan(f"select id, case when id = 7 and deleted_at is null and updated_at = 1700000420 then 'edited' else body end as body, case when id = 7 and deleted_at is null and updated_at = 1700000420 then {AT} else updated_at end as updated_at from memories")
def edit_locked(c):
    return maintain.edit(c.memories, 7, AT, 1700000420, body="edited").select("id", "body", "updated_at")


@plan(f"select id, case when id = 8 and deleted_at is null then 'edited' else description end as description, case when id = 8 and deleted_at is null then {AT} else updated_at end as updated_at from memories")
def edit(c):
    return maintain.edit(c.memories, 8, AT, description="edited").select("id", "description", "updated_at")


@plan(f"select id, case when namespace = 'global' and name = 'doc-1' and deleted_at is null then 'doc-17' else name end as name from memories where not (namespace = 'global' and name = 'doc-17' and deleted_at is not null)")
def rename(c):
    return maintain.rename(c.memories, "global", "doc-1", "doc-17", AT).select("id", "name")


@plan("with p as (select name, namespace, unnest(range((length(body) + 3999) // 4000)) as i, body from memories where length(body) > 4000) select namespace, name || '-part-' || cast(i as varchar) as name, substr(body, i * 4000 + 1, 4000) as body from p")
def split_body(c):
    """Bodies of more than 4,000 characters in parts of as many, whole."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("body"), F.lit(1)), F.lit(4000))
    pieces = F.transform(starts, lambda i: F.substring(F.col("body"), i, F.lit(4000)))
    return maintain.split_body(c.memories, pieces, AT)[0].select("namespace", "name", "body")


@plan(
    "with d as (select id, 1 + id % 3 as i, repeat(description, 8) as d from memories) select id, 'part ' || cast(i as varchar) as x, substr(d, 1, coalesce((select max(k) from range(0, 501) t(k) where strlen(substr(d, 1, k)) <= 500 - length(' (part ' || cast(i as varchar) || '/3)')), 0)) || ' (part ' || cast(i as varchar) || '/3)' as description from d"
)
def partition_description(c):
    """Descriptions, eight times over, within 500 bytes."""
    i = F.lit(1) + F.col("id") % 3
    return c.memories.select("id", F.concat(F.lit("part "), i.cast("string")).alias("x"), X.partition_description(F.repeat("description", 8), i, F.lit(3)).alias("description"))


@plan("select memory_id, cast(version as bigint) as version from memory_versions v where exists (select 1 from memories m where m.id = v.memory_id and (deleted_at is null or deleted_at > 1710000500))")
def purge_children(c):
    return maintain.purge(c.memories, 1710000500, 0, (c.memory_versions, "memory_id"))[1][0].select("memory_id", F.col("version").cast("bigint").alias("version"))


# Entities, edges and bridges.


@plan("with n as (select 'global' as namespace, name, 'concept' as type from entities where type = 'location' union all select 'global', 'new-' || cast(id - 1000000 as varchar), 'tool' from entities where id < 2000000) select coalesce(e.namespace, n.namespace) as namespace, coalesce(e.name, n.name) as name, coalesce(n.type, e.type) as type from entities e full join n on e.namespace = n.namespace and e.name = n.name")
def upsert_entities(c):
    new = c.entities.where("type = 'location'").select("namespace", F.upper("name").alias("name"), F.lit("concept").alias("type"))
    new = new.unionByName(c.entities.where("id < 2000000").select(F.lit("global").alias("namespace"), F.concat(F.lit("New "), (F.col("id") - 1000000).cast("string")).alias("name"), F.lit("tool").alias("type")))
    return maintain.upsert_entities(c.entities.select("namespace", "name", "type"), new)


@plan(
    "with n as (select source_id, target_id, relation, 0.25::double as weight from relationships where relation = 'follows' union all select source_id, target_id, 'mentions', 0.75::double from relationships where relation = 'applies_to') select coalesce(r.source_id, n.source_id) as source_id, coalesce(r.target_id, n.target_id) as target_id, coalesce(r.relation, n.relation) as relation, coalesce(n.weight, r.weight) as weight from relationships r full join n on r.source_id = n.source_id and r.target_id = n.target_id and r.relation = n.relation"
)
def upsert_edges(c):
    e = c.relationships.select("source_id", "target_id", "relation", "weight")
    new = e.where("relation = 'follows'").withColumn("weight", F.lit(0.25)).withColumn("relation", F.lit("FOLLOWS"))
    new = new.unionByName(e.where("relation = 'applies_to'").withColumns({"relation": F.lit("mentions"), "weight": F.lit(0.75)}))
    # Guards: loops and weights beyond one are no edges.
    bad = e.limit(3).withColumn("target_id", F.col("source_id")).unionByName(e.limit(3).withColumn("weight", F.lit(1.5)))
    return maintain.upsert_edges(e, new.unionByName(bad))


@plan("select source_id, target_id, relation, weight from relationships union all select source_id, target_id, 'uses', 0.1::double from relationships where relation = 'applies_to'")
def create_or_fetch_edges(c):
    e = c.relationships.select("source_id", "target_id", "relation", "weight")
    return maintain.create_or_fetch_edges(e, e.where("relation = 'applies_to'").withColumns({"relation": F.lit("uses"), "weight": F.lit(0.1)}).unionByName(e.withColumn("weight", F.lit(0.9))))


@plan("select source_id, target_id, relation, weight from relationships where source_id <> 2000003 and target_id <> 2000003")
def unlink_entity(c):
    return maintain.unlink(c.relationships, entity=2000003).select("source_id", "target_id", "relation", "weight")


@plan("select source_id, target_id, relation from relationships where not (source_id = 2000003 and target_id = 1000001)")
def unlink_pair(c):
    return maintain.unlink(c.relationships, 2000003, 1000001).select("source_id", "target_id", "relation")


@plan("select distinct memory_id, case when entity_id in (2000001, 2000002) then 2000000 else entity_id end as entity_id from memory_entities")
def merge_entities_bridges(c):
    return maintain.merge_entities(c.entities, c.relationships, c.memory_entities, [2000001, 2000002], 2000000)[2]


_LOUD = "n as (select id, namespace, replace(upper(name), '-', ' ') as name, type from entities union all select id + 9000000, namespace, name, type from entities where type = 'location'), k as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as new_name from n), s as (select *, min(id) over (partition by namespace, new_name) as survivor from k)"


def _loud(c):
    loud = c.entities.select("id", "namespace", F.replace(F.upper("name"), F.lit("-"), F.lit(" ")).alias("name"), "type")
    return loud.unionByName(c.entities.where("type = 'location'").select((F.col("id") + 9000000).alias("id"), "namespace", "name", "type"))


@plan(f"with {_LOUD} select id, new_name as name, type from s where id = survivor")
def normalize_entities(c):
    return maintain.normalized(_loud(c), c.relationships, c.memory_entities)[0].select("id", "name", "type")


@plan(f"with {_LOUD}, r as (select source_id + 9000000 as source_id, target_id, relation, weight from relationships where relation = 'applies_to' union all select source_id, target_id, relation, weight from relationships), t as (select a.survivor as source_id, b.survivor as target_id, relation, weight from r join s a on a.id = r.source_id join s b on b.id = r.target_id) select source_id, target_id, relation, max(weight) as weight from t where source_id <> target_id group by all")
def normalize_edges(c):
    e = c.relationships.select("source_id", "target_id", "relation", "weight")
    both = e.where("relation = 'applies_to'").withColumn("source_id", F.col("source_id") + 9000000).unionByName(e)
    return maintain.normalized(_loud(c), both, c.memory_entities)[1]


@plan("select id, case when type = 'location' then 'concept' else type end as type from entities")
def reclassify_entities(c):
    return maintain.reclassify(c.entities, "location", "concept").select("id", "type")


@plan("select id, case when id = 2000004 then 'a-new-name' else name end as name from entities")
def rename_entity(c):
    return maintain.rename_entity(c.entities, 2000004, "A New Name").select("id", "name")


@plan("select source_id, target_id, relation from relationships where source_id not in (select id from entities where type = 'tool') and target_id not in (select id from entities where type = 'tool')")
def delete_entities_edges(c):
    return maintain.delete_entities(c.entities, c.relationships, c.memory_entities, c.entities.where("type = 'tool'"))[1].select("source_id", "target_id", "relation")


@plan("select memory_id, entity_id from memory_entities where entity_id not in (select id from entities where type = 'tool')")
def delete_entities_bridges(c):
    return maintain.delete_entities(c.entities, c.relationships, c.memory_entities, c.entities.where("type = 'tool'"))[2]


@plan("select memory_id, entity_id from memory_entities union select id, cast(1000000 as bigint) from memories where id % 50 = 0")
def link_memories(c):
    return maintain.link_memories(c.memory_entities, c.memories.where("id % 50 = 0").select(F.col("id").alias("memory_id"), F.lit(1000000).cast("bigint").alias("entity_id")))


@plan("select memory_id, entity_id from memory_entities where memory_id % 2 = 1")
def unlink_memories(c):
    return maintain.unlink_memories(c.memory_entities, c.memories.where("id % 2 = 0").select(F.col("id").alias("memory_id")))


@plan("select source_id, target_id, relation, weight from relationships where source_id in (select id from entities where type = 'location') and target_id in (select id from entities where type = 'location')")
def edges_within(c):
    return graph.within(c.relationships, c.entities.where("type = 'location'")).select("source_id", "target_id", "relation", "weight")


@plan("select source_id, target_id, relation, weight from relationships where source_id in (2000001, 2000002) or target_id in (2000001, 2000002)")
def edges_touching(c):
    return graph.touching(c.relationships, c.entities.where("id in (2000001, 2000002)")).select("source_id", "target_id", "relation", "weight")


_DEG = "ends as (select source_id as id from relationships union all select target_id from relationships where target_id <> source_id), deg as (select id, count(*) as degree from ends group by id)"


@plan(f"with {_DEG} select e.id, e.name, coalesce(degree, 0) as degree from entities e left join deg using (id) where type = 'location' order by name, e.id limit 20 offset 5")
def entities_by_name(c):
    return graph.list_entities(c.entities, c.relationships, kind="location", sort="name", descending=False, limit=20, offset=5).select("id", "name", "degree")


@plan(f"with {_DEG} select e.id, e.name, coalesce(degree, 0) as degree from entities e left join deg using (id) where name in ('nation-1', 'nation-2', 'region-0')")
def result_context(c):
    names = c.entities.where("name in ('nation-1', 'nation-2', 'region-0')").select("name")
    return graph.context(c.entities, c.relationships, names)[0].select("id", "name", "degree")


@plan("with recursive st as (select source_id as f, target_id as t from relationships where relation = 'follows'), w(id, hop) as (select cast(2000003 as bigint), 0 union select st.t, hop + 1 from w join st on st.f = w.id where hop < 4) select id, cast(min(hop) as bigint) as hop from w group by id")
def bfs_relation(c):
    return graph.hops(graph.neighbours(c.relationships, relation="follows"), c.entities.where("id = 2000003"), 4)


@plan("with st as (select source_id as f, target_id as t, weight from relationships union all select target_id, source_id, weight from relationships), x as (select distinct t, weight from st where f = 1000001 and t <> 1000001), r as (select t, row_number() over (order by weight desc, t) as n from x) select cast(1000001 as bigint) as id, cast(0 as bigint) as hop union all select t, 1 from r where n <= 3")
def bfs_cap(c):
    steps = graph.neighbours(c.relationships, bidirectional=True).distinct()
    return graph.walk(steps, c.entities.where("id = 1000001"), 1, cap=3).select("id", F.col("hop").cast("bigint").alias("hop"))


@plan(f"with {_DEG}, x as (select a.entity_id as a, b.entity_id as b, count(*) as n from memory_entities a join memory_entities b on a.memory_id = b.memory_id and a.entity_id < b.entity_id group by all), p as (select a, b, n from x where not exists (select 1 from relationships r where least(source_id, target_id) = a and greatest(source_id, target_id) = b) order by n desc, a, b limit 50), hub as (select id, row_number() over (order by degree desc, id) as h from deg order by h limit 32), isl as (select id from entities where id not in (select id from deg) and id in (select entity_id from memory_entities) order by id limit 500), q as (select least(hub.id, isl.id) as a, greatest(hub.id, isl.id) as b from hub, isl order by h, isl.id limit 50), u as (select a, b, 0 as p, -n as o from p union all select a, b, 1, 0 from q), g as (select a, b, min((p, o)) as m from u group by a, b) select 'pair:' || cast(a as varchar) || ':' || cast(b as varchar) as item_key from g order by m, a, b limit 50")
def entity_connect_backlog(c):
    return backlog.entity_pairs(c.entities, c.relationships, c.memory_entities)


# The queue.

_NEW = "n as (select 'global' as namespace, 'ReEmbed' as operation, case when id % 2 = 0 then 'item-' || cast(id as varchar) else 'doc-' || cast(id as varchar) end as item_key from memories)"


def _queue_keys(c):
    key = F.when(F.col("id") % 2 == 0, F.concat(F.lit("item-"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("doc-"), F.col("id").cast("string")))
    return c.memories.select(F.lit("global").alias("namespace"), F.lit("ReEmbed").alias("operation"), key.alias("item_key"))


@plan(f"with {_NEW} select namespace, operation, item_key, status from queue union all select namespace, operation, item_key, 'pending' from n where not exists (select 1 from queue q where q.namespace = n.namespace and q.operation = n.operation and q.item_key = n.item_key)")
def enqueue(c):
    return queue.enqueue(c.queue, _queue_keys(c)).select("namespace", "operation", "item_key", "status")


@plan(
    f"with {_NEW} select q.operation, q.item_key, case when n.item_key is not null then greatest(priority, 5) else priority end as priority, status from queue q left join n on q.namespace = n.namespace and q.operation = n.operation and q.item_key = n.item_key union all select operation, item_key, 5, 'pending' from n where not exists (select 1 from queue q where q.namespace = n.namespace and q.operation = n.operation and q.item_key = n.item_key)"
)
def enqueue_priority(c):
    return queue.enqueue_with_priority(c.queue, _queue_keys(c).withColumn("priority", F.lit(5))).select("operation", "item_key", "priority", "status")


@plan(f"select id, case when status = 'processing' then cast({AT} as bigint) else claimed_at end as claimed_at from queue")
def heartbeat(c):
    return queue.heartbeat(c.queue, c.queue.where("status = 'processing'"), AT).select("id", "claimed_at")


@plan("select id, case when status = 'processing' then case when id % 2 = 0 then 'done' else 'skipped' end else status end as status from queue")
def mark_outcomes(c):
    done = queue.mark_done(c.queue, c.queue.where("status = 'processing' and id % 2 = 0"))
    return queue.mark_skipped(done, c.queue.where("status = 'processing' and id % 2 = 1")).select("id", "status")


@plan("select id, case when status in ('done', 'skipped') and id % 3 = 0 then 'pending' else status end as status from queue")
def reopen(c):
    return queue.reopen(c.queue, c.queue.where("id % 3 = 0")).select("id", "status")


@plan("select id, case when operation = 'ReEmbed' and status = 'processing' then 'pending' else status end as status from queue")
def reset_operation(c):
    return queue.reset_operation(c.queue, "ReEmbed").select("id", "status")


@plan("select id, case when operation = 'ReEmbed' and status = 'pending' and id % 2 = 0 then 'done' else status end as status from queue")
def reconcile(c):
    return queue.reconcile(c.queue, c.queue.where("id % 2 = 0").select("item_key")).select("id", "status")


@plan("with q as (select id, status, case when id % 4 = 0 then 'entity:' || item_key when id % 4 = 1 then 'doc-' || cast(id as varchar) else item_key end as item_key from queue) select id, item_key from q where not (status = 'dead' and (item_key like 'entity:%' or (item_key not like 'pair:%' and item_key not like 'chunk:%' and item_key not in (select name from memories))))")
def prune_dead(c):
    key = F.when(F.col("id") % 4 == 0, F.concat(F.lit("entity:"), "item_key")).when(F.col("id") % 4 == 1, F.concat(F.lit("doc-"), F.col("id").cast("string"))).otherwise(F.col("item_key"))
    return queue.prune_dead(c.queue.withColumn("item_key", key), c.memories).select("id", "item_key")


@plan("select id, case when id % 4 = 0 then 'entity' when id % 4 = 1 then 'chunk' when id % 4 = 2 then 'entity_pair' else 'memory' end as kind from queue")
def item_types(c):
    head = F.element_at(F.array(F.lit("entity:"), F.lit("chunk:"), F.lit("pair:"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return c.queue.select("id", queue.item_type(F.concat(head, "item_key")).alias("kind"))


@plan("select id from queue where id % 5 <> 0")
def drop_items(c):
    return queue.drop_items(c.queue, c.queue.where("id % 5 = 0")).select("id")


@plan("select id, operation, item_key, attempt from queue where status = 'dead' and operation = 'ReEmbed' order by id limit 50")
def list_dead(c):
    return queue.listed(c.queue, "dead", "ReEmbed", 50).select("id", "operation", "item_key", "attempt")


@plan("select id, case when status = 'dead' and operation = 'ReEmbed' then 'pending' else status end as status, case when status = 'dead' and operation = 'ReEmbed' then 0 else attempt end as attempt from queue")
def requeue_dead(c):
    return queue.requeue(c.queue, "dead", "ReEmbed").select("id", "status", "attempt")


@plan("with s as (select id, case id % 3 when 0 then 'done' when 1 then 'failed' else 'open' end as status, claimed_at as updated_at from queue) select id from s where not (status in ('done', 'failed') and updated_at < 1700020000)")
def stage_cleanup(c):
    status = F.element_at(F.array(F.lit("done"), F.lit("failed"), F.lit("open")), (F.col("id") % 3 + 1).cast("int"))
    return queue.stage_cleanup(c.queue.select("id", status.alias("status"), F.col("claimed_at").alias("updated_at")), 1700020000).select("id")


# Vectors, text index and backlogs.


@plan("select memory_id, label, len(embedding) as dim from memory_embeddings where memory_id % 2 = 1 union all select memory_id, -1, 2 from memory_embeddings where memory_id % 2 = 0")
def vector_upsert(c):
    new = c.memory_embeddings.where("memory_id % 2 = 0").select("memory_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit(-1).cast(c.memory_embeddings.schema["label"].dataType).alias("label"))
    empty = c.memory_embeddings.where("memory_id % 2 = 1").withColumn("embedding", F.array().cast("array<float>"))
    return vector.upsert(c.memory_embeddings, new.unionByName(empty.select(*new.columns)), "memory_id").select("memory_id", "label", F.size("embedding").cast("bigint").alias("dim"))


@plan("select memory_id from memory_embeddings e where exists (select 1 from memories m where m.id = e.memory_id and deleted_at is null)")
def purge_orphan_vectors(c):
    return vector.delete(c.memory_embeddings, vector.orphans(c.memory_embeddings, c.memories), "memory_id").select("memory_id")


@plan(f"with t as (select case when id % 3 = 0 then id end as changed, id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(concat_ws(' ', name, description, case when id % 3 = 0 then 'edited text' else body end))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as term from memories where deleted_at is null) select term, id, count(*) as tf from t group by term, id")
def fts_sync(c):
    changed = c.memories.where("id % 3 = 0").withColumn("body", F.lit("edited text"))
    return fulltext.sync_index(fulltext.postings(c.memories), changed)


@plan("select 'missing' as problem, id from memories where deleted_at is null and id % 7 = 0 union all select 'stale', id from memories where deleted_at is not null and id % 2 = 0")
def fts_check(c):
    kept = fulltext.postings(c.memories.where("id % 7 <> 0"))
    stale = c.memories.where("deleted_at is not null and id % 2 = 0").select(F.lit("x").alias("term"), "id", F.lit(1).cast("bigint").alias("tf"))
    return fulltext.check_index(kept.unionByName(stale), c.memories)


@plan(f"with d as (select id, {_TOKS} as toks from memories where deleted_at is null) select id, cast(len(toks) as bigint) as dl from d")
def fts_lengths(c):
    return fulltext.lengths(c.memories)


@plan(
    f"with kn as (select id from ({_LIVE_KNN} and namespace in ('archive', 'none')) order by distance, id limit 10) select id from kn"
)
def knn_namespaces(c):
    return vector.memory_knn(c.memory_embeddings, c.memories, query_vector(c), 10, ("archive", "none")).select("id")


@plan("select id, name from memories where deleted_at is null and name in (select name from memories where id % 3 = 0) and id in (select memory_id from memory_entities)")
def bound_memories(c):
    return backlog.bound_memories(c.memories, c.memory_entities, c.memories.where("id % 3 = 0").select("name")).select("id", "name")


_DESCRIBED = "d as (select id, name, case id % 4 when 0 then null when 1 then '' when 2 then 'It is a software component of X' else 'Fine: ' || name end as description from entities)"


def _described(c):
    d = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("It is a software component of X"), F.concat(F.lit("Fine: "), "name")), (F.col("id") % 4 + 1).cast("int"))
    return c.entities.select("id", "name", d.alias("description"))


@plan(f"with {_DESCRIBED} select id, name from d where coalesce(description, '') = ''")
def undescribed_entities(c):
    return backlog.undescribed_entities(_described(c)).select("id", "name")


@plan(f"with {_DESCRIBED} select id, name from d where coalesce(description, '') = '' or lower(description) like '%is a software component%'")
def redescribe_entities(c):
    return backlog.undescribed_entities(_described(c), force=True).select("id", "name")


@plan("select id, namespace, name from memories where deleted_at is null")
def audit_scan(c):
    return backlog.memory_names(c.memories)


@plan("select name as item_key from memories m where deleted_at is null and not exists (select 1 from queue q where q.operation = 'ReEmbed' and q.status = 'dead' and q.item_key = 'item-' || substr(m.name, 5))")
def veto(c):
    keys = c.memories.where("deleted_at is null").select(F.col("name").alias("item_key"))
    skipped = c.queue.where("status = 'dead'").withColumns({"status": F.lit("skipped"), "item_key": F.regexp_replace("item_key", "^item-", "doc-")})
    return backlog.without_skipped(keys, skipped, "ReEmbed")


@plan(f"with l as (select id, name, {_like('region-1')} as score from (select *, lower(trim(name)) as n from entities)), t as (select *, row_number() over (order by score desc, name, id) as k, lead(score) over (order by score desc, name, id) as nxt from (select * from l where score >= 0.75 order by score desc, name, id limit 2)) select id, name, score from t where k = 1 and ((score >= 0.9 and (nxt is null or score - nxt >= 0.05)) or (nxt is null and score >= 0.85))")
def resolve_entity(c):
    return resolve.resolve(c.entities, " Region-1 ")


# Chunk and URL tables.


@plan("with k as (select id as memory_id, body, cast(unnest(range((length(body) + 99) // 100)) as bigint) as chunk_idx from memories where id % 5 <> 0) select memory_id, chunk_idx, substr(body, chunk_idx * 100 + 1, 100) as chunk_text from k where memory_id % 2 = 1 union all select id, cast(0 as bigint), 'new' from memories where id % 2 = 0 and id % 5 <> 0")
def chunk_table(c):
    """Whole bodies in chunks of 100 characters, replaced for some memories and deleted for others."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length("body") - 1, F.lit(0)), F.lit(100)), lambda i: i < F.length("body"))
    some = c.memories.select(F.col("id").alias("memory_id"), F.posexplode(F.transform(starts, lambda i: F.substring(F.col("body"), i + 1, F.lit(100)))).alias("chunk_idx", "chunk_text"))
    some = some.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))
    new = c.memories.where("id % 2 = 0").select(F.col("id").alias("memory_id"), F.lit(0).cast("bigint").alias("chunk_idx"), F.lit("new").alias("chunk_text"))
    kept = tables.delete_of(tables.replace_chunks(some, new), c.memories.where("id % 5 = 0").select(F.col("id").alias("memory_id")))
    return kept.select("memory_id", "chunk_idx", "chunk_text")


@plan("select page_id as memory_id, url, cast(strlen('é ' || repeat('ü', page_id % 7) || ' ') as bigint) as pos from pages where regexp_matches(url, '^https?://[^\\s)\\]}\"''<]*$')")
def url_table(c):
    """URLs of bodies at their byte offsets, each at its first place."""
    bodies = c.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("é "), F.repeat(F.lit("ü"), (F.col("page_id") % 7).cast("int")), F.lit(" "), "url", F.lit(" and again "), "url").alias("body"))
    return tables.memory_urls(bodies).select("memory_id", "url", F.col("start").alias("pos")).where(F.col("url").rlike("^https?://"))


@plan("select 'chunk:' || cast(id * 10 as varchar) as item_key from memories where deleted_at is null and namespace = 'global' and id % 2 = 1")
def reembed_chunks(c):
    chunks = c.memories.select((F.col("id") * 10).alias("id"), F.col("id").alias("memory_id"))
    vectors = c.memories.where("id % 2 = 0").select((F.col("id") * 10).alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    return tables.missing_chunk_vectors(chunks, c.memories, vectors, 2, "global").select("item_key")


# Text rules and shaping.


_LABELS = ["Applies-To", "uses", "DEPENDS-ON", "causes", "fixes", "contradicts", "supports", "follows", "related", "mentions", "replaces", "tracked-in", "adds", "Creates", "implements", "blocks", "tested by", "related_to", "part-of", "invents"]
_MEANT = ["applies_to", "uses", "depends_on", "causes", "fixes", "contradicts", "supports", "follows", "related", "mentions", "replaces", "tracked_in", "causes", "causes", "supports", "contradicts", "related", "related", "applies_to", "related"]
_AS_THEY_ARE = ["uses", "causes", "fixes", "contradicts", "supports", "follows", "related", "mentions", "replaces"]


@plan("with l as (select * from (values " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(_LABELS, _MEANT))) + ") t(i, label, meant)) select event_id, meant as relation, label in (" + ", ".join(f"'{x}'" for x in _AS_THEY_ARE) + ") as canonical from events join l on i = event_id % " + str(len(_LABELS)))
def relation_names(c):
    """Labels in several spellings, aliases and unknown ones among them, as canonical relations."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("event_id") % len(_LABELS) + 1).cast("int"))
    return c.events.select("event_id", X.canonical_relation(label).alias("relation"), X.is_canonical_relation(label).alias("canonical"))


@plan("select id, replace(lower(case when id % 2 = 0 then 'Depends-On' else 'USES' end), '-', '_') as relation, true as fine from entities")
def relation_forms(c):
    raw = F.when(F.col("id") % 2 == 0, "Depends-On").otherwise("USES")
    return c.entities.select("id", X.normalize_relation(raw).alias("relation"), X.valid_relation(X.normalize_relation(raw)).alias("fine"))


@plan("select id, strlen(n) >= 2 and not regexp_matches(n, '[\\n\\r]') and not regexp_matches(n, '^[0-9]+$') and not (strlen(n) <= 4 and regexp_matches(n, '^[A-Z_-]*$')) as valid from (select id, case id % 4 when 0 then name when 1 then cast(id as varchar) when 2 then 'API' else 'x' end as n from entities)")
def valid_entity_names(c):
    n = F.element_at(F.array(F.col("name"), F.col("id").cast("string"), F.lit("API"), F.lit("x")), (F.col("id") % 4 + 1).cast("int"))
    return c.entities.select("id", X.valid_entity_name(n).alias("valid"))


@plan("with t as (select id, replace(replace(upper(name), '-', '_'), 'DOC', 'Do c') as s from memories), k as (select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(s, '[_\\s]', '-', 'g')), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), '-') as n from t) select id, case when length(n) > 7 then trim(substr(n, 1, 7), '-') else n end as name from k")
def kebab_names(c):
    raw = F.replace(F.replace(F.upper("name"), F.lit("-"), F.lit("_")), F.lit("DOC"), F.lit("Do c"))
    return c.memories.select("id", X.kebab_name(raw, 7).alias("name"))


@plan("select id, regexp_replace(replace(name, '-', '---'), '-+', '-', 'g') as name from memories")
def collapse_dashes(c):
    return c.memories.select("id", X.collapse_dashes(F.replace("name", F.lit("-"), F.lit("---"))).alias("name"))


@plan("select source_id, target_id, 'pair:' || cast(least(source_id, target_id) as varchar) || ':' || cast(greatest(source_id, target_id) as varchar) as key, least(source_id, target_id) as low, greatest(source_id, target_id) as high from relationships")
def pair_keys(c):
    key = X.pair_key(F.col("target_id"), F.col("source_id"))
    return c.relationships.select("source_id", "target_id", key.alias("key"), X.parse_pair_key(key)["low"].alias("low"), X.parse_pair_key(key)["high"].alias("high"))


@plan("select id, regexp_replace(name || '.' || type, '[^A-Za-z0-9_]', '_', 'g') as safe from entities")
def drawing_ids(c):
    return c.entities.select("id", X.safe_id(F.concat("name", F.lit("."), "type")).alias("safe"))


@plan("select id, cast(least(1000 * pow(2, attempt), 60000) as bigint) as wait from queue")
def backoff(c):
    return c.queue.select("id", X.backoff_ms(F.col("attempt")).alias("wait"))


@plan("select event_id, case when event_id % 3 = 0 then event_id when event_id % 3 = 1 then 1704067200 end as at, case event_id % 3 when 0 then true when 1 then false end as flag from events")
def expected_times(c):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, "2024-01-01T00:00:00Z").otherwise("soon")
    flag = F.when(F.col("event_id") % 3 == 0, "Yes").when(F.col("event_id") % 3 == 1, "off").otherwise("maybe")
    return c.events.select("event_id", X.parse_expected_timestamp(raw).alias("at"), X.parse_bool(flag).alias("flag"))


@plan("select id, cast(ceil((len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) + 1) * 1.5) as bigint) as tokens from memories")
def passage_tokens(c):
    return c.memories.select("id", X.passage_tokens(F.col("body")).alias("tokens"))


@plan("select id, substr(name, 1, 5) as name, substr(body, 1, 5) as body, updated_at from memories")
def truncate_strings(c):
    return shape.truncate_strings(c.memories.select("id", "name", "body", "updated_at"), 5)


@plan("select id, name from memories where coalesce(cast(deleted_at as varchar), '') like '%17100%' and cast(updated_at as varchar) <> '1700000000'")
def filter_coercion(c):
    rows = c.memories.select("id", "name", "deleted_at", "updated_at")
    return shape.shape(rows, ["deleted_at ~ 17100", "updated_at != 1700000000"], select=["id", "name"])


@plan("select (select count(*) from memories) as input, (select count(*) from memories where type = 'note') as output, (select count(*) from memories where coalesce(type, '') <> 'note') as dropped")
def shape_meta(c):
    return shape.meta(c.memories, shape.shape(c.memories, ["type = note"]))


@plan("select count(*) as n from memories where namespace = 'archive' and type = 'note'")
def count_only(c):
    return shape.count_only(c.memories, ["namespace == archive", "type = note"])


# Files.


@plan("with f as (select '/in/' || case when id % 3 = 0 then 'a' when id % 3 = 1 then 'a-1' else 'doc ' || cast(id as varchar) end || '/' || cast(id + 1000000 as varchar) as path, id % 3 as k from memories) select case k when 2 then 'other' else 'same' end as kind, count(*) as files, count(*) as names from f group by 1")
def ingest_names(c):
    stem = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "a-1").otherwise(F.concat(F.lit("doc "), F.col("id").cast("string")))
    rows = c.memories.select(F.concat(F.lit("/in/"), (F.col("id") + 1000000).cast("string"), F.lit("/"), stem, F.lit(".md")).alias("path"), "body")
    named = files.plan_ingest(rows, c.memories.where("id % 2 = 0").select("name"))
    lost = named.join(c.memories.where("id % 2 = 0").select("name"), "name", "left_semi")
    kind = F.when(F.col("path").contains("/doc "), "other").otherwise("same")
    counted = named.join(lost.select("path"), "path", "left_anti").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("name").alias("names"))
    return counted


@plan("select name, case when id % 2 = 0 then 'note' else type end as type, body from memories where deleted_at is null")
def export_lines(c):
    lines = files.export_lines(c.memories.withColumn("type", F.when(F.col("id") % 2 == 0, "note").otherwise(F.col("type"))))
    parsed = lines.select(F.from_json("value", "kind string, name string, type string, body string").alias("j")).where("j.kind is null")
    return parsed.select("j.name", "j.type", "j.body")
