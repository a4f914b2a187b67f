"""Registered queries of reads with their graph, expansion, coverage and counters: each beside its DuckDB twin."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessellar.operators import backlog, graph, maintain, scans, search, vector
from tessellar.plans.catalogue import _COS, _LIVE_KNN, QUERY, _bm25, _fused, _walk, plan, query_vector

# Coverage and counters.


def _chunks(c):
    chunks = c.memories.select((F.col("id") * 10).alias("id")).unionByName(c.memories.where("id % 4 = 1").select((F.col("id") * 10 + 1).alias("id")))
    vectors = c.memories.where("id % 3 <> 0").select((F.col("id") * 10).alias("chunk_id")).unionByName(c.memories.where("id % 50 = 0").select((-F.col("id") - 1).alias("chunk_id")))
    return chunks, vectors


@plan(
    """with k as (select id * 10 as id from memories union all select id * 10 + 1 from memories where id % 4 = 1), kv as (select id * 10 as id from memories where id % 3 <> 0 union all select -id - 1 from memories where id % 50 = 0),
 s as (select 'memory' as target, m.id as r, v.id as v from (select id from memories where deleted_at is null) m full join (select distinct memory_id as id from memory_embeddings) v on v.id = m.id
  union all select 'entity', e.id, v.id from entities e full join (select distinct entity_id as id from entity_embeddings) v on v.id = e.id union all select 'chunk', k.id, kv.id from k full join kv on kv.id = k.id)
 select target, count(r) as total, count(*) filter (v is null) as missing, count(*) filter (r is null) as orphans, round((count(r) - count(*) filter (v is null)) * 100.0 / count(r), 6) as coverage_pct from s group by target"""
)
def embedding_status(c):
    return vector.status(c.memories, c.memory_embeddings, c.entities, c.entity_embeddings, *_chunks(c))


@plan(
    """with m as (select * from memories where namespace = 'global'), live as (select * from m where deleted_at is null), b as (select distinct memory_id, entity_id from memory_entities),
 p as (select distinct x.entity_id as a, y.entity_id as b from b x join b y on x.memory_id = y.memory_id and x.entity_id < y.entity_id)
 select 'MemoryBindings' as operation, count(*) as backlog from live where id not in (select memory_id from b)
 union all select 'EntityDescriptions', count(*) from entities union all select 'BodyEnrich', count(*) from live where length(coalesce(body, '')) < 500
 union all select 'ReEmbed', (select count(*) from live where id not in (select memory_id from memory_embeddings where len(embedding) = 64)) + (select count(*) from entities where id not in (select entity_id from entity_embeddings where len(embedding) = 64))
 union all select 'WeightCalibrate', count(*) from relationships where weight >= 0.7 union all select 'RelationReclassify', count(*) from relationships where relation = 'applies_to'
 union all select 'EntityConnect', count(*) from p where not exists (select 1 from relationships where least(source_id, target_id) = a and greatest(source_id, target_id) = p.b)
 union all select 'EntityTypeValidate', count(*) from entities union all select 'DescriptionEnrich', count(*) from live where description ilike '%ingested%' or description ilike '%imported%' or description ilike '%added%' or length(description) < 30
 union all select 'BodyExtract', count(*) from live"""
)
def backlog_all(c):
    return backlog.all_counts("global", c.memories, c.memory_entities, c.memory_embeddings, c.entities, c.entity_embeddings, c.relationships, 64)


# Reads and walks.


@plan("select m.id, m.name, cast(coalesce((select max(version) from memory_versions v where v.memory_id = m.id), 1) as bigint) as version from memories m where id = 9")
def read_version(c):
    return graph.memory_context(c.memories.where("id = 9"), c.memory_versions, c.memory_entities, c.entities, c.relationships)[0].select("id", "name", "version")


@plan("select id, name, type from entities where id in (select entity_id from memory_entities where memory_id = 9)")
def read_entities(c):
    return graph.memory_context(c.memories.where("id = 9"), c.memory_versions, c.memory_entities, c.entities, c.relationships)[1].select("id", "name", "type")


@plan("select s.name as source, t.name as target, relation, weight from relationships r join entities s on s.id = source_id join entities t on t.id = target_id where source_id in (select entity_id from memory_entities where memory_id = 9) or target_id in (select entity_id from memory_entities where memory_id = 9)")
def read_edges(c):
    return graph.memory_context(c.memories.where("id = 9"), c.memory_versions, c.memory_entities, c.entities, c.relationships)[2]


_ARRIVED = "st as (select source_id as f, target_id as t, weight from relationships union all select target_id, source_id, weight from relationships), arr as (select r.id, r.hop, arg_min(st.weight, (st.f, -st.weight)) as weight from reach r join st on st.t = r.id join reach p on p.id = st.f and p.hop = r.hop - 1 where r.hop > 0 group by all)"


@plan(
    f"with {_walk('select cast(2000003 as bigint), 0', 2, 0.0, True)}, {_ARRIVED}, bm as (select memory_id, min((arr.hop, -arr.weight)) as m from memory_entities join arr on entity_id = arr.id group by memory_id) select bm.memory_id as id, name, cast(m[1] as bigint) as hop, round(-m[2], 6) as weight from bm join memories on memories.id = memory_id where deleted_at is null"
)
def related_entity(c):
    """All memories near an entity, in either direction."""
    none, seed = c.memories.where("false").select("id"), c.entities.where("id = 2000003").select("id")
    return graph.related(c.relationships, c.memory_entities, c.memories, none, limit=1 << 30, entity_seeds=seed)


_NEAR_ENTITIES = f"(select entity_id from (select entity_id, {_COS} as s from entity_embeddings where len(embedding) = 64) order by s desc, entity_id limit 5)"


def _expanded(first: str) -> str:
    """The memories that the graph reaches from those of ``first`` (name d0) and from the entities nearest to the query."""
    seeds = f"select distinct entity_id, 0 from (select entity_id from memory_entities where memory_id in (select id from d0) union all {_NEAR_ENTITIES})"
    body = _walk(seeds, 2, 0.3).removeprefix("recursive ")
    return f"with recursive {first}, {body}, hit as (select memory_id as id, min(hop) as hop from memory_entities join reach on entity_id = reach.id where hop > 0 group by memory_id)"


@plan(_expanded(_fused(10).removeprefix("with ") + ", d0 as (select id from fu)") + " select h.id, m.name, cast(h.hop as bigint) as hop, round(1 - 1.0 / (h.hop + 1), 6) as distance, 'graph' as source from hit h join memories m on m.id = h.id where m.deleted_at is null and h.id not in (select id from d0)")
def hybrid_graph(c):
    """What the graph reaches from hybrid hits and from the entities nearest to the query."""
    return search.hybrid_expanded(c.memories, c.memory_embeddings, c.relationships, c.memory_entities, query_vector(c), QUERY, 10, c.entity_embeddings)[1]


@plan(
    _expanded(f"d0 as (select id, distance from ({_LIVE_KNN}) order by distance, id limit 10)")
    + ", un as (select d0.id, round(distance, 6) as distance, cast(null as bigint) as hop, 'direct' as source from d0 union all select id, round(1 - 1.0 / (hop + 1), 6), hop, 'graph' from hit where id not in (select id from d0)) select un.id, m.name, un.distance, un.hop, un.source, round(greatest(0, least(1, 1 - un.distance)), 6) as score from un join memories m on m.id = un.id where m.deleted_at is null"
)
def recall_entities(c):
    """Recall whose walk begins at the entities nearest to the query, too."""
    return search.recall(c.memories, c.memory_embeddings, c.relationships, c.memory_entities, query_vector(c), 10, entity_embeddings=c.entity_embeddings)


@plan(_fused(40).replace("1.0::double / (60 + vec_rank)", "0.3::double / (60 + vec_rank)").replace("1.0::double / (60 + fts_rank)", "1.7::double / (60 + fts_rank)") + " select f.id, m.name, round(score, 9) as score, round(score / (2.0::double / 61), 9) as normalized_score, vec_rank, fts_rank, case when vec_rank is not null and fts_rank is not null then 'hybrid' when vec_rank is not null then 'knn' else 'fts' end as source, substr(m.body, 1, 300) as snippet from (select * from fu order by score desc, id limit 10) f join memories m on m.id = f.id")
def hybrid_weighted(c):
    return search.hybrid(c.memories, c.memory_embeddings, query_vector(c), QUERY, 10, weight_vec=0.3, weight_fts=1.7)


def _chain(seed: int) -> str:
    """Evidence paths from an entity, by the rule of ``chains``."""
    return f"""(with recursive st as (select source_id as f, target_id as t, weight from relationships where weight >= 0.3), w(id, hop, path, product) as (select cast({seed} as bigint), 0, [cast({seed} as bigint)], 1.0::double union all select * from (select t, hop + 1, list_append(path, t), product * weight from w join st on st.f = w.id where hop < 3 and not list_contains(path, t))),
 first as (select id, min(hop) as hop from w group by id), lvl as (select w.id, w.hop, w.path, w.product, row_number() over (partition by w.id order by list_reverse(path)) as n from w join first using (id, hop) where not exists (select 1 from range(2, len(w.path)) p(i) join first f2 on f2.id = w.path[p.i] where f2.hop <> p.i - 1)) select path[1] as from_id, id as to_id, path, round(product, 6) as product from lvl where n = 1 and hop >= 2)"""


def _parts(c):
    steps = graph.neighbours(c.relationships, floor=0.3)
    out = None
    for i, seed in enumerate((2000003, 2000007, 2000003)):
        part = graph.chains(graph.walk(steps, c.entities.where(F.col("id") == seed), 3), None).withColumn("part", F.lit(i))
        # The third asks for the first one's pairs again, by lighter chains.
        part = part.withColumn("product", F.col("product") / 2) if i == 2 else part
        out = part if out is None else out.unionByName(part)
    return out


@plan(f"select from_id, to_id, cast(len(path) as bigint) as n, product from {_chain(2000003)} union all select from_id, to_id, len(path), product from {_chain(2000007)}")
def chains_merged(c):
    """Chains of three parts of a question, of which one asks again for what the first has."""
    return search.merge_chains(_parts(c)).select("from_id", "to_id", F.size("path").cast("bigint").alias("n"), "product")


@plan(f"select from_id, to_id, product from {_chain(2000003)} order by product desc, to_id limit 20")
def chains_top(c):
    walked = graph.walk(graph.neighbours(c.relationships, floor=0.3), c.entities.where("id = 2000003"), 3)
    return graph.chains(walked).select("from_id", "to_id", "product")


# Maintenance.


@plan("select memory_id, entity_id from memory_entities where entity_id <> (select id from entities where name = 'nation-3' and namespace = 'global')")
def prune_links(c):
    return maintain.prune_links(c.memory_entities, c.entities, "global", "nation-3")[0]


@plan("select count(*) as removed from memory_entities where entity_id in (select id from entities where namespace = 'global')")
def prune_all_links(c):
    return maintain.prune_links(c.memory_entities, c.entities, "global")[1]


@plan("select id, case when type = 'location' and name in ('nation-3', 'nation-4', 'part-1') then 'date' else type end as type, case when type = 'location' and name in ('nation-3', 'nation-4', 'part-1') then 'moved' else 'was ' || name end as description from entities")
def reclassify_described(c):
    entities = c.entities.withColumn("description", F.concat(F.lit("was "), "name"))
    return maintain.reclassify(entities, "location", "date", ["nation-3", "nation-4", "part-1"], "moved").select("id", "type", "description")


@plan("select id, version, latest from (select memory_id as id, cast(version as bigint) as version, version = max(version) over (partition by memory_id) as latest from memory_versions)")
def version_marks(c):
    """Every version, and whether it is its memory's last."""
    top = scans.next_versions(c.memory_versions).select(F.col("memory_id").alias("id"), (F.col("next_version") - 1).alias("top"))
    return c.memory_versions.select(F.col("memory_id").alias("id"), F.col("version").cast("bigint").alias("version")).join(top, "id").select("id", "version", (F.col("version") == F.col("top")).alias("latest"))


# Research: two parts, each a hybrid search and what the graph reaches from its hits.


def _research() -> str:
    out = []
    for i, (terms, how) in enumerate(((["ther", "than"], "and"), (["thorre", "the"], "or"))):
        bm = _bm25(terms, how, 20).removeprefix("with ")
        for name in ("dt", "ct", "tot", "bm"):
            bm = re.sub(rf"\b{name}\b", f"{name}{i}", bm)
        walk = _walk(f"select distinct entity_id, 0 from memory_entities where memory_id in (select id from fu{i})", 2, 0.3, name=f"w{i}").removeprefix("recursive ").replace("reach as", f"reach{i} as")
        out.append(
            f"""{bm}, fr{i} as (select id, row_number() over (order by score desc, id) as fts_rank from bm{i}),
 fu{i} as (select coalesce(kn.id, fr{i}.id) as id, coalesce(1.0::double / (60 + vec_rank), 0) + coalesce(1.0::double / (60 + fts_rank), 0) as score, case when vec_rank is not null and fts_rank is not null then 'hybrid' when vec_rank is not null then 'knn' else 'fts' end as source from kn full join fr{i} on kn.id = fr{i}.id order by score desc, coalesce(kn.id, fr{i}.id) limit 10),
 {walk}, hit{i} as (select memory_id as id, min(hop) as hop from memory_entities join reach{i} on entity_id = reach{i}.id where hop > 0 group by memory_id),
 part{i} as (select id, {i} as part, round(score / (2.0::double / 61), 9) as score, source from fu{i} union all select h.id, {i}, (select avg(round(score / (2.0::double / 61), 9)) from fu{i}) * power(0.7, hop), 'graph' from hit{i} h join memories m on m.id = h.id where m.deleted_at is null and h.id not in (select id from fu{i}))"""
        )
    knn = f"kn as (select id, row_number() over (order by distance, id) as vec_rank from ({_LIVE_KNN} order by distance, m.id limit 20))"
    return f"with recursive {knn}, {', '.join(out)}, al as (select * from part0 union all select * from part1), b as (select id, arg_min(source, (-score, part)) as source, max(score) as score, list_sort(list(distinct part)) as sub_queries from al group by id) select id, round(score, 6) as score, source, sub_queries from b order by round(score, 6) desc, id limit 50"


@plan(_research())
def research_merge(c):
    """A question of two parts: the best of both parts' hits and of what the graph reaches from them."""
    v = query_vector(c)
    return search.research(c.memories, c.memory_embeddings, c.relationships, c.memory_entities, [(q, v) for q, _ in search.decompose("ther than; thorre-the")], 10)
