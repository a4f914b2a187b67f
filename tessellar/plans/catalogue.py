"""The registered queries: each a plan over the derived tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.corpus import Corpus, with_tables
from tessellar.functions import text as X
from tessellar.operators import backlog, chunking, fulltext, fusion, graph, maintain, queue, resolve, scans, search, shape, vector

_PLANS: dict[str, Callable[[Corpus], DataFrame]] = {}
_SQL: dict[str, str] = {}


def plan(sql: str | None = None):
    """Register a plan under its function's name with ``q_`` before it."""

    def keep(f: Callable[[Corpus], DataFrame]):
        _PLANS[f"q_{f.__name__}"] = f
        if sql is not None:
            _SQL[f"q_{f.__name__}"] = with_tables(sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))) for name, f in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query_vector(c: Corpus) -> list[float]:
    """The vector that search queries ask for: that of row 0."""
    return [float(x) for x in c.embeddings.where("vec_id = 0").select("embedding").first()[0]]


QUERY, NOW = "ther than", 1710000500
_QV = "(select embedding::double[] from embeddings where vec_id = 0)"
_COS = f"list_cosine_similarity(embedding::double[], {_QV})"
_LIVE_KNN = f"select m.id, 1 - {_COS} as distance from memory_embeddings e join memories m on m.id = e.memory_id where m.deleted_at is null and len(embedding) = len({_QV})"

# Scans and totals.


@plan("select id, name, type, description, substr(body, 1, 200) as snippet, cast(strlen(body) as bigint) as body_length, updated_at, deleted_at is not null as is_deleted from memories where namespace = 'global' and type = 'note' and deleted_at is null order by updated_at desc, id limit 20 offset 10")
def list_live_page(c):
    return scans.list_memories(c.memories, "global", "note", 20, 10)


@plan("select id, name, type, description, substr(body, 1, 200) as snippet, cast(strlen(body) as bigint) as body_length, updated_at, deleted_at is not null as is_deleted from memories where namespace = 'archive'")
def list_with_deleted(c):
    return scans.list_memories(c.memories, "archive", None, -1, 0, True)


@plan("select count(*) as n from memories where namespace = 'global' and type = 'skill' and deleted_at is null")
def count_scan(c):
    return scans.count_memories(c.memories, "global", "skill")


@plan("select id, name, updated_at from memories where id > 100 order by id limit 25")
def keyset_page(c):
    return scans.keyset_page(c.memories.select("id", "name", "updated_at"), 100, 25)


@plan("select id, name, body from memories where namespace = 'global' and name = 'doc-7' and deleted_at is null")
def read_by_name(c):
    return scans.by_name(c.memories, "global", "doc-7").select("id", "name", "body")


@plan("select id, name from memories where deleted_at is null and id in (1, 2, 17, 34, 40)")
def read_by_ids(c):
    ids = c.memories.where(F.col("id").isin(1, 2, 17, 34, 40)).select("id")
    return scans.by_ids(c.memories, ids).select("id", "name")


@plan("select id, deleted_at is not null as is_deleted from memories where namespace = 'global' and name = 'doc-17'")
def any_state(c):
    return scans.any_state(c.memories, "global", "doc-17")


@plan("select m.id, m.namespace, m.name, m.updated_at, cast(coalesce(max(v.version), 0) as bigint) as version from memories m left join memory_versions v on v.memory_id = m.id where m.deleted_at is null group by all")
def current_versions(c):
    return scans.with_current_version(c.memories, c.memory_versions)


@plan("with h as (select id, namespace, sha256(body) as body_hash from memories where deleted_at is null), g as (select namespace, body_hash, min(id) as first_id, count(*) as copies from h group by all having count(*) > 1) select h.id, h.namespace, h.body_hash, g.first_id, g.copies from h join g using (namespace, body_hash)")
def dup_hash(c):
    return scans.duplicate_bodies(c.memories)


@plan("select count(*) filter (deleted_at is null) as live, count(*) filter (deleted_at is not null) as deleted, count(distinct namespace) as namespaces, round(coalesce(avg(length(body)) filter (deleted_at is null), 0), 6) as avg_body_len, (select count(*) from memory_versions) as versions, (select count(*) from entities) as entities, (select count(*) from relationships) as relationships from memories")
def stats_overview(c):
    return scans.stats(c.memories, c.memory_versions, c.entities, c.relationships)


@plan("select distinct namespace from memories order by namespace")
def namespaces(c):
    return scans.namespaces(c.memories)


@plan("select namespace, type, count(*) as n from memories where deleted_at is null group by all")
def type_histogram(c):
    return scans.type_histogram(c.memories)


@plan(
    "with s as (select *, cast(strlen(body) as bigint) as size, coalesce(lag(cast(strlen(body) as bigint)) over (partition by memory_id order by version), 0) as was from memory_versions) select memory_id, cast(version as bigint) as version, case change_reason when 'create' then 'created' when 'edit' then 'edited' when 'restore' then 'restored' else change_reason end as action, greatest(size - was, 0) as added, greatest(was - size, 0) as removed, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' as created_at_iso from s"
)
def history_diff(c):
    return scans.history(c.memory_versions)


@plan("select memory_id, cast(coalesce(max(version), 0) + 1 as bigint) as next_version, cast(max(version) filter (change_reason <> 'restore') as bigint) as latest_edit from memory_versions group by memory_id")
def version_latest(c):
    return scans.next_versions(c.memory_versions)


@plan("select memory_id, cast(max(version) as bigint) as version, arg_max(body, version) as body from memory_versions where change_reason <> 'restore' group by memory_id")
def restore_bodies(c):
    return scans.latest_bodies(c.memory_versions)


@plan(f"select count(*) as n, cast(coalesce(sum(length(body) + length(description) + length(name)), 0) as bigint) as chars, min(deleted_at) as oldest from memories where deleted_at <= {NOW} - 0 * 86400")
def purge_metrics(c):
    return scans.purge_metrics(c.memories, NOW, 0)


@plan(f"select id, deleted_at from memories where deleted_at < {NOW}")
def retention(c):
    return scans.deleted_before(c.memories, NOW).select("id", "deleted_at")


# Vectors.


@plan(f"select id, round(distance, 6) as distance from ({_LIVE_KNN}) order by distance, id limit 20")
def knn_memory(c):
    near = vector.memory_knn(c.memory_embeddings, c.memories, query_vector(c), 20)
    return near.select("id", F.round("distance", 6).alias("distance"))


@plan(f"with near as (select m.id, m.deleted_at, 1 - {_COS} as distance from memory_embeddings e join memories m on m.id = e.memory_id order by distance, m.id limit 20) select id, round(distance, 6) as distance from near where deleted_at is null")
def knn_live_after_cut(c):
    near = vector.memory_knn(c.memory_embeddings, c.memories, query_vector(c), 20, live_after_k=True)
    return near.select("id", F.round("distance", 6).alias("distance"))


@plan(f"select entity_id, round({_COS}, 6) as similarity from entity_embeddings order by {_COS} desc, entity_id limit 5")
def knn_entity(c):
    return vector.entity_knn(c.entity_embeddings, query_vector(c)).select("entity_id", F.round("similarity", 6).alias("similarity"))


@plan(f"select memory_id, 0 as chunk_idx, round({_COS}, 6) as similarity from memory_embeddings order by {_COS} desc, memory_id limit 10")
def knn_chunk(c):
    return vector.chunk_knn(c.memory_embeddings, query_vector(c), 10).select("memory_id", "chunk_idx", F.round("similarity", 6).alias("similarity"))


@plan("with p as (select label, unnest(embedding::double[]) as v, unnest(range(len(embedding))) as pos from memory_embeddings), m as (select label, pos, avg(v) as v from p group by all), n as (select label, sqrt(sum(v * v)) as norm from m group by label) select label, cast(pos as int) as pos, round(v / norm, 6) as v from m join n using (label)")
def mean_pool(c):
    pooled = vector.mean_pool(c.memory_embeddings, "label")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("v"))


@plan("select len(embedding) as dim, count(*) as n from memory_embeddings group by all")
def vector_dims(c):
    return vector.dims(c.memory_embeddings).select(F.col("dim").cast("bigint").alias("dim"), "n")


@plan("select memory_id, label from memory_embeddings e where not exists (select 1 from memories m where m.id = e.memory_id and deleted_at is null)")
def orphan_vectors(c):
    return vector.orphans(c.memory_embeddings, c.memories).select("memory_id", "label")


@plan("select id, name from memories m where deleted_at is null and not exists (select 1 from memory_embeddings e where e.memory_id = m.id and len(embedding) = 64)")
def missing_vectors(c):
    return vector.missing(c.memory_embeddings, c.memories, 64).select("id", "name")


@plan(
    "with t as (select count(*) as total, count(*) filter (not exists (select 1 from memory_embeddings e where e.memory_id = m.id and len(embedding) = 64)) as missing from memories m where deleted_at is null), o as (select count(*) as orphans from memory_embeddings e where not exists (select 1 from memories m where m.id = e.memory_id and deleted_at is null)) select total, missing, orphans, round((total - missing) * 100.0 / total, 6) as coverage_pct from t, o"
)
def coverage(c):
    return vector.coverage(c.memory_embeddings, c.memories, 64)


@plan("select memory_id, list_transform(embedding[1:8], lambda x: round(x::double, 6)) as head from memory_embeddings")
def mrl_truncate(c):
    # Spark's round drops the sign of what rounds to zero.
    rounded = lambda x: F.signum(x.cast("double")) * F.round(F.abs(x.cast("double")), 6)
    return c.memory_embeddings.select("memory_id", F.transform(vector.truncated(F.col("embedding"), 8), rounded).alias("head"))


# Full text and fusion.

_TOKS = "list_filter(regexp_split_to_array(lower(strip_accents(concat_ws(' ', name, description, body))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _bm25(terms: list[str], how: str, limit: int) -> str:
    tf = ", ".join(f"cast(len(list_filter(toks, lambda w: starts_with(w, '{t}'))) as double) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"cast(count(*) filter (tf{i} > 0) as double) as df{i}" for i in range(len(terms)))
    part = " + ".join(f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    cond = f" {how} ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""with dt as (select id, {_TOKS} as toks from memories where deleted_at is null), ct as (select id, cast(len(toks) as double) as dl, {tf} from dt),
 tot as (select cast(count(*) as double) as n, avg(dl) as avgdl, {df} from ct), bm as (select id, {part} as score from ct, tot where {cond} order by score desc, id limit {limit})"""


@plan(_bm25(["ther", "than"], "and", 25) + " select id, round(score, 6) as score from bm")
def bm25(c):
    return fulltext.bm25(c.memories, QUERY, 25).select("id", F.round("score", 6).alias("score"))


@plan(_bm25(["thorre", "the"], "or", 25) + " select id, round(score, 6) as score from bm")
def bm25_alternatives(c):
    return fulltext.bm25(c.memories, "thorre-the", 25).select("id", F.round("score", 6).alias("score"))


@plan(_bm25(["ther", "than"], "and", 20) + " select id, row_number() over (order by score desc, id) as rank, round(1 - 1.0 / (row_number() over (order by score desc, id)), 6) as distance, 'fts_fallback' as source from bm")
def fts_fallback(c):
    return search.fts_fallback(c.memories, QUERY, 20)


@plan(f"with t as (select id, unnest({_TOKS}) as term from memories where deleted_at is null), p as (select term, id, count(*) as tf from t group by all) select term, count(*) as documents, cast(sum(tf) as bigint) as tokens from p group by term order by documents desc, term limit 40")
def fts_top_terms(c):
    return fulltext.top_terms(fulltext.postings(c.memories), 40)


@plan(f"with t as (select id, unnest({_TOKS}) as term from memories where deleted_at is null) select count(distinct term) as terms, count(distinct id) as documents, count(*) as tokens from t")
def fts_stats(c):
    return fulltext.index_stats(fulltext.postings(c.memories))


_KNN20 = f"kn as (select id, row_number() over (order by distance, id) as vec_rank from ({_LIVE_KNN} order by distance, m.id limit 20))"


def _fused(k: int) -> str:
    return (
        _bm25(["ther", "than"], "and", 20)
        + f", {_KNN20}, fr as (select id, row_number() over (order by score desc, id) as fts_rank from bm), fu as (select coalesce(kn.id, fr.id) as id, vec_rank, fts_rank, coalesce(1.0::double / (60 + vec_rank), 0) + coalesce(1.0::double / (60 + fts_rank), 0) as score from kn full join fr on kn.id = fr.id order by score desc, coalesce(kn.id, fr.id) limit {k})"
    )


@plan(
    _fused(10)
    + " select f.id, m.name, round(score, 9) as score, round(score / (2.0::double / 61), 9) as normalized_score, vec_rank, fts_rank, case when vec_rank is not null and fts_rank is not null then 'hybrid' when vec_rank is not null then 'knn' else 'fts' end as source, substr(m.body, 1, 300) as snippet from fu f join memories m on m.id = f.id"
)
def hybrid_rrf(c):
    return search.hybrid(c.memories, c.memory_embeddings, query_vector(c), QUERY, 10)


@plan(_fused(40) + " select id, round(score, 9) as score from fu")
def rrf_lists(c):
    near = fusion.ranked(vector.memory_knn(c.memory_embeddings, c.memories, query_vector(c), 20), "distance", "id").select("id", "rank")
    found = fusion.ranked(fulltext.bm25(c.memories, QUERY, 20), F.desc("score"), "id").select("id", "rank")
    fused = fusion.fuse_lists(near.unionByName(found).withColumn("weight", F.lit(1.0)))
    return fused.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(40)


# Graph.

_ENDS = "ends as (select source_id as id, * from relationships union all select target_id as id, * from relationships where target_id <> source_id), deg as (select id, count(*) as degree from ends group by id)"


def _walk(seeds: str, hops: int, floor: float = 0.0, both: bool = False, name: str = "w") -> str:
    step = f"select source_id as f, target_id as t from relationships where weight >= {floor}" + (f" union all select target_id, source_id from relationships where weight >= {floor}" if both else "")
    return f"recursive {name}(id, hop) as ({seeds} union select s.t, {name}.hop + 1 from {name} join ({step}) s on s.f = {name}.id where {name}.hop < {hops}), reach as (select id, min(hop) as hop from {name} group by id)"


@plan(f"with {_ENDS} select e.id, e.namespace, e.name, e.type, coalesce(degree, 0) as degree from entities e left join deg using (id) order by degree desc, e.id limit 50")
def degree(c):
    return graph.list_entities(c.entities, c.relationships)


@plan("with ends as (select source_id as id from relationships union all select target_id from relationships where target_id <> source_id), d as (select id, count(*) as n from ends group by id) select (select count(*) from entities) as nodes, (select count(*) from relationships) as edges, (select max(n) from d) as max_degree, round(2.0 * (select count(*) from relationships) / (select count(*) from entities), 6) as avg_degree")
def graph_stats(c):
    return graph.stats(c.entities, c.relationships)


@plan(f"with {_ENDS} select (select count(*) from deg where degree > 50) as hubs, id, name, degree from deg join entities using (id) where degree > 50 order by degree desc, id limit 5")
def super_hubs(c):
    return graph.super_hubs(c.entities, c.relationships)


@plan("select relation, count(*) as n, round(count(*) * 1.0 / (select count(*) from relationships), 6) as ratio from relationships group by relation")
def top_relation(c):
    return graph.relation_ratios(c.relationships)


@plan("with r as (select relation, round(count(*) * 1.0 / (select count(*) from relationships), 6) as ratio from relationships group by relation order by count(*) desc, relation limit 1) select round(avg((relation = 'mentions')::int::double), 6) as mentions_ratio, round(avg((relation = 'applies_to')::int::double), 6) as applies_to_ratio, (select relation from r) as top_relation, (select ratio from r) as top_ratio, avg((relation = 'mentions')::int) > 0.5 as mentions_warning, (select ratio from r) > 0.4 as top_relation_warning from relationships")
def graph_health(c):
    return graph.health(c.relationships)


@plan("select id, name, type from entities e where not exists (select 1 from relationships r where r.source_id = e.id or r.target_id = e.id) and not exists (select 1 from memory_entities b where b.entity_id = e.id)")
def orphans(c):
    return graph.orphans(c.entities, c.relationships, c.memory_entities).select("id", "name", "type")


@plan(f"with {_walk('select cast(2000003 as bigint), 0', 3, 0.3)} select id, cast(hop as bigint) as hop from reach")
def bfs_hops(c):
    seeds = c.entities.where("id = 2000003")
    return graph.hops(graph.neighbours(c.relationships, floor=0.3), seeds, 3)


_SEEDED = "select distinct entity_id, 0 from memory_entities where memory_id = 9"


@plan(f"with {_walk(_SEEDED, 2, 0.3)}, hit as (select memory_id as id, min(hop) as hop from memory_entities join reach on entity_id = reach.id where hop > 0 group by memory_id) select h.id, cast(h.hop as bigint) as hop, m.name, round(1 - 1.0 / (h.hop + 1), 6) as distance from hit h join memories m on m.id = h.id where m.deleted_at is null and h.id <> 9")
def recall_graph(c):
    seeds = c.memories.where("id = 9").select("id")
    return search.expand(c.relationships, c.memory_entities, c.memories, seeds, 2, 0.3, None).select("id", "hop", "name", "distance")


@plan(
    f"with {_walk('select distinct entity_id, 0 from memory_entities where memory_id in (select id from d0)', 2, 0.3).replace('recursive ', f'recursive d0 as (select id, distance from ({_LIVE_KNN}) order by distance, id limit 10), ')}, hit as (select memory_id as id, min(hop) as hop from memory_entities join reach on entity_id = reach.id where hop > 0 group by memory_id), un as (select d0.id, round(distance, 6) as distance, cast(null as bigint) as hop, 'direct' as source from d0 union all select id, round(1 - 1.0 / (hop + 1), 6), hop, 'graph' from hit where id not in (select id from d0)) select un.id, m.name, un.distance, un.hop, un.source, round(greatest(0, least(1, 1 - un.distance)), 6) as score from un join memories m on m.id = un.id where m.deleted_at is null"
)
def recall(c):
    return search.recall(c.memories, c.memory_embeddings, c.relationships, c.memory_entities, query_vector(c), 10)


@plan(
    f"with {_walk(_SEEDED, 2, 0.0, True)}, st as (select source_id as f, target_id as t, weight from relationships union all select target_id, source_id, weight from relationships), arr as (select r.id, r.hop, arg_min(st.weight, (st.f, -st.weight)) as weight from reach r join st on st.t = r.id join reach p on p.id = st.f and p.hop = r.hop - 1 where r.hop > 0 group by all), bm as (select memory_id, min((arr.hop, -arr.weight)) as m from memory_entities join arr on entity_id = arr.id group by memory_id) select bm.memory_id as id, name, cast(m[1] as bigint) as hop, round(-m[2], 6) as weight from bm join memories on memories.id = memory_id where deleted_at is null and memory_id <> 9 order by hop, weight desc, id limit 10"
)
def related(c):
    return graph.related(c.relationships, c.memory_entities, c.memories, c.memories.where("id = 9").select("id"))


@plan("with st as (select source_id as f, target_id as t, relation, weight from relationships union all select target_id, source_id, relation, weight from relationships), n0 as (select cast(1000001 as bigint) as id, 0 as hop), n1 as (select id, min(hop) as hop from (select * from n0 union all select t, 1 from st where f = 1000001) group by id) select f as from_id, t as to_id, relation, weight, n1.hop + 1 as hop from st join n1 on n1.id = f")
def traverse_edges(c):
    steps = graph.neighbours(c.relationships, bidirectional=True)
    return graph.observed_edges(steps, c.entities.where("id = 1000001"), 2).select("from_id", "to_id", "relation", "weight", F.col("hop").cast("int").alias("hop"))


@plan(
    "with recursive st as (select source_id as f, target_id as t, weight from relationships where weight >= 0.3), w(id, hop, path, product) as (select cast(2000003 as bigint), 0, [cast(2000003 as bigint)], 1.0::double union all select * from (select t, hop + 1, list_append(path, t), product * weight from w join st on st.f = w.id where hop < 3 and not list_contains(path, t))), first as (select id, min(hop) as hop from w group by id), lvl as (select w.id, w.hop, w.path, w.product, row_number() over (partition by w.id order by list_reverse(path)) as n from w join first using (id, hop) where not exists (select 1 from range(2, len(w.path)) p(i) join first f2 on f2.id = w.path[p.i] where f2.hop <> p.i - 1)) select path[1] as from_id, id as to_id, hop, round(product, 6) as product from lvl where n = 1 and hop >= 2"
)
def chains(c):
    walked = graph.walk(graph.neighbours(c.relationships, floor=0.3), c.entities.where("id = 2000003"), 3)
    return graph.chains(walked, None).select("from_id", "to_id", (F.size("path") - 1).alias("hop"), "product")


@plan("with x as (select a.entity_id as a, b.entity_id as b, count(*) as n from memory_entities a join memory_entities b on a.memory_id = b.memory_id and a.entity_id < b.entity_id group by all) select a, b, n from x where not exists (select 1 from relationships r where least(source_id, target_id) = a and greatest(source_id, target_id) = b) order by n desc, a, b limit 50")
def cooccurrence_pairs(c):
    return graph.cooccurrence(c.memory_entities, c.relationships)


@plan(f"with {_ENDS}, hub as (select id, row_number() over (order by degree desc, id) as h from deg order by h limit 32), isl as (select id from entities where id not in (select id from deg) and id in (select entity_id from memory_entities) order by id limit 500) select least(hub.id, isl.id) as a, greatest(hub.id, isl.id) as b from hub, isl order by h, isl.id limit 50")
def hub_island_pairs(c):
    return graph.hub_island(c.entities, c.relationships, c.memory_entities)


@plan("select distinct name from entities where id in (select source_id from relationships where relation = 'follows' union select target_id from relationships where relation = 'follows') order by name")
def entities_by_relation(c):
    return graph.entities_by_relation(c.entities, c.relationships, "follows")


@plan(f"with {_ENDS}, x as (select e.id, e.id % 7 as old, coalesce(degree, 0) as new from entities e left join deg using (id)) select count(*) filter (old <> new and new > 0) as updated, count(*) filter (old <> new and new = 0) as zeroed, count(*) filter (old = new) as unchanged from x")
def recompute_degrees(c):
    return graph.recompute_degrees(c.entities.select("id", (F.col("id") % 7).alias("degree")), c.relationships)


@plan("select b.memory_id, e.id, e.name from memory_entities b join entities e on e.id = b.entity_id where b.memory_id = 9")
def memory_entities_listing(c):
    return maintain.memory_entities(c.memory_entities, c.entities, 9).select(F.lit(9).cast("bigint").alias("memory_id"), "id", "name")


@plan("select m.id, m.name from memory_entities b join memories m on m.id = b.memory_id where b.entity_id = 2000004 and m.deleted_at is null")
def entity_memories_listing(c):
    return maintain.entity_memories(c.memory_entities, c.memories, 2000004).select("id", "name")


# Maintenance.


@plan("with mv as (select namespace, case when source_id in (2000001, 2000002) then 2000000 else source_id end as source_id, case when target_id in (2000001, 2000002) then 2000000 else target_id end as target_id, relation, weight from relationships) select namespace, source_id, target_id, relation, max(weight) as weight from mv where source_id <> target_id group by all")
def merge_entities(c):
    return maintain.merge_entities(c.entities, c.relationships, c.memory_entities, [2000001, 2000002], 2000000)[1]


@plan("with n as (select id, namespace, replace(upper(name), '-', ' ') as name from entities union all select id + 9000000, namespace, name from entities where type = 'location'), k as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as new_name from n) select id, name, new_name, min(id) over w as survivor, case when id <> min(id) over w then 'merge' when name <> new_name then 'rename' else 'keep' end as action from k window w as (partition by namespace, new_name)")
def normalize_preview(c):
    loud = c.entities.select("id", "namespace", F.replace(F.upper("name"), F.lit("-"), F.lit(" ")).alias("name"))
    again = c.entities.where("type = 'location'").select((F.col("id") + 9000000).alias("id"), "namespace", "name")
    return maintain.normalize_entities(loud.unionByName(again))


@plan("with k as (select r.*, s.type as st from relationships r left join entities s on s.id = source_id), ch as (select namespace, source_id, target_id, 'supports' as relation, weight from k where relation = 'related' and st = 'person') select namespace, source_id, target_id, relation, weight from k where not coalesce(relation = 'related' and st = 'person', false) union all select namespace, source_id, target_id, relation, max(weight) from ch group by all")
def reclassify_relation(c):
    return maintain.reclassify_relation(c.relationships, c.entities, "related", "supports", source_type="person")


@plan(f"select id, name from memories where deleted_at is null or deleted_at > {NOW}")
def purge(c):
    return maintain.purge(c.memories, NOW, 0)[0].select("id", "name")


@plan("select id, case when id in (1, 2, 3) and deleted_at is null then 1720000000 else deleted_at end as deleted_at from memories")
def forget(c):
    return maintain.forget(c.memories, c.memories.where("id in (1, 2, 3)"), 1720000000).select("id", "deleted_at")


@plan("select m.id, case when v.body is not null and m.deleted_at is not null then v.body else m.body end as body, case when m.deleted_at is not null and v.body is not null then null else m.deleted_at end as deleted_at from memories m left join (select memory_id, arg_max(body, version) as body from memory_versions where change_reason <> 'restore' group by memory_id) v on v.memory_id = m.id")
def restore(c):
    return maintain.restore(c.memories, c.memory_versions, c.memories.where("deleted_at is not null"), 1720000000).select("id", "body", "deleted_at")


@plan("with n as (select namespace, name, 'edited ' || name as body from memories where id < 5 union all select 'global', 'new-' || cast(id as varchar), 'fresh' from memories where id < 3) select coalesce(m.namespace, n.namespace) as namespace, coalesce(m.name, n.name) as name, coalesce(n.body, m.body) as body, case when n.name is null then 'unchanged' when m.name is null then 'inserted' else 'updated' end as action from memories m full join n on m.namespace = n.namespace and m.name = n.name")
def keyed_merge(c):
    new = c.memories.where("id < 5").select("namespace", "name", F.concat(F.lit("edited "), "name").alias("body"))
    new = new.unionByName(c.memories.where("id < 3").select(F.lit("global").alias("namespace"), F.concat(F.lit("new-"), F.col("id").cast("string")).alias("name"), F.lit("fresh").alias("body")))
    return maintain.merge_by_key(c.memories.select("namespace", "name", "body"), new, ["namespace", "name"], flag="action")


@plan("select namespace, source_id, target_id, relation, weight from relationships where relation <> 'follows'")
def prune_relation(c):
    return maintain.prune_relation(c.relationships, "follows")[0]


@plan("select id, name from entities e where exists (select 1 from relationships r where r.source_id = e.id or r.target_id = e.id) or exists (select 1 from memory_entities b where b.entity_id = e.id)")
def cleanup_orphans(c):
    return maintain.cleanup_orphans(c.entities, c.relationships, c.memory_entities).select("id", "name")


# Backlogs and the queue.


@plan("select id, name from memories m where deleted_at is null and not exists (select 1 from memory_entities b where b.memory_id = m.id)")
def unbound(c):
    return backlog.unbound_memories(c.memories, c.memory_entities).select("id", "name")


@plan("select id, length(body) as n from memories where deleted_at is null and length(coalesce(body, '')) < 500")
def short_bodies(c):
    return backlog.short_bodies(c.memories).select("id", F.length("body").cast("bigint").alias("n"))


@plan("select source_id, target_id, s.name as source_name, t.name as target_name, relation, weight from relationships join entities s on s.id = source_id join entities t on t.id = target_id where weight >= 0.7")
def heavy_edges(c):
    return backlog.heavy_edges(c.relationships, c.entities)


@plan("select source_id, target_id, s.name as source_name, t.name as target_name, relation, weight from relationships join entities s on s.id = source_id join entities t on t.id = target_id where relation = 'applies_to'")
def generic_edges(c):
    return backlog.generic_edges(c.relationships, c.entities)


@plan("select id, name from entities order by (id * 2654435761) % 2147483647, id limit 30")
def hash_sample(c):
    return backlog.hash_sample(c.entities, 30).select("id", "name")


@plan("select id from memories where deleted_at is null and (description ilike '%ingested%' or description ilike '%imported%' or description ilike '%added%' or length(description) < 30) order by (id * 2654435761) % 2147483647, id limit 50")
def generic_descriptions(c):
    return backlog.generic_descriptions(c.memories, 50).select("id")


@plan("select 'memory' as target, name as item_key from memories m where deleted_at is null and not exists (select 1 from memory_embeddings e where e.memory_id = m.id and len(embedding) = 64) union all select 'entity', 'entity:' || name from entities e where not exists (select 1 from entity_embeddings v where v.entity_id = e.id and len(embedding) = 64)")
def reembed_backlog(c):
    return backlog.reembed(c.memories, c.memory_embeddings, c.entities, c.entity_embeddings, 64)


@plan("select 'MemoryBindings' as operation, count(*) as backlog from memories m where deleted_at is null and not exists (select 1 from memory_entities b where b.memory_id = m.id) union all select 'BodyEnrich', count(*) from memories where deleted_at is null and length(coalesce(body, '')) < 500 union all select 'WeightCalibrate', count(*) from relationships where weight >= 0.7")
def backlog_counts(c):
    return backlog.counts(MemoryBindings=backlog.unbound_memories(c.memories, c.memory_entities), BodyEnrich=backlog.short_bodies(c.memories), WeightCalibrate=backlog.heavy_edges(c.relationships, c.entities))


@plan("with r as (select *, row_number() over (partition by namespace, operation order by priority desc, id) as n from queue where status = 'pending') select id, operation, attempt + 1 as attempt, 'processing' as status from r where n <= 32")
def queue_claim(c):
    return queue.claim(c.queue, 32, 1800000000).select("id", "operation", "attempt", "status")


@plan("with s as (select operation, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'done') as done, count(*) filter (status = 'dead') as dead from queue group by operation) select *, case when processing > 0 then 'draining' when pending > 0 then 'draining' when dead > 0 then 'blocked_dead' when done > 0 then 'pending-scan' else 'empty' end as state from s")
def queue_status(c):
    return queue.status(c.queue)


@plan("select id, case when status = 'processing' and (attempt >= 8 or id % 10 = 0) then 'dead' when status = 'processing' then 'pending' else status end as status from queue")
def dead_letter(c):
    failures = c.queue.where("status = 'processing'").select("id", F.lit("failed").alias("error"), (F.col("id") % 10 == 0).alias("hard"))
    return queue.fail(c.queue, failures, 1800000000).select("id", "status")


@plan("select id, case when status = 'processing' and claimed_at <= 1700020000 - 1800 then 'pending' else status end as status from queue")
def stale_reset(c):
    return queue.reset_stale(c.queue, 1700020000).select("id", "status")


@plan("select operation, count(*) as eligible, count(*) filter (priority > 0) as urgent from queue where status = 'pending' group by operation")
def queue_eligible(c):
    return queue.eligible_count(c.queue, 1800000000)


@plan("with g as (select operation, id as seq, status = 'dead' as hard, sum((status <> 'dead')::int) over (partition by operation order by id) as g from queue), r as (select *, sum(hard::int) over (partition by operation, g order by seq) as run from g) select operation, seq, run >= 2 as open from r")
def circuit_breaker(c):
    outcomes = c.queue.select("operation", F.col("id").alias("seq"), (F.col("status") == "dead").alias("hard"))
    return queue.breaker(outcomes, 2)


# Text.


@plan("with p as (select a.id, a.body as x, b.body as y from memories a join memories b on b.id = a.id + 1), t as (select id, case when length(x) = 0 then [] else list_distinct(list_transform(range(1, length(x) + 1), lambda i: substr(chr(1) || x || chr(1), i, 3))) end as tx, case when length(y) = 0 then [] else list_distinct(list_transform(range(1, length(y) + 1), lambda i: substr(chr(1) || y || chr(1), i, 3))) end as ty from p) select id, round(len(list_intersect(tx, ty)) * 1.0::double / len(list_distinct(list_concat(tx, ty))), 6) as similarity, round(len(list_intersect(tx, ty)) * 1.0::double / len(tx), 6) as coverage from t")
def trigram_jaccard(c):
    a = c.memories.select("id", F.col("body").alias("x"))
    b = c.memories.select((F.col("id") - 1).alias("id"), F.col("body").alias("y"))
    # A set is made once for both measures.
    sets = a.join(b, "id").select("id", X.trigrams(F.col("x")).alias("x"), X.trigrams(F.col("y")).alias("y"))
    return sets.select("id", F.round(X.set_jaccard(F.col("x"), F.col("y")), 6).alias("similarity"), F.round(X.set_coverage(F.col("x"), F.col("y")), 6).alias("coverage"))


@plan("with t as (select page_id, 'see (' || url || ') and <' || url || '> é ' || url as t from pages) select page_id, unnest(regexp_extract_all(t, 'https?://[^\\s)\\]}\"''<]*')) as url from t")
def url_extract(c):
    t = c.pages.select("page_id", F.concat(F.lit("see ("), "url", F.lit(") and <"), "url", F.lit("> é "), "url").alias("t"))
    return t.select("page_id", F.explode(X.extract_urls(F.col("t"))).alias("u")).select("page_id", "u.url")


@plan("select id, cast(ceil(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) * 1.5) as bigint) as tokens, cast(strlen(body) as bigint) as bytes from memories")
def token_estimate(c):
    return c.memories.select("id", X.token_estimate(F.col("body")).alias("tokens"), F.octet_length("body").cast("bigint").alias("bytes"))


@plan("with l as (select id, list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as ls from memories) select id, coalesce(substr(list_filter(ls, lambda x: strlen(x) > 20 and not starts_with(x, '#'))[1], 1, 100), 'ingested document') as description from l")
def heuristic_description(c):
    return c.memories.select("id", X.heuristic_description(F.col("body")).alias("description"))


@plan("select event_type, case lower(event_type) when 'error' then 'incident' when 'view' then 'dashboard' else 'concept' end as type, count(*) as n from events group by all")
def entity_types(c):
    return c.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", X.canonical_entity_type(F.col("event_type")).alias("type"), "n")


@plan()
def chunks(c):
    return chunking.chunks(c.memories)


def _like(q: str) -> str:
    """SQL of the likeness of a lower-cased name n of three bytes or more to a constant."""
    return f"round(case when n = '{q}' then 1.0 when starts_with(n, '{q}') and substr(n, {len(q) + 1}, 1) in ('-', '_', ' ') then 0.95 when starts_with(n, '{q}') then 0.88 when starts_with('{q}', n) then 0.80 when regexp_split_to_array(n, '[-_\\s]')[1] = '{q}' then 0.92 when contains(n, '{q}') then 0.82 else jaro_winkler_similarity('{q}', n) end::double, 6)"


@plan(f"with l as (select id, name, {_like('nation-1')} as score from (select *, lower(trim(name)) as n from entities)) select id, name, score from l where score >= 0.75 order by score desc, name, id limit 10")
def fuzzy_entities(c):
    return resolve.suggest(c.entities, "nation-1")


# Shaping.


@plan("with f as (select * from (select id, name, namespace, type, updated_at from memories where lower(type) like '%o%' and namespace <> 'archive') qualify row_number() over (partition by type order by updated_at desc, id) = 1) select id, type from f order by updated_at desc, id limit 5")
def shape_pipeline(c):
    rows = c.memories.select("id", "name", "namespace", "type", "updated_at")
    return shape.shape(rows, ["type ~ O", "namespace != archive"], sort="updated_at", descending=True, dedupe="type", limit=5, select=["id", "type", "none.such"])


@plan("with s as (select id, name, sum(strlen('{\"id\":' || id || ',\"name\":\"' || name || '\"}') + 1) over (order by id) as s from memories) select id, name from s where s + 1 <= 1000")
def byte_budget(c):
    return shape.byte_budget(c.memories.select("id", "name"), [F.col("id")], 1000)


# More queries register themselves.
from tessellar.plans import ingests, reads, writes  # noqa: E402, F401
