"""Registered queries of ingest, chunks and token offsets, write-backs, JSON values and budgets: each beside its DuckDB twin."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import backlog, chunking, ingest, shape
from tessellar.plans.catalogue import plan
from tessellar.plans.writes import AT
from tessellar.sources import files
from tessellar.storage import shared_path

# Chunks and offsets.


@plan()
def markdown_chunks(c):
    """Every body in chunks along its Markdown; held against a plain search of all breaks in the tests."""
    return chunking.chunks(c.memories, chunking.markdown_spans)


# White space as Unicode has it.
_BLANK = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_OFFSETS = rf"""w as (select id, unnest(regexp_extract_all('passage: ' || body, '[^{_BLANK}]+')) as word, unnest(range(len(regexp_extract_all('passage: ' || body, '[^{_BLANK}]+')))) as i, unnest(regexp_extract_all('passage: ' || body, '^[^{_BLANK}]|[{_BLANK}]+[^{_BLANK}]')) as gap from memories),
 o as (select id, i, cast(sum(strlen(gap) - strlen(right(gap, 1)) + strlen(word)) over (partition by id order by i) as bigint) as stop, strlen(word) as n from w)"""


@plan(f"with {_OFFSETS} select id, i, stop - n as start, stop from o")
def token_offsets(c):
    spans = chunking.token_offsets(F.col("body"), "passage: ")
    rows = c.memories.select("id", F.posexplode(spans).alias("i", "s"))
    return rows.select("id", F.col("i").cast("bigint").alias("i"), "s.start", "s.stop")


@plan(
    f"""with {_OFFSETS}, n as (select id, count(*) as n from o group by id),
 s as (select id, n, unnest(range(0, greatest(n, 1), 350)) as first from n),
 k as (select * from s where first = 0 or first + 50 < n)
 select k.id, cast(first // 350 as bigint) as chunk_idx, case when first = 0 then 0 else a.stop - a.n end as start_offset, case when first + 400 >= k.n then strlen('passage: ' || m.body) else b.stop end as end_offset, cast(least(400, k.n - first) as bigint) as token_count
 from k join memories m using (id) left join o a on a.id = k.id and a.i = first left join o b on b.id = k.id and b.i = first + 399"""
)
def token_spans(c):
    text = F.concat(F.lit("passage: "), "body")
    offsets = c.memories.select("id", text.alias("text")).withColumn("offsets", chunking.token_offsets(F.col("text")))
    rows = offsets.select("id", F.inline(chunking.token_spans(F.col("offsets"), F.col("text"))))
    return rows.withColumns({"chunk_idx": F.col("chunk_idx").cast("bigint"), "token_count": F.col("token_count").cast("bigint")})


# Ingest.

_STORE = "store as (select * from memories where id % 3 <> 0), own as (select * from store where namespace = 'global' and deleted_at is null)"
_FILES = "f as (select 'docs/' || name || '.md' as path, name, case when id % 50 = 7 then ' ' when id % 2 = 0 then body else 'again ' || body end as body from memories), r as (select *, row_number() over (order by path) as place from f)"
_DECIDED = f"""with {_STORE}, {_FILES},
 k as (select r.*, own.id as known, case when trim(r.body) = '' then 'failed' when own.id is not null then 'met' else 'new' end as step from r left join own using (name)),
 n as (select *, row_number() over (partition by body order by place) as nth from k where step = 'new' and body not in (select body from own)),
 i as (select place, (select max(id) from store) + row_number() over (order by place) as new_id from n where nth = 1)"""


def _planned(c):
    body = F.when(F.col("id") % 50 == 7, " ").when(F.col("id") % 2 == 0, F.col("body")).otherwise(F.concat(F.lit("again "), "body"))
    return files.plan_ingest(c.memories.select(F.concat(F.lit("docs/"), "name", F.lit(".md")).alias("path"), body.alias("body")))


@plan(
    f"""{_DECIDED} select path, cast(1 as bigint) as part, name, case when step = 'failed' then 'failed' when new_id is not null then 'indexed' else 'skipped' end as status, case when new_id is not null then 'created' end as action,
 case when step = 'failed' then 'empty_body' when step = 'met' then 'duplicate_name' when new_id is null then 'duplicate_body' end as reason, cast(new_id as bigint) as memory_id from k left join i using (place)"""
)
def ingest_outcomes(c):
    outcomes = ingest.decide(ingest.stage_files(_planned(c)), c.memories.where("id % 3 <> 0"), "global")
    return outcomes.select("path", F.col("part").cast("bigint").alias("part"), "name", "status", "action", "reason", "memory_id")


@plan(f"{_DECIDED} select count(*) as total, count(new_id) as indexed, count(*) filter (new_id is null and step <> 'failed') as skipped, count(*) filter (step = 'failed') as failed from k left join i using (place)")
def ingest_tally(c):
    return ingest.tally(ingest.decide(ingest.stage_files(_planned(c)), c.memories.where("id % 3 <> 0"), "global"))


def _ingested(c):
    """The store after all files, known names updated."""
    store = c.memories.where("id % 3 <> 0")
    old = ingest.Tables(store, c.memory_versions.where("memory_id % 3 <> 0"), c.memories.select(F.col("id").alias("memory_id"), F.lit(0).alias("chunk_idx"), F.lit("old").alias("chunk_text")))
    outcomes = ingest.decide(ingest.stage_files(_planned(c)), store, "global", force=True)
    return ingest.persist(outcomes, old, "global", AT)


# With updates, a body is taken by an update from its place on, and one that an update takes away is free after it.
_FORCED = f"""with {_STORE}, {_FILES},
 k as (select r.*, own.id as known, case when trim(r.body) = '' then 'failed' when own.id is not null then 'met' else 'new' end as step from r left join own using (name)),
 u as (select own.body, max(coalesce(k.place, 1152921504606846976)) as until from own left join k on k.known = own.id and k.step = 'met' group by own.body),
 v as (select body, min(place) as since from k where step = 'met' group by body),
 n as (select k.*, row_number() over (partition by k.body order by place) as nth from k left join u using (body) left join v using (body) where step = 'new' and (until is null or place > until) and (since is null or place < since)),
 i as (select place, (select max(id) from store) + row_number() over (order by place) as new_id from n where nth = 1),
 w as (select coalesce(new_id, known) as id, name, body, new_id is not null as fresh from k left join i using (place) where step = 'met' or new_id is not null)"""


@plan(f"{_FORCED} select coalesce(w.id, s.id) as id, coalesce(w.name, s.name) as name, coalesce(w.body, s.body) as body, case when w.id is null or not fresh then s.created_at else {AT} end as created_at, case when w.id is null then s.updated_at else {AT} end as updated_at from store s full join w on w.id = s.id")
def ingest_memories(c):
    return _ingested(c).memories.select("id", "name", "body", "created_at", "updated_at")


@plan(
    f"""{_FORCED}, v2 as (select memory_id, max(version) as top from memory_versions where memory_id % 3 <> 0 group by memory_id)
 select memory_id, cast(version as bigint) as version, change_reason, strlen(body) as n from memory_versions where memory_id % 3 <> 0
 union all select w.id, cast(coalesce(top, 0) + 1 as bigint), case when fresh then 'create' else 'edit' end, strlen(body) from w left join v2 on v2.memory_id = w.id"""
)
def ingest_versions(c):
    return _ingested(c).versions.select("memory_id", F.col("version").cast("bigint").alias("version"), "change_reason", F.octet_length("body").cast("bigint").alias("n"))


@plan(f"{_FORCED} select id as memory_id from memories where id not in (select id from w) union select id from w where length(body) > 800")
def ingest_chunks(c):
    """Memories with chunks afterwards: their old ones, or new ones where a written body needs several."""
    return _ingested(c).chunks.select("memory_id").distinct()


# A line that is no JSON, one without a usable name, one that says nothing about itself, and the same name twice.
_LINES = """l as (select id, 0 as again, case when id % 10 = 4 then '---' else 'Doc ' || id end as name, case when id % 10 = 5 then ' ' else 'said of ' || id end as description, body from memories
 union all select id, 1, 'doc-' || id, 'said again of ' || id, 'once more' from memories where id % 20 in (5, 6)),
 p as (select *, row_number() over (order by id, again) - 1 as line from l)"""


def _line_file(c):
    """The memories as lines of NDJSON files, some of them broken."""
    first = c.memories.select("id", F.lit(0).alias("again"), F.when(F.col("id") % 10 == 4, "---").otherwise(F.concat(F.lit("Doc "), F.col("id").cast("string"))).alias("name"), F.when(F.col("id") % 10 == 5, " ").otherwise(F.concat(F.lit("said of "), F.col("id").cast("string"))).alias("description"), "body")
    second = c.memories.where("id % 20 in (5, 6)").select("id", F.lit(1), F.concat(F.lit("doc-"), F.col("id").cast("string")), F.concat(F.lit("said again of "), F.col("id").cast("string")), F.lit("once more"))
    nation = F.concat(F.lit("Nation "), (F.col("id") % 30).cast("string"))
    entities = F.array(F.struct(nation.alias("name"), F.when(F.col("id") % 2 == 0, "tool").otherwise("person").alias("entity_type")), F.struct(F.concat(F.lit("Group "), (F.col("id") % 7).cast("string")).alias("name"), F.lit("concept").alias("entity_type")))
    edge = F.array(F.struct(nation.alias("source"), F.concat(F.lit("place "), (F.col("id") % 5).cast("string")).alias("target"), F.lit("uses").alias("relation"), ((F.col("id") % 10) / 10).alias("strength")))
    rows = first.unionAll(second).select("id", "again", F.to_json(F.struct("name", "description", "body", entities.alias("entities"), edge.alias("relationships"))).alias("value"))
    # A line of which half is missing.
    broken = F.when((F.col("id") % 10 == 3), F.expr("substring(value, 1, cast(length(value) / 2 as int))")).otherwise(F.col("value"))
    path = shared_path(c.spark, "lines")
    rows.repartitionByRange("id", "again").sortWithinPartitions("id", "again").select(broken.alias("value")).write.text(path)
    return files.checked_lines(c.spark, path)


@plan(f"with {_LINES} select cast(line as bigint) as line, case when id % 10 = 3 then 'invalid JSON' end as error, case when id % 10 <> 3 then name end as name, case when id % 10 <> 3 then strlen(body) end as n from p")
def checked_lines(c):
    """Every line of a batch with its place: the good ones' fields, and why the others are none."""
    good = F.col("error").isNull()
    return _line_file(c).select("line", "error", F.when(good, F.col("name")).alias("name"), F.when(good, F.octet_length("body").cast("bigint")).alias("n"))


_LINE_STEPS = f"""with {_LINES}, {_STORE},
 k as (select p.*, 'doc-' || p.id as nm, own.id as known from p left join own on own.name = 'doc-' || p.id and p.id % 10 <> 4),
 g as (select *, case when id % 10 = 3 then 'invalid_json' when id % 10 = 4 then 'empty_name' end as bad, min(case when id % 10 not in (3, 4) and known is null and trim(description) <> '' then line end) over (partition by nm) as first from k),
 s as (select *, case when bad is not null then 'failed' when known is not null or line > first then 'met' when line = first then 'new' else 'bare' end as step from g),
 i as (select line, (select max(id) from store) + row_number() over (order by line) as new_id from s where step = 'new')"""


@plan(
    f"""{_LINE_STEPS} select cast(s.line as bigint) as place, case when step in ('met', 'new') then 'indexed' else 'failed' end as status, case step when 'met' then 'updated' when 'new' then 'created' end as action,
 case when step = 'bare' then 'no_description' else bad end as reason, cast(case when step in ('met', 'new') then coalesce(known, new_id, max(new_id) over (partition by nm)) end as bigint) as memory_id from s left join i using (line)"""
)
def batch_outcomes(c):
    staged = ingest.stage_lines(_line_file(c))
    return ingest.decide(staged, c.memories.where("id % 3 <> 0"), "global", force=True, lines=True).select("place", "status", "action", "reason", "memory_id")


@plan(f"{_LINE_STEPS} select cast(line as bigint) as place, 'failed' as status, case when step = 'bare' then 'no_description' when step = 'met' then 'duplicate_name' else coalesce(bad, 'batch_rejected') end as reason from s")
def batch_rejected(c):
    """The same lines where one failure fails the batch and known names are not updated."""
    staged = ingest.stage_lines(_line_file(c))
    return ingest.decide(staged, c.memories.where("id % 3 <> 0"), "global", lines=True, whole=True).select("place", "status", "reason")


# The graph that the indexed lines leave: types by the last line, ends of edges that no line names are concepts.
_LINE_GRAPH = f"""{_LINE_STEPS}, ok as (select line, id, again from s where step in ('met', 'new')),
 said as (select line, 0 as step, 'nation-' || id % 30 as name, case when id % 2 = 0 then 'tool' else 'person' end as type from ok union all select line, 0, 'group-' || id % 7, 'concept' from ok
  union all select line, 1, 'nation-' || id % 30, case when id % 2 = 0 then 'tool' else 'person' end from ok union all select line, 1, 'place-' || id % 5, 'concept' from ok),
 named as (select name, arg_max(type, line * 2 + step) as type from said group by name),
 grown as (select coalesce(e.id, (select max(id) from entities) + row_number() over (partition by e.id is null order by n.name)) as id, n.name, n.type, e.id is null as fresh from named n left join entities e on e.namespace = 'global' and e.name = n.name)"""


def _lined(c):
    store = c.memories.where("id % 3 <> 0")
    old = ingest.Tables(entities=c.entities, relationships=c.relationships, bridge=c.memory_entities)
    outcomes = ingest.decide(ingest.stage_lines(_line_file(c)), store, "global", force=True, lines=True)
    return ingest.persist(outcomes, old, "global", AT)


@plan(f"{_LINE_GRAPH} select coalesce(g.id, e.id) as id, coalesce(g.name, e.name) as name, coalesce(g.type, e.type) as type from entities e full join grown g on g.id = e.id")
def batch_entities(c):
    return _lined(c).entities.select("id", "name", "type")


@plan(
    f"""{_LINE_GRAPH}, b as (select x.id as source_id, y.id as target_id, arg_max(o.id % 10 / 10, line) as weight from ok o join grown x on x.name = 'nation-' || o.id % 30 join grown y on y.name = 'place-' || o.id % 5 group by x.id, y.id)
 select source_id, target_id, relation, weight from relationships union all select source_id, target_id, 'uses', weight from b"""
)
def batch_edges(c):
    return _lined(c).relationships.select("source_id", "target_id", "relation", "weight")


# Write-backs: results of enrichment from the events, several for an item.

_RESULTS = """r as (select event_id as seq, case user_id % 3 when 0 then 'EntityDescriptions' when 1 then 'BodyEnrich' else 'ReEmbed' end as operation, case user_id % 3 when 0 then 2000000 + event_id % 40 else event_id % 300 end as item_id, event_type || ' ' || event_id as text, case when event_id % 4 < 3 then [event_id, 1] end as embedding from events),
 h as (select operation, item_id as id, max(seq) as seq, arg_max(text, seq) as text, arg_max(embedding, seq) filter (seq is not null) as e, max_by(embedding is null, seq) as bare from r group by operation, item_id)"""


def _written_back(c):
    operation = F.when(F.col("user_id") % 3 == 0, "EntityDescriptions").when(F.col("user_id") % 3 == 1, "BodyEnrich").otherwise("ReEmbed")
    item = F.when(F.col("user_id") % 3 == 0, F.lit(2000000) + F.col("event_id") % 40).otherwise(F.col("event_id") % 300)
    vector = F.when(F.col("event_id") % 4 < 3, F.array(F.col("event_id").cast("float"), F.lit(1.0).cast("float")))
    results = c.events.select(F.col("event_id").alias("seq"), operation.alias("operation"), item.alias("item_id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), vector.alias("embedding"))
    entities = c.entities.withColumn("description", F.concat(F.lit("was "), "name"))
    return backlog.write_back(results, c.memories, c.memory_versions, entities, c.memory_embeddings.drop("label"), AT)


@plan(f"with {_RESULTS} select e.id, coalesce(h.text, 'was ' || e.name) as description from entities e left join h on h.id = e.id and h.operation = 'EntityDescriptions'")
def write_back_descriptions(c):
    return _written_back(c)[2].select("id", "description")


@plan(
    f"""with {_RESULTS}, b as (select h.* from h join memories m on m.id = h.id where operation = 'BodyEnrich' and m.deleted_at is null),
 t as (select memory_id, max(version) as top from memory_versions group by memory_id)
 select m.id, coalesce(b.text, m.body) as body, case when b.id is null then m.updated_at else {AT} end as updated_at, cast(coalesce(t.top, 0) + (b.id is not null)::int as bigint) as version from memories m left join b on b.id = m.id left join t on t.memory_id = m.id"""
)
def write_back_bodies(c):
    memories, versions, _, _ = _written_back(c)
    top = versions.groupBy(F.col("memory_id").alias("id")).agg(F.max("version").cast("bigint").alias("version"))
    return memories.join(top, "id", "left").select("id", "body", "updated_at", F.coalesce("version", F.lit(0).cast("bigint")).alias("version"))


@plan(
    f"""with {_RESULTS}, f as (select h.id, max(h.seq) as seq from h join memories m on m.id = h.id where operation <> 'EntityDescriptions' and m.deleted_at is null and h.seq % 4 < 3 group by h.id)
 select coalesce(f.id, v.memory_id) as memory_id, case when f.id is null then len(v.embedding) else 2 end as width, round(case when f.id is null then v.embedding[1]::double else f.seq end, 4) as head from memory_embeddings v full join f on f.id = v.memory_id"""
)
def write_back_vectors(c):
    vectors = _written_back(c)[3]
    return vectors.select("memory_id", F.size("embedding").cast("bigint").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("head"))


# JSON values and budgets.

_JSON = """j as (select event_id, case event_id % 7 when 0 then props when 1 then '{"k":"' || event_type || '"}' when 2 then '{"k":{"x":1}}' when 3 then '{}' when 4 then '{"k":null}' when 5 then '{"k":true}' else '{"k":' || value || '}' end as text from events where event_type is not null and value is not null),
 v as (select event_id, json_type(text, '$.k') as kind, text ->> '$.k' as k from j),
 o as (select event_id, case when kind is null then 3 when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') then 0 when kind in ('VARCHAR', 'BOOLEAN', 'NULL') then 1 else 2 end as rank, case when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') then k::double end as number, case when kind = 'NULL' then '' when kind in ('VARCHAR', 'BOOLEAN') then k end as text from v)"""


def _events_json(c):
    e, k = F.col("event_id") % 7, lambda *parts: F.concat(F.lit('{"k":'), *parts, F.lit("}"))
    text = F.when(e == 0, F.col("props")).when(e == 1, k(F.lit('"'), "event_type", F.lit('"'))).when(e == 2, '{"k":{"x":1}}').when(e == 3, "{}").when(e == 4, '{"k":null}').when(e == 5, '{"k":true}').otherwise(k(F.col("value").cast("string")))
    return c.events.where("event_type is not null and value is not null").select("event_id", F.parse_json(text).alias("v"))


@plan(f"with {_JSON} select event_id, row_number() over (order by rank, number nulls last, text nulls last, event_id) as place from o")
def json_sort(c):
    """Events in order of a JSON value: numbers, then texts, then containers, then those without one."""
    from tessellar.operators import maintain

    rank, number, text = [f"_{x}" for x in ("rank", "number", "text")]
    keyed = shape.json_keys(_events_json(c), "v", "k", (rank, number, text))
    # What a rank lacks is null in all of its rows.
    return maintain.numbered(keyed.select("event_id", rank, number, text), [rank, number, text, "event_id"], "place").select("event_id", "place")


@plan(f"with {_JSON}, d as (select *, case when rank = 0 then number::varchar else text end as t from o), n as (select event_id, rank, row_number() over (partition by rank, number, text order by event_id) as n from d where rank < 2) select event_id from n where n = 1 union all select event_id from d where rank >= 2")
def json_dedupe(c):
    """The first event of each value; arrays, objects and missing values are no duplicates."""
    return shape.json_shape(_events_json(c), "v", ["event_id"], dedupe="k").select("event_id")


@plan(f"with {_JSON} select event_id from o where text is null or lower(text) not like '%e%' union all select event_id from o where lower(text) = 'true'")
def json_filter(c):
    rows = _events_json(c)
    text = F.coalesce(shape.json_text(shape.json_at(F.col("v"), "k")), F.lit(""))
    found = shape.json_shape(rows, "v", ["event_id"], filters=["k = true"]).select("event_id")
    return rows.where(~F.lower(text).contains("e") | shape.json_matches(F.col("v"), "k.x = 1")).select("event_id").unionByName(found).distinct()


_ITEM = """'{"id":' || id || ',"name":"' || name || '"}'"""


@plan(
    f"""with p as (select id, name, strlen({_ITEM}) + 1 as b from memories where deleted_at is null), s as (select *, sum(b) over (order by name, id) as s from p),
 x as (select sum(b) - 1 as total from p) select id, name from s, x where s <= 5001 - strlen('{{"query":"all","items":[],"edges":[]}}') - case when strlen('{{"query":"all","items":[],"edges":[]}}') + (select sum(strlen('{{"id":' || id || '}}') + 1) - 1 from memories) > 5000 then 0 else (select sum(strlen('{{"id":' || id || '}}') + 1) - 1 from memories) end"""
)
def envelope_budget(c):
    """What 5,000 bytes hold of all live memories, whose envelope loses a second array first."""
    rows = c.memories.where("deleted_at is null").select("id", "name")
    return shape.fit(rows, [F.col("name"), F.col("id")], 5000, {"query": "all"}, {"edges": c.memories.select("id")}).rows


# Names beyond Latin letters.

_ODD = ["ﬁ", "ﬄ", "Ａ", "ｚ", "９", "　", "½", "²", "㎏", "№", "Ⅷ", "①", "é", "ñ", "Å", "ǆ", "Ж", "я", "漢", "ß", "ø", "…", "™", "ſ", "K", "𝓗", "🅰", "é", "å"]


def _odd_ascii(x: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", x) if ch.isascii())


@plan(
    "with o as (select * from (values " + ", ".join(f"({i}, '{_odd_ascii(x)}')" for i, x in enumerate(_ODD)) + ") t(i, x)), n as (select event_id, lower(event_type || x || ' of' || x || x || '_' || user_id) as s from events join o on i = event_id % " + str(len(_ODD)) + ") select event_id, regexp_replace(regexp_replace(s, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as name from n where event_id is not null"
)
def entity_name_forms(c):
    """Names with ligatures, full-width and enclosed letters, numbers, marks and other scripts."""
    odd = F.element_at(F.array(*[F.lit(x) for x in _ODD]), (F.col("event_id") % len(_ODD) + 1).cast("int"))
    name = F.concat("event_type", odd, F.lit(" of"), odd, odd, F.lit("_"), F.col("user_id").cast("string"))
    return c.events.select("event_id", X.normalize_entity_name(name).alias("name"))
