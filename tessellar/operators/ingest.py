"""Ingest whole: files or batch lines are staged, each part gets an outcome, and one written set changes every table.

Staging is row by row.  Outcomes are those of the parts one after another in their places, found by groupings
over names and body hashes instead of a loop; what is written then goes to the memories, versions, chunks, URLs, entities
and edges as keyed merges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import chunking, maintain, scans, tables
from tessellar.storage import snapshot

# Limits of a memory, and of namespaces.
NAME, DESCRIPTION, BODY, NAMESPACES = 80, 500, 512_000, 100
SLUG = r"^[a-z][a-z0-9-]{0,78}[a-z0-9]$|^[a-z0-9]$"
STATUSES = ("indexed", "skipped", "failed")
#: Keys of entities and of edges.
ENTITY, EDGE = ["namespace", "name"], ["source_id", "target_id", "relation"]


@dataclass(frozen=True)
class Tables:
    """The tables that an ingest changes; those of the graph only by batch lines.  Without memories those of the graph alone are changed."""

    memories: DataFrame | None = None
    versions: DataFrame | None = None
    chunks: DataFrame | None = None
    urls: DataFrame | None = None
    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    bridge: DataFrame | None = None


def _reason(**rules: Column) -> Column:
    """The first rule that a row breaks, or null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")


def stage_files(planned: DataFrame, limit: int = chunking.PARTITION) -> DataFrame:
    """(path, part, name, type, description, body, reason) of planned files (path, name, description, body).

    A body over the limit is cut at its sections; a file that breaks a rule, or whose parts would, is one row with its reason.
    """
    size, parts = F.octet_length("body"), F.col("parts")
    whole = planned.withColumn("parts", F.when((size <= BODY) & ~_blank(F.col("body")), chunking.partitioned(F.col("body"), limit)).otherwise(F.array("body")))
    last = F.octet_length(F.concat("name", F.lit("-part-"), F.size(parts).cast("string")))
    reason = _reason(
        name_too_long=F.octet_length("name") > NAME,
        reserved_name=F.col("name").startswith("__"),
        name_not_kebab=~F.coalesce(F.col("name"), F.lit("")).rlike(SLUG),
        body_too_large=size > BODY,
        empty_body=_blank(F.col("body")),
        description_too_long=F.octet_length("description") > DESCRIPTION,
        part_name_too_long=(F.size(parts) > 1) & (last > NAME),
    )
    judged = whole.withColumn("reason", reason).withColumn("parts", F.when(F.col("reason").isNull(), parts).otherwise(F.array("body")))
    rows = judged.select("path", "name", "description", "reason", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "body"))
    several = F.col("n") > 1
    return rows.select(
        "path",
        (F.col("i") + 1).alias("part"),
        F.when(several, F.concat("name", F.lit("-part-"), (F.col("i") + 1).cast("string"))).otherwise(F.col("name")).alias("name"),
        F.lit("document").alias("type"),
        F.when(several, X.partition_description(F.col("description"), F.col("i") + 1, F.col("n"))).otherwise(F.col("description")).alias("description"),
        "body",
        "reason",
    )


def stage_lines(lines: DataFrame) -> DataFrame:
    """Batch lines (line, name, type, description, body, entities, relationships, error) as staged parts; ``line`` is the place."""
    name = X.normalize_entity_name(F.coalesce("name", F.lit("")))
    body = F.coalesce("body", F.lit(""))
    reason = _reason(invalid_json=F.col("error").isNotNull(), empty_name=name == "", body_too_large=F.octet_length(body) > BODY)
    return lines.select(
        F.col("line").alias("place"),
        F.when(F.col("error").isNull(), name).alias("name"),
        F.coalesce("type", F.lit("note")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"),
        body.alias("body"),
        reason.alias("reason"),
        "entities",
        "relationships",
    )


def decide(staged: DataFrame, memories: DataFrame, namespace: str, force: bool = False, lines: bool = False, whole: bool = False, most: int = NAMESPACES) -> DataFrame:
    """``staged`` with (place, status, action, reason, memory_id): what each part comes to, as if they came one by one in their places.

    A known name is updated with ``force``, else skipped (of files) or failed (of lines).  A file's new name whose body a live memory of the namespace has
    is skipped; names of files are unique.  A line's new name needs a description, and later lines of that name meet the memory it made.
    With ``whole`` one failure fails all.
    """
    live = scans.live(memories)
    own = scans.in_namespace(live, namespace)
    # What decides is narrow; bodies and what lines name wait for the end, where a caller that does not ask for them reads none.
    full = own.isEmpty() and live.select("namespace").distinct().count() >= most
    rows = staged if lines else maintain.numbered(staged, ["path", "part"], "place")
    parts = rows
    rows = rows.select("place", "name", _blank(F.col("description")).alias("bare"), F.coalesce("reason", F.lit("namespace_limit" if full else None).cast("string")).alias("reason"), X.content_hash(F.col("body")).alias("body_hash"))
    known = own.select("name", F.col("id").alias("known_id"))
    rows = snapshot(rows.join(known, "name", "left").withColumn("good", F.col("reason").isNull()), "staged")
    # Names: the first good row of an unknown one makes it, and later ones meet it.
    able = F.col("good") & F.col("known_id").isNull() & (~F.col("bare") if lines else F.lit(True))
    first = rows.where(able).groupBy("name").agg(F.min("place").alias("first"))
    rows = rows.join(first, "name", "left")
    met = F.col("known_id").isNotNull() | (F.col("place") > F.col("first"))
    step = F.when(~F.col("good"), "failed").when(met, "met").when(F.col("place") == F.col("first"), "new").otherwise("bare")
    rows = rows.withColumn("step", step)
    if lines:
        made = rows.where("step = 'new'").select("place")
    else:
        made = _new_bodies(rows, own, force)
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = maintain.numbered(made, ["place"], "n").crossJoin(F.broadcast(top)).select("place", (F.col("top") + F.col("n")).cast("bigint").alias("new_id"))
    rows = rows.join(ids, "place", "left")
    repeats = F.lit("duplicate_name")
    out = rows.withColumns(
        {
            "status": F.when(F.col("step") == "met", "indexed" if force else "failed" if lines else "skipped").when(F.col("new_id").isNotNull(), "indexed").when(F.col("step") == "new", "skipped").otherwise("failed"),
            "action": F.when(F.col("step") == "met", "updated" if force else None).when(F.col("new_id").isNotNull(), "created"),
            "reason": F.when(F.col("step") == "met", F.lit(None) if force else repeats).when(F.col("step") == "bare", "no_description").when((F.col("step") == "new") & F.col("new_id").isNull(), "duplicate_body").otherwise(F.col("reason")),
        }
    )
    if force and lines:
        # Updates of a name made in this batch go to its new memory.
        own_id = out.where("new_id is not null").select("name", F.col("new_id").alias("made_id"))
        out = out.join(own_id, "name", "left").withColumn("known_id", F.coalesce("known_id", "made_id")).drop("made_id")
    out = out.withColumn("memory_id", F.when(F.col("status") == "indexed", F.coalesce("new_id", "known_id"))).select("place", "body_hash", "status", "action", "reason", "memory_id")
    out = snapshot(out, "outcomes")
    if whole and not out.where("status = 'failed'").isEmpty():
        out = out.withColumns({"status": F.lit("failed"), "action": F.lit(None).cast("string"), "reason": F.coalesce("reason", F.lit("batch_rejected")), "memory_id": F.lit(None).cast("bigint")})
    return parts.drop("reason").join(out, "place")


def _new_bodies(rows: DataFrame, own: DataFrame, force: bool) -> DataFrame:
    """(place) of new names whose body no live memory has by then.

    A body is held by a stored memory until an update takes it away, by an update from its place on, and by the first new name that finds it free.
    """
    updates = rows.where("step = 'met'" if force else "false").select("place", "known_id", "body_hash")
    held = own.select("id", X.content_hash(F.col("body")).alias("body_hash")).join(updates.select(F.col("known_id").alias("id"), F.col("place").alias("until")), "id", "left")
    never = (1 << 62)
    until = held.groupBy("body_hash").agg(F.max(F.coalesce("until", F.lit(never))).alias("until"))
    since = updates.groupBy("body_hash").agg(F.min("place").alias("since"))
    free = rows.where("step = 'new'").select("place", "body_hash").join(until, "body_hash", "left").join(since, "body_hash", "left")
    free = free.where((F.col("until").isNull() | (F.col("place") > F.col("until"))) & (F.col("since").isNull() | (F.col("place") < F.col("since"))))
    return free.groupBy("body_hash").agg(F.min("place").alias("place")).select("place")


def tally(outcomes: DataFrame) -> DataFrame:
    """One row: parts by status."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def changes(outcomes: DataFrame, old: Tables, namespace: str, at: int) -> Tables:
    """The changed or added rows of each table: every write is a version, the last one of a memory is its row, its chunks and, where it was created, its URLs."""
    written = outcomes.where("status = 'indexed'")
    graph = old.entities is not None and "entities" in written.columns
    if old.memories is None:
        return _graph_changes(snapshot(written.select("place", "memory_id", "entities", "relationships"), "written"), old, Tables(), namespace) if graph else Tables()
    written = snapshot(written, "written")
    last = Window.partitionBy("memory_id").orderBy(F.desc("place"))
    now = written.withColumn("_n", F.row_number().over(last)).where("_n = 1").withColumn("id", F.col("memory_id"))
    time = F.lit(at).cast("bigint")
    rows = now.select("id", F.lit(namespace).alias("namespace"), "name", "type", "description", "body", time.alias("created_at"), time.alias("updated_at"))
    touched = old.memories.join(now.select("id"), "id", "left_semi")
    new = Tables(maintain.merge_by_key(touched, rows, ["id"], replace=["type", "description", "body", "updated_at"]), _versions(old.versions, written, at))
    if old.chunks is not None:
        cut = chunking.chunks(now.select("id", "body"), chunking.markdown_spans)
        several = cut.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("memory_id"))).where("_n > 1").drop("_n")
        new = replace(new, chunks=several)
    if old.urls is not None:
        new = replace(new, urls=tables.memory_urls(written.where("action = 'created'").select(F.col("memory_id").alias("id"), "body")))
    if graph:
        new = _graph_changes(written, old, new, namespace)
    return new


def applied(old: Tables, new: Tables) -> Tables:
    """The tables after their changes."""

    def merged(before: DataFrame, after: DataFrame | None, keys: list[str]) -> DataFrame:
        return before if after is None else before.join(after.select(*keys), keys, "left_anti").select(*before.columns).unionByName(after, allowMissingColumns=True).select(*before.columns)

    added = lambda before, after: before if after is None else before.unionByName(after, allowMissingColumns=True)
    return Tables(
        merged(old.memories, new.memories, ["id"]),
        added(old.versions, new.versions),
        old.chunks and added(tables.delete_of(old.chunks, new.memories.select(F.col("id").alias("memory_id"))), new.chunks).select(*old.chunks.columns),
        old.urls and tables.upsert_urls(old.urls, new.urls),
        old.entities and merged(old.entities, new.entities, ENTITY),
        old.relationships and merged(old.relationships, new.relationships, EDGE),
        old.bridge and (old.bridge if new.bridge is None else maintain.link_memories(old.bridge, new.bridge)),
    )


def persist(outcomes: DataFrame, old: Tables, namespace: str, at: int) -> Tables:
    """The tables after the indexed parts."""
    return applied(old, changes(outcomes, old, namespace, at))


def _versions(versions: DataFrame, written: DataFrame, at: int) -> DataFrame:
    top = versions.join(written.select("memory_id"), "memory_id", "left_semi").groupBy("memory_id").agg(F.max("version").alias("_top"))
    k = F.row_number().over(Window.partitionBy("memory_id").orderBy("place"))
    return written.join(top, "memory_id", "left").select("memory_id", (F.coalesce("_top", F.lit(0)) + k).cast(versions.schema["version"].dataType).alias("version"), "name", "body", F.when(F.col("action") == "created", "create").otherwise("edit").alias("change_reason"), F.lit(at).cast("bigint").alias("created_at"))


def _merged(base: DataFrame, new: DataFrame, keys: list[str], **how) -> DataFrame:
    """The rows of ``base`` with the keys of ``new``, merged with it; new rows have ids after the largest, in order of their keys."""
    rows = maintain.merge_by_key(base.join(new.select(*keys), keys, "left_semi").select(*base.columns), new, keys, **how)
    if "id" not in base.columns:
        return rows
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = maintain.numbered(rows.where("id is null"), keys, "_n").crossJoin(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast("bigint")).select(*rows.columns)
    return snapshot(rows.where("id is not null").unionByName(fresh), "merged")


def _graph_changes(written: DataFrame, old: Tables, new: Tables, namespace: str) -> Tables:
    """Entities, edges and links of written lines: a line's entities, then the ends of its edges; of one name or edge the last holds."""
    valid = X.valid_entity_name(F.col("name"))
    own = written.select("place", "memory_id", F.posexplode("entities").alias("i", "e")).select("place", "memory_id", F.lit(0).alias("step"), "i", X.normalize_entity_name(F.col("e.name")).alias("name"), X.canonical_entity_type(F.coalesce("e.entity_type", "e.type")).alias("type"), F.col("e.description").alias("description")).where(valid)
    r = F.col("r")
    edge = written.select("place", F.posexplode("relationships").alias("i", "r")).select("place", "i", X.normalize_entity_name(F.coalesce(r["source"], r["from"])).alias("source"), X.normalize_entity_name(F.coalesce(r["target"], r["to"])).alias("target"), X.normalize_relation(r["relation"]).alias("relation"), F.coalesce(r["strength"], r["weight"], F.lit(0.5)).alias("weight"))
    edge = edge.where((F.col("source") != F.col("target")) & F.col("weight").between(0, 1) & X.valid_relation(F.col("relation")))
    # An end that its line does not name as an entity is a concept.
    ends = edge.select("place", "i", F.explode(F.array("source", "target")).alias("name")).where(valid)
    typed = own.groupBy("place", "name").agg(F.max_by("type", "i").alias("type"))
    ends = ends.join(typed, ["place", "name"], "left").select("place", F.lit(None).cast("bigint").alias("memory_id"), F.lit(1).alias("step"), "i", "name", F.coalesce("type", F.lit("concept")).alias("type"), F.lit(None).cast("string").alias("description"))
    order = F.struct("place", "step", "i")
    named = own.unionByName(ends).groupBy("name").agg(F.max_by("type", order).alias("type"), F.max_by("description", F.when(F.col("description").isNotNull(), order)).alias("description")).withColumn("namespace", F.lit(namespace))
    entities = _merged(old.entities, named.select(*[c for c in named.columns if c in old.entities.columns]), ENTITY, replace=["type"], keep_old=["description"])
    ids = entities.select("name", "id")
    links = edge.join(ids.select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("name").alias("target"), F.col("id").alias("target_id")), "target")
    best = links.groupBy(*EDGE).agg(F.max_by("weight", F.struct("place", "i")).alias("weight")).withColumn("namespace", F.lit(namespace))
    bridge = own.join(ids, "name").select("memory_id", F.col("id").alias("entity_id")).distinct()
    return replace(new, entities=entities, relationships=_merged(old.relationships, best, EDGE, replace=["weight"]), bridge=bridge)
