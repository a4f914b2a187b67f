"""Files in and out: text trees, NDJSON batches, name lists, exports and graph drawings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar import schema
from tessellar.functions import text as X
from tessellar.storage import snapshot

#: Blocks of files up to which their counts are laid end to end in one task; of more, lines are sorted.
BLOCKS = 100_000


def text_tree(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, body) of every file of a folder that fits a pattern: a suffix, a prefix or a name."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern)
    # Paths come as URLs; a plus sign is itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), F.col("value").alias("body"))


def checked_prefix(prefix: str, max_len: int = 60, cap: int = 80) -> int:
    """The characters that a name prefix leaves for the rest of a name; it must be the head of a slug, and shorter than a name may be."""
    if not re.fullmatch("[a-z][a-z0-9-]*", prefix):
        raise ValueError(f"no slug begins with {prefix!r}")
    if len(prefix) >= cap:
        raise ValueError(f"a prefix of {len(prefix)} leaves nothing of a name's {cap} characters")
    return min(max_len, cap - len(prefix))


def plan_ingest(files: DataFrame, taken: DataFrame | None = None, prefix: str = "", max_len: int = 60) -> DataFrame:
    """(path, name, description, body): names from file stems, made unique by suffixes in order of paths.

    A name is the base or the first ``base-1``, ``base-2`` ... that neither a taken name nor an earlier file has.
    """
    if prefix:
        checked_prefix(prefix, max_len)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    named = files.withColumn("base", F.concat(F.lit(prefix), X.kebab_name(stem, max_len - len(prefix)))).withColumn("description", X.heuristic_description(F.col("body"), stem))
    names = unique_names(named.select("path", "base"), taken.select("name") if taken is not None else None)
    return named.join(names, "path").select("path", "name", "description", "body")


def unique_names(files: DataFrame, taken: DataFrame | None) -> DataFrame:
    """(path, name) of files (path, base).

    In rounds: the r-th open file of a base proposes its r-th free suffix, and the first path that proposes a name has it.
    Where another base took a name, that file and the later ones of like bases (``a``, ``a-1``, ``a-1-2``) propose again.
    """
    todo = snapshot(files.withColumn("family", F.regexp_replace("base", r"(-\d+)+$", "")), "names")
    used = snapshot(taken.distinct(), "names") if taken is not None else None
    out = None
    while True:
        rank = F.row_number().over(Window.partitionBy("base").orderBy("path")) - 1
        ranked = todo.withColumn("r", rank.cast("bigint"))
        if used is not None:
            # A used name bars its own base, and suffix N of the base before ``-N``.
            cut = used.where(F.col("name").rlike(r"-[1-9][0-9]{0,8}$")).select(F.regexp_replace("name", r"-\d+$", "").alias("base"), F.regexp_extract("name", r"-(\d+)$", 1).cast("bigint").alias("n"))
            bars = used.select(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("n")).unionByName(cut).groupBy("base").agg(F.sort_array(F.collect_set("n")).alias("bars"))
            ranked = ranked.join(bars, "base", "left")
            # The r-th number that is not barred: each barred one at or before it moves it on.
            ranked = ranked.withColumn("r", F.aggregate(F.coalesce("bars", F.array().cast("array<bigint>")), F.col("r"), lambda k, b: F.when(b <= k, k + 1).otherwise(k))).drop("bars")
        proposed = ranked.withColumn("name", F.when(F.col("r") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("r").cast("string"))))
        first = proposed.groupBy("name").agg(F.min("path").alias("path"))
        lost = proposed.join(first, ["name", "path"], "left_anti").groupBy("family").agg(F.min("path").alias("before"))
        won = proposed.join(first, ["name", "path"]).join(lost, "family", "left").where(F.col("before").isNull() | (F.col("path") < F.col("before")))
        won = snapshot(won.select("path", "name"), "names")
        out = won if out is None else out.unionByName(won)
        todo = snapshot(todo.join(won, "path", "left_anti"), "names")
        if todo.isEmpty():
            return out
        fresh = won.select("name")
        used = fresh if used is None else used.unionByName(fresh)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """NDJSON memories (value, ...) with their fields beside them and ``error``: why a line is none, or null."""
    read = F.from_json("value", f"{schema.BATCH_LINE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").withColumn("_line", read)
    error = F.when(F.col("_line").isNull() | F.col("_line._bad").isNotNull(), "invalid JSON").when(F.col("_line.name").isNull(), "missing name")
    return rows.select(*lines.columns, "_line.*", error.alias("error")).drop("_bad")


def checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, fields, error): all lines of NDJSON files but blank ones, with their places from 0, good or not."""
    from tessellar.operators import maintain

    # Blocks of a file are read in order, and lines within them: a line's place is how far it stands from its block's first.
    read = spark.read.text(path).where(F.trim("value") != "").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_in"))
    laid, key = snapshot(read, "lines"), ["file_path", "file_block_start"]
    blocks = snapshot(laid.groupBy(*key).agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_lines")), "blocks")
    if blocks.count() <= BLOCKS:
        before = F.coalesce(F.sum("_lines").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = blocks.select(*key, (before - F.col("_first") + 1).alias("_shift"))
        placed = laid.join(F.broadcast(blocks), key).withColumn("_n", F.col("_in") + F.col("_shift"))
    else:
        placed = maintain.numbered(laid, [*key, "_in"], "_n")
    return parsed_lines(placed.select((F.col("_n") - 1).alias("line"), "value"))


def batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON memories with their entities and relationships, without lines that are none; the type defaults to note."""
    good = parsed_lines(spark.read.text(path)).where("error is null")
    return good.withColumn("type", F.coalesce("type", F.lit("note"))).drop("value", "error")


def graph_input(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of batch lines, under either spelling of their fields, normalised and validated."""
    e = lines.select("name", F.explode("entities").alias("e")).select(F.col("name").alias("memory"), X.normalize_entity_name(F.col("e.name")).alias("name"), X.canonical_entity_type(F.coalesce("e.entity_type", "e.type")).alias("type"), F.col("e.description").alias("description"))
    r = lines.select("name", F.explode("relationships").alias("r")).select(
        F.col("name").alias("memory"), X.normalize_entity_name(F.coalesce("r.source", "r.from")).alias("source"), X.normalize_entity_name(F.coalesce("r.target", "r.to")).alias("target"), X.normalize_relation(F.col("r.relation")).alias("relation"), F.coalesce("r.strength", "r.weight", F.lit(0.5)).alias("weight")
    )
    return e.where(X.valid_entity_name(F.col("name"))), r.where((F.col("source") != F.col("target")) & F.col("weight").between(0, 1) & X.valid_relation(F.col("relation")))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): lines without comments and blanks, once each, in the order of their first places."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    named = lines.where((F.col("name") != "") & ~F.col("name").startswith("#"))
    return named.groupBy("name").agg(F.min(F.struct("file_path", "file_block_start", "at")).alias("first")).orderBy("first").select("name")


def export_ndjson(memories: DataFrame, path: str, limit: int = 100_000) -> None:
    """Live memories by name as NDJSON: files in order of names, and lines within them."""
    from tessellar.operators import maintain, scans

    # Ranges are counted apart, so the limit needs no single task.
    first = maintain.numbered(scans.live(memories), ["name", "id"], "_n").where(F.col("_n") <= limit)
    first.repartitionByRange("_n").sortWithinPartitions("_n").drop("_n").write.mode("overwrite").json(path)


def export_lines(memories: DataFrame, limit: int | None = None) -> DataFrame:
    """(value): live memories as lines of NDJSON and, as one line more, a summary with their number, for a text writer."""
    from tessellar.operators import scans

    rows = scans.live(memories).select("name", "type", "body")
    rows = rows if limit is None else rows.orderBy("name").limit(limit)
    total = rows.agg(F.count(F.lit(1)).alias("exported")).select(F.to_json(F.struct(F.lit("summary").alias("kind"), "exported")).alias("value"))
    return rows.select(F.to_json(F.struct("name", "type", "body")).alias("value")).unionByName(total)


def graph_snapshot(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both names, and one row that counts those whose endpoint is missing."""
    n = entities.select("id", "name")
    ok = edges.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    lost = edges.join(n.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", "target_id").unionByName(edges.join(n.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(n.select(F.col("id").alias("target_id")), "target_id", "left_anti").select("source_id", "target_id"))
    return ok.select("source", "target", "relation", "weight"), lost.agg(F.count(F.lit(1)).alias("dangling"))


def graph_lines(entities: DataFrame, edges: DataFrame, form: str = "ndjson") -> DataFrame:
    """(value): a graph as lines of NDJSON, DOT or Mermaid, for a text writer."""
    named, _ = graph_snapshot(entities, edges)
    if form == "ndjson":
        nodes = entities.select(F.to_json(F.struct(F.lit("node").alias("kind"), "name", "type")).alias("value"))
        return nodes.unionByName(named.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "source", "target", "relation", "weight")).alias("value")))
    a, b = X.safe_id(F.col("source")), X.safe_id(F.col("target"))
    own = X.safe_id(F.col("name"))
    if form == "dot":
        nodes = entities.select(F.format_string('  %s [label="%s"];', own, "name").alias("value"))
        return nodes.unionByName(named.select(F.format_string('  %s -> %s [label="%s"];', a, b, "relation").alias("value")))
    nodes = entities.select(F.format_string('  %s["%s"]', own, "name").alias("value"))
    return nodes.unionByName(named.select(F.format_string("  %s -->|%s| %s", a, "relation", b).alias("value")))


#: First and last lines of a drawing.
FRAME = {"dot": (["digraph memory {", '  node [shape=box, style="rounded"];'], ["}"]), "mermaid": (["graph LR"], []), "ndjson": ([], [])}


def write_graph(entities: DataFrame, edges: DataFrame, path: str, form: str = "dot") -> None:
    """A graph as a whole drawing: text files that, one after the other by name, are the frame with its nodes and then its edges."""
    spark = entities.sparkSession
    body = graph_lines(entities, edges, form).select(F.when(F.col("value").rlike(_EDGE_LINE[form]), 2).otherwise(1).alias("place"), "value")
    head, foot = FRAME[form]
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, i, x) for i, x in enumerate(foot)], "place int, line int, value string")
    rows = body.select("place", F.lit(0).alias("line"), "value").unionByName(frame)
    rows.repartitionByRange("place", "line", "value").sortWithinPartitions("place", "line", "value").select("value").write.mode("overwrite").text(path)


_EDGE_LINE = {"dot": r"^  \S+ -> ", "mermaid": r"^  \S+ -->\|", "ndjson": '^[{]"kind":"edge"'}


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
