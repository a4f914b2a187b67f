"""Recall, hybrid search and research: compositions of vector, text and graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import fulltext, fusion, graph, scans, vector
from tessellar.storage import snapshot

SNIPPET = 300


def check_k(k: int) -> int:
    if not 1 <= k <= 4096:
        raise ValueError("k must lie in 1..=4096")
    return k


def hybrid(memories: DataFrame, embeddings: DataFrame, query_vector: list[float], query: str, k: int = 10, weight_vec: float = 1.0, weight_fts: float = 1.0, rrf_k: int = fusion.RRF_K, namespaces: tuple[str, ...] = (), kind: str | None = None, index: fulltext.Index | None = None) -> DataFrame:
    """Vector and BM25 candidates, 2k each, fused by weighted reciprocal ranks; with names and snippets."""
    check_k(k)
    near = fusion.ranked(vector.memory_knn(embeddings, memories, query_vector, 2 * k, namespaces, kind), "distance", "id")
    if weight_fts == 0:
        found = near.select("id", "rank").limit(0)
    else:
        found = fusion.ranked(fulltext.bm25(memories, query, 2 * k, namespaces, kind, index), F.desc("score"), "id").select("id", "rank")
    fused = snapshot(fusion.fuse(near.select("id", "rank"), found, k, weight_vec, weight_fts, rrf_k), "fused")
    # At most k ids: they reach the scan of the memories.
    named = scans.picked(scans.live(memories), [r.id for r in fused.select("id").collect()])
    rows = fused.join(named.select("id", "name", F.substring("body", 1, SNIPPET).alias("snippet")), "id")
    return rows.select("id", "name", F.round("score", 9).alias("score"), F.round("normalized_score", 9).alias("normalized_score"), "vec_rank", "fts_rank", "source", "snippet").orderBy(F.desc("score"), "id")


def expand(edges: DataFrame, bridge: DataFrame, memories: DataFrame, results: DataFrame, max_hops: int = 2, floor: float = 0.3, limit: int | None = 50, entity_seeds: DataFrame | None = None) -> DataFrame:
    """(id, name, hop, distance, source): memories that the graph reaches from results, beside them."""
    found = graph.reach_memories(edges, bridge, memories, results, max_hops, floor, entity_seeds)
    rows = found.join(scans.live(memories).select("id", "name"), "id").select("id", "name", "hop", F.round(X.hop_distance(F.col("hop")), 6).alias("distance"), F.lit("graph").alias("source")).orderBy("hop", "id")
    return rows.limit(limit) if limit else rows


def hybrid_expanded(memories: DataFrame, embeddings: DataFrame, edges: DataFrame, bridge: DataFrame, query_vector: list[float], query: str, k: int = 10, entity_embeddings: DataFrame | None = None, max_hops: int = 2, floor: float = 0.3, most: int | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Hybrid hits, and memories that the graph reaches from them and from the entities nearest to the query, beside them."""
    hits = snapshot(hybrid(memories, embeddings, query_vector, query, k, **how), "hits")
    seeds = vector.entity_knn(entity_embeddings, query_vector).select(F.col("entity_id").alias("id")) if entity_embeddings is not None else None
    if hits.isEmpty():
        return hits, expand(edges, bridge, memories, hits, 0, floor, most)
    return hits, expand(edges, bridge, memories, hits, max_hops, floor, most, seeds)


def recall(memories: DataFrame, embeddings: DataFrame, edges: DataFrame, bridge: DataFrame, query_vector: list[float], k: int = 10, max_hops: int = 2, floor: float = 0.3, namespaces: tuple[str, ...] = (), entity_embeddings: DataFrame | None = None, max_distance: float = 1.0) -> DataFrame:
    """Direct neighbours and what the graph reaches from them: (id, name, distance, score, hop, source).

    A ``max_distance`` under 1 asks that some direct hit is within it; it never removes hits.
    """
    check_k(k)
    direct = snapshot(vector.memory_knn(embeddings, memories, query_vector, k, namespaces), "direct")
    if max_distance < 1.0 and direct.where(F.col("distance") <= max_distance).isEmpty():
        raise LookupError("no memory within the distance")
    named = direct.join(scans.picked(scans.live(memories), [r.id for r in direct.select("id").collect()]).select("id", "name"), "id")
    seeds = vector.entity_knn(entity_embeddings, query_vector).select(F.col("entity_id").alias("id")) if entity_embeddings is not None else None
    more = expand(edges, bridge, memories, direct, max_hops, floor, None, seeds)
    own = named.select("id", "name", F.round("distance", 6).alias("distance"), F.lit(None).cast("bigint").alias("hop"), F.lit("direct").alias("source"))
    both = own.unionByName(more.select("id", "name", "distance", "hop", "source"))
    return both.withColumn("score", F.round(X.score_from_distance(F.col("distance")), 6))


def fts_fallback(memories: DataFrame, query: str, k: int, index: fulltext.Index | None = None) -> DataFrame:
    """(id, rank, distance, source): text search where no query vector can be had; the distance follows the rank."""
    hits = fusion.ranked(fulltext.bm25(memories, query, k, index=index), F.desc("score"), "id")
    return hits.select("id", "rank", F.round(X.rank_distance(F.col("rank") - 1), 6).alias("distance"), F.lit("fts_fallback").alias("source"))


# Phrases that part a question, in order, and facets of a bare word.
RELATIONAL = [" that caused ", " depending on ", " related to ", " connected to ", " linked to ", " caused by ", " followed by "]
ASPECTS = ["patrimonio", "stack", "tecnologia", "stakeholders", "pessoas", "projeto", "decisao", "relacionamento", "contexto", "architecture", "history"]


def decompose(query: str, most: int = 7) -> list[tuple[str, str]]:
    """(text, source) of a question's parts: by relational phrases, else semicolons, else conjunctions and commas, else its edge words, else facets."""
    parts, rest = [], query
    for phrase in RELATIONAL:
        at = rest.lower().find(phrase)
        if at >= 0:
            left, right = rest[:at].strip(), rest[at + len(phrase) :].strip()
            parts += [left] if left else []
            rest = right or rest
            parts.append(None)
    if None in parts:
        named = [p for p in parts if p is not None] + [rest]
        return [(p, "decomposed") for p in named][:most]
    by = query.split(";")
    if len(by) == 1:
        by = re.sub(r" (?:and|AND|e|E) ", ", ", query).split(",")
    if len(by) > 1 and any(p.strip() for p in by):
        return [(p.strip(), "decomposed") for p in by if p.strip()][:most]
    long = [w for w in query.split() if len(w.encode()) > 2]
    if len(long) >= 3:
        return [(query, "original"), (f"{long[0]} {long[1]}", "decomposed"), (f"{long[-2]} {long[-1]}", "decomposed")][:most]
    if len(query.split()) == 1:
        word = query.strip()
        return [(word, "original"), *[(f"{word} {a}", "aspect") for a in ASPECTS]][:most]
    return [(query, "original")]


def manual_parts(spark, path: str, most: int = 7) -> list[tuple[str, str]]:
    """(text, source) of a file of sub-queries, a line each in the file's order, without blank lines and comments."""
    # A file that someone wrote by hand: one row.
    text = spark.read.text(path, wholetext=True).first()
    lines = [x.strip() for x in re.split(r"\r?\n", text.value if text else "")]
    parts = [(x, "manual") for x in lines if x and not x.startswith("#")][:most]
    if not parts:
        raise ValueError(f"no sub-query in {path}")
    return parts


def research(memories: DataFrame, embeddings: DataFrame, edges: DataFrame, bridge: DataFrame, parts: list[tuple[str, list[float]]], k: int = 10, max_hops: int = 2, floor: float = 0.3, decay: float = 0.7, most: int = 50, index: fulltext.Index | None = None) -> DataFrame:
    """(id, score, source, sub_queries): each part's hybrid hits and what the graph reaches from them, merged by best score.

    A reached memory scores the mean of the part's hits, decayed by its hop; of equal scores the earliest part's holds.
    """
    out, index = None, index or fulltext.index_for(memories, *[q for q, _ in parts])
    for i, (query, query_vector) in enumerate(parts):
        # At most k rows, read several times below.
        hits = snapshot(hybrid(memories, embeddings, query_vector, query, k, index=index).select("id", F.col("normalized_score").alias("score"), "source"), "hits")
        mean = hits.agg(F.coalesce(F.avg("score"), F.lit(0.5)).alias("mean"))
        near = graph.reach_memories(edges, bridge, memories, hits, max_hops, floor).crossJoin(mean)
        near = near.select("id", X.decay_score(F.col("mean"), F.col("hop"), decay).alias("score"), F.lit("graph").alias("source"))
        one = hits.unionByName(near).withColumn("part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "part", "source")).alias("m"), F.sort_array(F.collect_set("part")).alias("sub_queries"))
    return best.select("id", F.round(-F.col("m.s"), 6).alias("score"), F.col("m.source").alias("source"), "sub_queries").orderBy(F.desc("score"), "id").limit(most)


def merge_chains(per_part: DataFrame) -> DataFrame:
    """Of chains (part, from_id, to_id, path, product) the first part's of each pair, heaviest first."""
    w = Window.partitionBy("from_id", "to_id").orderBy("part", F.desc("product"))
    first = per_part.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.where(F.size("path") >= 3).orderBy(F.desc("product"), "from_id", "to_id")
