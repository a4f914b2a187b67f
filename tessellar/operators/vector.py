"""Exact vector search in generated code."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this width a product with a constant vector is one generated expression.
UNROLLED = 256
#: Rounds of a memory search by candidates, and candidates at most in one: what the driver holds.
ROUNDS, MOST = 2, 1 << 16


def _dot(e: Column, q: list[float]) -> Column:
    if len(q) <= UNROLLED:
        return reduce(lambda a, b: a + b, [F.get(e, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)])
    other = F.array(*[F.lit(float(x)) for x in q])
    return F.aggregate(F.zip_with(e, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def _square(e: Column, dim: int) -> Column:
    if dim <= UNROLLED:
        return reduce(lambda a, b: a + b, [F.get(e, F.lit(i)).cast("double") * F.get(e, F.lit(i)).cast("double") for i in range(dim)])
    return F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def cosine_to(e: Column, q: list[float]) -> Column:
    """Cosine of a vector column with a constant; zero where a norm is zero."""
    norm = sum(float(x) * float(x) for x in q) ** 0.5
    if norm == 0:
        return F.lit(0.0)
    own = F.sqrt(_square(e, len(q)))
    return F.when(own == 0, 0.0).otherwise(_dot(e, q) / (own * F.lit(norm)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; zero where widths differ or a norm is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb))


def truncated(e: Column, dim: int) -> Column:
    """The first components, not normalised again."""
    return F.slice(e, 1, dim)


def of_width(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dim)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id") -> DataFrame:
    """(id, distance): the k nearest of the query's width, ties by id; sorts only per-partition tops."""
    near = of_width(vectors, len(query)).select(F.col(id_col).alias("id"), (F.lit(1.0) - cosine_to(F.col("embedding"), query)).alias("distance"))
    return near.orderBy("distance", "id").limit(k)


def memory_knn(embeddings: DataFrame, memories: DataFrame, query: list[float], k: int, namespaces: tuple[str, ...] = (), kind: str | None = None, live_after_k: bool = False) -> DataFrame:
    """(id, distance) of live memories.  ``live_after_k`` drops the deleted after the cut instead, so fewer may come back.

    The nearest candidates alone look for their memories, by id: twice as many as are asked for, then more where too few of them are wanted ones;
    past ``ROUNDS`` rounds all ids meet all memories in a join.
    """
    from tessellar.operators import scans

    own = scans.of_type(scans.in_namespace(memories, *namespaces), kind).select("id", "deleted_at")
    wanted = own if live_after_k else scans.live(own)
    # Distances first: what meets the memories is two numbers a row, not the vectors.
    near = of_width(embeddings, len(query)).select(F.col("memory_id").alias("id"), (F.lit(1.0) - cosine_to(F.col("embedding"), query)).alias("distance"))
    nearest, take = None, 2 * k
    for _ in range(ROUNDS):
        if take > MOST:
            break
        first = near.orderBy("distance", "id").limit(take).collect()
        kept = {r.id for r in scans.picked(wanted, [r.id for r in first]).select("id").collect()}
        found = [(r.id, r.distance) for r in first if r.id in kept]
        if len(found) >= k or len(first) < take:
            kind_of = own.schema["id"].dataType.simpleString()
            nearest = own.sparkSession.createDataFrame(found[:k], f"id {kind_of}, distance double")
            break
        take *= 8
    if nearest is None:
        nearest = near.join(wanted.select("id"), "id", "left_semi").orderBy("distance", "id").limit(k)
    if live_after_k:
        nearest = nearest.join(scans.live(own).select("id"), "id", "left_semi")
    return nearest


def entity_knn(embeddings: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(entity_id, similarity), most similar first."""
    near = of_width(embeddings, len(query)).select("entity_id", cosine_to(F.col("embedding"), query).alias("similarity"))
    return near.orderBy(F.desc("similarity"), "entity_id").limit(k)


def chunk_knn(embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """(memory_id, chunk_idx, similarity); the chunk index is always 0."""
    near = of_width(embeddings, len(query)).select("memory_id", F.lit(0).alias("chunk_idx"), cosine_to(F.col("embedding"), query).alias("similarity"))
    return near.orderBy(F.desc("similarity"), "memory_id").limit(k)


def mean_pool(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the mean of a group's vectors, scaled to length one if its norm exceeds 1e-9."""
    means = vectors.select(by, F.posexplode("embedding").alias("pos", "v")).groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    pooled = means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    return pooled.withColumn("n", norm).select(by, F.when(F.col("n") > 1e-9, F.transform("e", lambda v: v / F.col("n"))).otherwise(F.col("e")).alias("embedding"))


def upsert(vectors: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The snapshot with new vectors in place of old; empty ones are skipped."""
    fresh = new.where(F.size("embedding") > 0)
    return vectors.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return vectors.join(ids.select(key), key, "left_anti")


def orphans(embeddings: DataFrame, memories: DataFrame) -> DataFrame:
    """Vectors whose memory is missing or deleted."""
    from tessellar.operators import scans

    return embeddings.join(scans.live(memories).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


def missing(embeddings: DataFrame, memories: DataFrame, dim: int) -> DataFrame:
    """Live memories without a vector of the width."""
    from tessellar.operators import scans

    return scans.live(memories).join(of_width(embeddings, dim).select(F.col("memory_id").alias("id")), "id", "left_anti")


def coverage(embeddings: DataFrame, memories: DataFrame, dim: int) -> DataFrame:
    """One row: live memories, those without a vector, orphan vectors, and the share covered in percent."""
    from tessellar.operators import scans

    total = scans.live(memories).agg(F.count(F.lit(1)).alias("total"))
    lack = missing(embeddings, memories, dim).agg(F.count(F.lit(1)).alias("missing"))
    lost = orphans(embeddings, memories).agg(F.count(F.lit(1)).alias("orphans"))
    pct = F.when(F.col("total") == 0, 100.0).otherwise(F.round((F.col("total") - F.col("missing")) * 100.0 / F.col("total"), 6))
    return total.crossJoin(lack).crossJoin(lost).withColumn("coverage_pct", pct)


def status(memories: DataFrame, memory_vectors: DataFrame, entities: DataFrame, entity_vectors: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """(target, total, missing, orphans, coverage_pct) of live memories, entities and chunks: what has no vector of any width, and vectors of nothing."""
    from tessellar.operators import scans

    out = None
    for target, rows, vectors, key in (("memory", scans.live(memories), memory_vectors, "memory_id"), ("entity", entities, entity_vectors, "entity_id"), ("chunk", chunks, chunk_vectors, "chunk_id")):
        have = vectors.select(F.col(key).alias("id"), F.lit(True).alias("have")).distinct()
        met = rows.select("id", F.lit(True).alias("row")).join(have, "id", "full_outer")
        one = met.agg(F.count("row").alias("total"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("row").isNull()).alias("orphans"))
        pct = F.when(F.col("total") == 0, 100.0).otherwise(F.round((F.col("total") - F.col("missing")) * 100.0 / F.col("total"), 6))
        one = one.select(F.lit(target).alias("target"), "*", pct.alias("coverage_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def dims(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def embed_text(dim: int = 1024):
    """A deterministic stand-in for an embedding service: tokens hashed to two buckets each, scaled to length one."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t or "", dim))

    return run


def hashed_vector(text: str, dim: int) -> list[float]:
    import re

    v = [0.0] * dim
    for token in re.findall(r"[^\W_]+", text.lower()):
        # FNV-1a, 64 bits.
        h = 0xCBF29CE484222325
        for byte in token.encode():
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        v[h % dim] += 1.0
        v[(h >> 32) % dim] += 0.5
    norm = sum(x * x for x in v) ** 0.5
    if norm == 0:
        v[0], norm = 1.0, 1.0
    return [x / norm for x in v]
