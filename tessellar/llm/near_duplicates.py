"""N-gram Jaccard join by MinHash banding.

1. A task turns texts to shingle sets and MinHash signatures; band and row
   counts are chosen so that a pair at the threshold meets in some band with the
   target recall.  Texts with the same words are one node from here on.
2. Nodes shuffle on band hashes.  Of buckets of up to ``bucket`` nodes all pairs are
   candidates; sizes too unlike for the threshold drop out unread.
3. Nodes of larger buckets form groups, the connected components of nodes and buckets, so a node is in one group
   however many buckets it shares.  A group is dealt by hash to blocks of about ``block`` nodes or ``block_shingles``
   shingles, and pairs of blocks are compared in a task each, on whole shingle sets by matrix products: every
   pair of a group once.  Such a task returns a spanning forest of its links and a count per node, never the pairs.
   Links of n similar texts can only be counted in n * n / 2 comparisons; a text is sent once to each block of its group.
4. Every candidate is verified on the full sets; connected components of the
   verified links are the classes.

Every candidate pair is verified: pairs of two nodes of large buckets in 3, all others in 2.

Edge cases: a null or empty text, or one of white space alone, has no shingles: it
is a class of its own without links, as its copies are; rows that repeat an id are documents each; a null id is never a class id unless its class has no other; a text of
fewer words than a shingle has one shingle; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, sliced, stored

MAX_HASHES = 80


def bands_for(threshold: float, recall: float = 0.9999, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold`` with at most ``max_hashes`` hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def signatures(docs: DataFrame, bands: int, rows: int, size: int, seed: int = 3) -> DataFrame:
    """(doc_id, text_hash, key, n, bands): the same words give the same key; n counts shingles."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from .shingles import mixed, shingles, words

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

        def signed(s):
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            with np.errstate(over="ignore"):
                for i in range(0, len(s), 2048):
                    low = np.minimum(low, (a[:, None] * s[None, i : i + 2048] + b[:, None]).min(1))
                out = salt.copy()
                for r in range(rows):
                    out = mixed(out + low[r::rows])
            return out.astype(np.int64)

        for batch in sliced(batches):
            keys, n, sigs = [], [], []
            for t in batch.column("text").to_pylist():
                own = words(t)
                keys.append(xxhash.xxh3_128_digest(" ".join(own)))
                s = np.unique(shingles(own, size))
                n.append(len(s))
                sigs.append(signed(s) if len(s) else np.empty(0, np.int64))
            edges = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), lists], ["doc_id", "text_hash", "key", "n", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows_.mapInArrow(run, "doc_id long, text_hash long, key binary, n int, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import jaccard, shingle_set

        sets: dict[bytes, object] = {}

        def of(key, column, i):
            s = sets.get(key)
            if s is None:
                if len(sets) >= 256:
                    sets.clear()
                s = sets[key] = shingle_set(column[i].as_py(), size)
            return s

        for x in sliced(batches):
            ka, kb, ta, tb = x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("ta"), x.column("tb")
            keep = [jaccard(of(p, ta, i), of(q, tb, i)) >= threshold for i, (p, q) in enumerate(zip(ka, kb))]
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(keep, pa.bool_())), x.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _crowded(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, size: int, block: int, block_shingles: int) -> DataFrame:
    """(a, b, links): for nodes of large buckets, a spanning forest of links within each pair of blocks, and how many links ``a`` has there."""
    firsts = members.groupBy("band", "value").agg(F.min("key").alias("b"))
    groups = components(members.join(firsts, ["band", "value"]).select(F.col("key").alias("a"), "b"))
    held = stored(groups.withColumnRenamed("node", "key").join(nodes.select("key", "copies", "n"), "key"), "groups")
    sized = held.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / block_shingles)).cast("int").alias("nb"))
    held = held.join(sized, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "copies", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = dealt.join(texts, "key")

    def run(keys, pdf):
        import numpy as np
        import pandas as pd

        from .shingles import shingle_set

        i, j = int(keys[1]), int(keys[2])
        pdf = pdf.sort_values("key").reset_index(drop=True)
        sets = [shingle_set(t, size) for t in pdf["text"]]
        n = np.array([len(s) for s in sets], np.float64)
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n.astype(int))
        values, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(seen > 1)
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        both = np.zeros((len(sets), len(sets)), np.float32)
        col = place[at]
        for lo in range(0, len(shared), 4096):
            inside = (col >= lo) & (col < lo + 4096)
            m = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
            m[who[inside], col[inside] - lo] = 1
            both += m @ m.T
        linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
        np.fill_diagonal(linked, False)
        if i != j:
            # Pairs within one block are another task's.
            side = pdf["own"].to_numpy()
            linked &= side[:, None] != side[None, :]
        links = (linked * pdf["copies"].to_numpy()[None, :]).sum(1)
        root = np.arange(len(sets))
        for k in range(len(sets)):
            # The smallest root that a node's links lead to; repeated until it settles.
            near = np.flatnonzero(linked[k])
            if len(near):
                low = min(root[k], root[near].min())
                old = {root[k], *root[near]}
                root[np.isin(root, list(old))] = low
        keep = (root != np.arange(len(sets))) | (links > 0)
        return pd.DataFrame({"a": pdf["key"][keep], "b": pdf["key"].to_numpy()[root[keep]], "links": links[keep].astype(np.int64)})

    return full.groupBy("root", "i", "j").applyInPandas(run, "a binary, b binary, links long")


def classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.9999, bucket: int = 64, block: int = 1024, block_shingles: int = 1 << 20, with_keys: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the smallest id of its class, and how many other documents it is similar to.

    With ``with_keys`` also text_hash, the text's ``xxhash64``, and class_key, which tells classes apart where ids repeat; null for texts without words.
    """
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, bands, rows, size), "signed")
    nodes = stored(
        signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("x")).select("key", "rep", "copies", F.col("x.doc_id").alias("doc_id"), "x.text_hash", "x.n", "x.bands"),
        "nodes",
    )
    spread = nodes.select("key", "n", F.posexplode("bands").alias("band", "value"))
    counts = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = stored(spread.join(counts, ["band", "value"]), "members")
    hot = members.where(F.col("held") > bucket).select("key").distinct().withColumn("hot", F.lit(True))
    members = stored(members.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "members")

    few = members.where(F.col("held") <= bucket).groupBy("band", "value").agg(F.sort_array(F.collect_list(F.struct("key", "n", "hot"))).alias("m"))
    two = F.flatten(
        F.transform(
            "m",
            lambda x, i: F.transform(
                F.filter(F.slice("m", i + 2, F.size("m")), lambda y: ~(x["hot"] & y["hot"]) & (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * threshold)),
                lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")),
            ),
        )
    )
    pairs = stored(few.select(F.explode(two).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    crowd = members.where("hot")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(crowd.select("key")).distinct()
    named = nodes.join(wanted, "key").select("doc_id", "text_hash", "key")
    # An id may be null or repeat, so a text is fetched by id and text.
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.xxhash64("text").alias("text_hash"), "text")
    texts = own.join(named.select(F.coalesce("doc_id", F.lit(0)).alias("i"), "text_hash", "key"), ["i", "text_hash"]).select("key", "text").dropDuplicates(["key"])
    texts = stored(texts, "texts")

    found = stored(_verified(pairs, texts, threshold, size), "found")
    forest = stored(_crowded(crowd, nodes, texts, threshold, size, block, block_shingles), "forest")
    roots = components(found.unionByName(forest.select("a", "b")))
    copies = nodes.select("key", "copies")
    counted = (
        found.join(copies.withColumnRenamed("key", "b"), "b")
        .select(F.col("a").alias("key"), F.col("copies").alias("links"))
        .unionByName(found.join(copies.withColumnRenamed("key", "a"), "a").select(F.col("b").alias("key"), F.col("copies").alias("links")))
        .unionByName(forest.select(F.col("a").alias("key"), "links"))
        .groupBy("key")
        .agg(F.sum("links").alias("links"))
    )
    placed = nodes.select("key", "rep", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    info = placed.join(ids, "root").join(counted, "key", "left").select("key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("root").alias("class_key"))
    # Documents without words share a key but no class.
    names = ["doc_id", "class_id", "n_links", *(["text_hash", "class_key"] if with_keys else [])]
    some = signed.where("n > 0").select("doc_id", "text_hash", "key").join(stored(info, "info"), "key").select(*names)
    none = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(None).cast("binary").alias("class_key"))
    return some.unionByName(none.select(*names))
