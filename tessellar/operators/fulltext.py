"""BM25 full-text search over name, description and body, by an inverted index in Parquet.

The index is sorted by term over its files, so a query, whose terms are prefixes, reads the row groups
whose statistics hold one of them; it never reads a body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.functions import text as X
from tessellar.operators import scans
from tessellar.operators.chunking import _let
from tessellar.storage import shared_path, snapshot

K1, B = 1.2, 0.75
#: Ids up to which a join sends them to all tasks.
FEW = 1_000_000


@dataclass(frozen=True)
class Match:
    """Prefix terms that must all occur, or any of them, beside a phrase of them; whose rows hold a term, so it finds no more."""

    terms: tuple[str, ...]
    every: bool
    phrase: tuple[str, ...] = ()


def parse_query(raw: str) -> Match:
    """The query language: syntax marks and operator words dropped; a separator inside makes the terms alternatives."""
    clean = re.sub(r'["*()^:]', "", raw).strip()
    parts = re.split(r"[-._/\s]+" if re.search(r"[-._/]", clean) else r"\s+", clean)
    terms = tuple(t for t in parts if t and t.upper() not in ("OR", "AND", "NOT", "NEAR"))
    if re.search(r"[-._/]", clean):
        return Match(terms, False, terms)
    return Match(terms, True)


def _term(t: str) -> str:
    """A term as the tokenizer writes it."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))


def document_tokens(memories: DataFrame) -> DataFrame:
    """(id, namespace, type, toks) of live memories, the three columns as one text."""
    joined = F.concat_ws(" ", "name", "description", "body")
    return scans.live(memories).select("id", "namespace", "type", X.tokens(joined).alias("toks"))


@dataclass(frozen=True)
class Index:
    """``postings`` (term, id, tf, dl, namespace, type) in order of terms, and ``totals`` (n, tokens), one row; of live memories."""

    postings: DataFrame
    totals: DataFrame


def _counted(toks: Column) -> Column:
    """(term, tf) of an array of tokens; one without tokens has none."""

    def runs(toks: Column) -> Column:
        # Equal tokens stand together in the sorted array: a term's count is how far on the next one begins.
        at = F.filter(F.sequence(F.lit(1), F.size(toks)), lambda i: (i == 1) | (F.get(toks, i - 1) != F.get(toks, i - 2)))
        return _let(at, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(toks) + 1)), lambda i, j: F.struct(F.get(toks, i - 1).alias("term"), (j - i).cast("bigint").alias("tf"))))

    return F.when(F.size(toks) > 0, _let(F.sort_array(toks), runs))


def build_index(memories: DataFrame, path: str | None = None) -> Index:
    """Read and tokenize every live memory once, and write its terms, for many searches.  A term of very many memories spreads over several files."""
    path = path or shared_path(memories.sparkSession, "text-index")
    laid = snapshot(_terms(memories, lambda toks: toks), "terms")
    rows = laid.where("term is not null").drop("first")
    rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    _totals(laid).write.parquet(f"{path}/totals")
    return open_index(memories, path)


def index_for(memories: DataFrame, *queries: str) -> Index:
    """An index of the terms alone that some queries ask for: every live memory is tokenized once, and no term is shuffled."""
    wanted = list(dict.fromkeys(_term(t) for q in queries for t in parse_query(q).terms))
    asked = lambda w: reduce(lambda a, b: a | b, [w.startswith(t) for t in wanted], F.lit(False))
    laid = snapshot(_terms(memories, lambda toks: F.filter(toks, asked)), "terms")
    return Index(laid.where("term is not null").drop("first"), _totals(laid))


def _terms(memories: DataFrame, kept) -> DataFrame:
    """(first, term, id, tf, dl, namespace, type) of the tokens that ``kept`` leaves; a memory without any has one row, without a term."""
    docs = document_tokens(memories).withColumn("dl", F.size("toks").cast("bigint"))
    rows = docs.select("id", "namespace", "type", "dl", F.posexplode_outer(_counted(kept(F.col("toks")))).alias("i", "w"))
    return rows.select((F.coalesce("i", F.lit(0)) == 0).alias("first"), "w.term", "id", "w.tf", "dl", "namespace", "type")


def _totals(laid: DataFrame) -> DataFrame:
    return laid.agg(F.count_distinct("id").alias("n"), F.coalesce(F.sum(F.when(F.col("first"), F.col("dl"))), F.lit(0)).cast("bigint").alias("tokens"))


def open_index(memories: DataFrame, path: str) -> Index:
    spark = memories.sparkSession
    kind = memories.schema["id"].dataType.simpleString()
    return Index(spark.read.schema(f"term string, id {kind}, tf bigint, dl bigint, namespace string, type string").parquet(f"{path}/postings"), spark.read.schema("n bigint, tokens bigint").parquet(f"{path}/totals"))


def bm25(memories: DataFrame, query: str, limit: int, namespaces: tuple[str, ...] = (), kind: str | None = None, index: Index | None = None) -> DataFrame:
    """(id, score), best first, ties by id; of some namespaces, or of all.  Without an index the memories are read through once.

    Corpus statistics are over all live memories.
    """
    match = parse_query(query)
    terms = list(dict.fromkeys(_term(t) for t in match.terms))
    if not terms:
        return memories.select("id", F.lit(0.0).alias("score")).limit(0)
    index = index or index_for(memories, query)
    # Prefixes reach the scan; a term counts for each of the query's that it begins with.
    begins = [F.col("term").startswith(t) for t in terms]
    read = index.postings.where(reduce(lambda a, b: a | b, begins))
    tf = [F.coalesce(F.sum(F.when(b, F.col("tf"))), F.lit(0)).cast("double") for b in begins]
    counted = snapshot(read.groupBy("id", "dl", "namespace", "type").agg(F.array(*tf).alias("tf")).withColumn("dl", F.col("dl").cast("double")), "counted")
    # Totals are one row; it is joined, so the plan stays one and lazy.
    found = counted.agg(F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0).cast("double") for i in range(len(terms))]).alias("df"))
    totals = index.totals.select(F.col("n").cast("double").alias("n"), (F.col("tokens") / F.col("n")).alias("avgdl")).where("n > 0").crossJoin(F.broadcast(found))
    hit = [F.get("tf", F.lit(i)) > 0 for i in range(len(terms))]
    cond = hit[0]
    for h in hit[1:]:
        cond = (cond & h) if match.every else (cond | h)
    if namespaces:
        cond = cond & F.col("namespace").isin(*namespaces)
    if kind is not None:
        cond = cond & (F.col("type") == kind)
    hits = counted.where(cond).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _part(F.get("tf", F.lit(i)), F.get("df", F.lit(i)))
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _part(tf: Column, df: Column) -> Column:
    idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def postings(memories: DataFrame) -> DataFrame:
    """The index: (term, id, tf).  A memory's terms are counted where it is read; only ids that several rows have are grouped."""
    rows = document_tokens(memories).select("id", F.inline(_counted(F.col("toks")))).select("term", "id", "tf")
    repeated = scans.live(memories).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if repeated.isEmpty() else rows.groupBy("term", "id").agg(F.sum("tf").alias("tf"))


def lengths(memories: DataFrame) -> DataFrame:
    """(id, dl) of every live memory."""
    return document_tokens(memories).select("id", F.size("toks").cast("bigint").alias("dl"))


def index_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("term").alias("terms"), F.count_distinct("id").alias("documents"), F.sum("tf").alias("tokens"))


def top_terms(index: DataFrame, n: int) -> DataFrame:
    by = index.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("tokens"))
    return by.orderBy(F.desc("documents"), "term").limit(n)


def check_index(index: DataFrame, memories: DataFrame) -> DataFrame:
    """(problem, id): live memories with tokens that the index lacks, and indexed ids that are not live."""
    want = lengths(memories).where("dl > 0").select("id")
    have = index.select("id").distinct()
    return want.join(have, "id", "left_anti").select(F.lit("missing").alias("problem"), "id").unionByName(have.join(want, "id", "left_anti").select(F.lit("stale").alias("problem"), "id"))


def sync_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some memories changed: their postings replaced, those of deleted ones gone."""
    ids = snapshot(changed.select("id").distinct(), "changed")
    # Few ids go to where the postings are.
    gone = F.broadcast(ids) if ids.count() <= FEW else ids
    return index.join(gone, "id", "left_anti").select(*index.columns).unionByName(postings(changed).select(*index.columns))
