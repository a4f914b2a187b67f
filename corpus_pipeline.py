"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes what its predecessor kept, as written and read again, and works
on all of it; all but the last return the columns of ``documents``.

Edge cases: what a stage decides holds for a row, not for its id: rows that repeat an id or have none are judged
by their own texts.  A null text is an empty one; ties are settled by id, then by the text's hash; an
empty table gives an empty result; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import decontaminate, line_dedup, near_duplicates, packing, quality
from tessellar.llm.common import stored
from tessellar.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the largest id; texts and their lengths change accordingly."""
    kept = line_dedup.dedupe(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row whole beside its id and its text's hash, by which rows are told apart: ids may repeat or be null, and extra columns may have any name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The keyed rows of ``docs`` without those whose id and text hash are in ``gone`` (doc_id, text_hash)."""
    own, gone = _keyed(docs), gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_th")).distinct()
    return own.join(gone, own["id"].eqNullSafe(gone["gone_id"]) & (own["th"] == gone["gone_th"]), "left_anti")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the smallest id stays, and of its texts that with the smallest hash; a null id only where no other is.

    Of rows with one id and one text, one stays. Texts without words have no duplicates: all their rows stay.
    """
    found = stored(near_duplicates.classes(docs, with_keys=True).select("doc_id", "text_hash", "class_key"), "classes")
    first = found.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r"))
    gone = found.join(first, "class_key").where(~(F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("text_hash") == F.col("r.text_hash"))))
    kept = _without(docs, gone)
    wordless = F.regexp_replace(F.coalesce("row.text", F.lit("")), r"(?U)[\s\x1c-\x1f]+", "") == ""
    some = kept.where(~wordless).dropDuplicates(["id", "th"])
    return _unpacked(some.unionByName(kept.where(wordless)), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps a benchmark item go."""
    leaks = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), by_text=True)
    return _unpacked(_without(docs, leaks), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens with the mixture of its sources."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack),
]

#: The first stage is a fitted model, which SQL cannot express; a test holds the other stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
