"""Entities by a name that may be misspelt: suggestions, and one accepted answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import text as X

#: A top suggestion is accepted from this score on if it leads by this margin, or alone from a lower one.
ACCEPT, MARGIN, ALONE = 0.90, 0.05, 0.85


def suggest(entities: DataFrame, query: str, least: float = 0.75, limit: int = 10) -> DataFrame:
    """(id, name, score) of the entities most like a name, ties by name and id.

    Column expressions settle most names; only the rest goes to Python.
    """
    tiered = entities.select("id", "name", X.entity_name_tier(query, F.col("name")).alias("score"))
    rest = tiered.where("score is null").withColumn("score", X.letters_similarity(query, F.col("name")))
    every = tiered.where("score is not null").unionByName(rest).withColumn("score", F.round("score", 6))
    return every.where(F.col("score") >= least).orderBy(F.desc("score"), "name", "id").limit(limit)


def resolve(entities: DataFrame, query: str, least: float = 0.75) -> DataFrame:
    """(id, name, score): the top suggestion if it is sure enough, else no row."""
    # Two suggestions at most.
    w = Window.orderBy(F.desc("score"), "name", "id")
    top = suggest(entities, query, least, 2).withColumns({"_n": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_n = 1")
    alone = F.col("_next").isNull()
    sure = ((F.col("score") >= ACCEPT) & (alone | (F.col("score") - F.col("_next") >= MARGIN))) | (alone & (F.col("score") >= ALONE))
    return top.where(sure).select("id", "name", "score")
