"""Line dedup with levelled sorted runs of line hashes.

``LineRuns`` keeps, per line key, how many documents hold it and the largest id
that does, in runs sorted by key hash.  A batch of documents adds one run to
level 0; when a level has ``fanout`` runs they are compacted to one run of the
next level.

``dedupe`` takes documents in batches of falling ids.  Each new batch is merge-anti-joined with the runs'
settled keys, those that ``min_docs`` documents hold already: their largest id is known and every
later line of them is lost, so the batch adds what is left as its own run and a line that
most documents hold is carried only until it is settled.  At the end lines meet the settled keys and are
lost to them, except in the largest id.  All of it is DataFrame code; what is shuffled are hashes and positions, and
the text once, to meet the positions it loses.  Keys that very many documents hold meet their lines by a
broadcast: they are few, since each has ``hot`` documents or more.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; keys under ``min_chars`` code points are never dropped.  Keys are
held as two 64-bit hashes.

Edge cases: a null text is one empty line and so is an empty one; rows that
repeat a ``doc_id`` are one document as holder of lines and are each returned; a
null ``doc_id`` holds nothing and loses nothing; an empty table gives an empty
result; extra columns of the input are returned as they are by ``dedupe``, but for
columns named as its own two counts, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, small, stored

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): a row per line long enough, without its text."""
    lines = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    keyed = F.transform(F.filter(lines, lambda s: F.length(s["k"]) >= min_chars), lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["k"]).alias("h1"), F.xxhash64(F.lit(1), s["k"]).alias("h2")))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(keyed))


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, top): level i holds at most ``fanout`` - 1 runs between batches."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def add(self, lines: DataFrame, min_docs: int | None = None) -> None:
        """A new batch's own run.  A document's lines belong to one batch.

        With ``min_docs``, keys that so many documents of former batches hold are left out: batches must come in order of falling ids.
        """
        held = lines.select("h1", "h2", "doc_id").distinct()
        run = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
        if min_docs is not None and (settled := self.settled(min_docs)) is not None:
            run = run.join(settled.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(stored(run.sortWithinPartitions("h1", "h2"), "run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(stored(self._merged(self.levels[level]).sortWithinPartitions("h1", "h2"), "run"))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out if len(runs) == 1 else out.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def merged(self) -> DataFrame | None:
        """Every key of every run once, or None without runs."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    def settled(self, min_docs: int) -> DataFrame | None:
        """The keys that ``min_docs`` documents or more hold, or None without runs."""
        runs = self.merged()
        return None if runs is None else runs.where(F.col("docs") >= min_docs)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines of a new batch that no run holds: for first-comer dedup of a stream of batches."""
        runs = self.merged()
        return lines if runs is None else lines.join(runs.select("h1", "h2"), ["h1", "h2"], "left_anti")


def _batched(docs: DataFrame, lines: DataFrame, batches: int) -> list[DataFrame]:
    """``lines`` written once in ``batches`` ranges of ids, the largest ids first; all lines of a document are in one."""
    if batches == 1:
        return [stored(lines, "lines")]
    # Where ranges end matters to their sizes only.
    ends = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
    batch = sum((F.col("doc_id") <= end).cast("int") for end in ends) if ends else F.lit(0)
    path = shared_path(docs.sparkSession, "lines")
    lines = lines.withColumn("batch", batch.cast("int"))
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    rows = docs.sparkSession.read.schema(lines.schema).parquet(path)
    return [rows.where(F.col("batch") == b).drop("batch") for b in range(batches)]


def dedupe(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 4, hot: int = 10_000) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and n_lines (before) and n_dropped."""
    runs = LineRuns(docs.sparkSession, fanout)
    parts = _batched(docs, line_hashes(docs, min_chars), batches)
    for lines in parts:
        runs.add(lines, min_docs)
    common = runs.settled(min_docs).select("h1", "h2", "top", "docs")
    common = stored(common, "common")
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    # A settled key's count stops at its batch, so a hot one shows in the batch that settles it.
    frequent = small(common.where(F.col("docs") >= hot).select("h1", "h2", F.col("top").alias("hot_top")))
    met = lines.join(frequent, ["h1", "h2"], "left")
    held = met.where("doc_id < hot_top").drop("hot_top").unionByName(met.where("hot_top is null").drop("hot_top").join(common.where(F.col("docs") < hot), ["h1", "h2"]).where("doc_id < top").select(*lines.columns))
    lost = held.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("lost"))
    # The text meets its lost positions by document and text, so rows that repeat an id keep apart; the row is packed, so no name clashes.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    met = own.join(lost, ["doc_id", "text_hash"], "left").withColumn("lines", lines_of(F.col("row.text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"), lambda i: F.get("lines", i))
    text = F.when(F.col("lost").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return met.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
