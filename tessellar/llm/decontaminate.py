"""Benchmark decontamination by spaced-seed hashing.

Words are the lower-cased runs of letters and digits.  A fixed mask lays
over each word position and hashes only the words under its ones, so a changed
word under a zero does not spoil the hash.  Test and training hashes meet in a
join, which leaves a row per document, item and diagonal; the words are fetched for those alone, laid on
the diagonal and compared word by word over the whole test item: ``min_words`` item words or more
in a row of which ``similarity`` or more are equal are an overlap.  All of it is
DataFrame code.

A test set is small beside a corpus; its seeds (hash, item, place) are broadcast only after their
count is checked against ``broadcast_seeds``, and shuffled otherwise; so are the hits and the items' words.

Edge cases: a null or empty text has no words and meets nothing; an item shorter
than a mask is hashed whole, and must be equal in all words; an item without words meets nothing;
repeated rows are each judged, and a pair of ids is returned once; ties of overlaps go to the leftmost best;
overlaps are returned at their whole length; a null document id is returned as it is, a null item id is left out;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Fixed masks of weight four: ones are compared, zeros are free.  Of an overlap of five words or more with four fifths
#: equal and both ends equal, every pattern is hit: s changed words leave s + 1 gaps that hold 4s equal words or more, so
#: one holds four, or s is three at most and two neighbours hold two each, or one word of five next to an end is changed.
MASKS = ("1111", "11011", "10111", "11101")
#: Rows of three numbers that are broadcast: some 40 MB.
MAX_SEEDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(df: DataFrame, masks: list[tuple[int, str]], *keep: str) -> DataFrame:
    """(keep..., at, seed) for each position ``at`` and each (salt, mask) that fits there.

    Two explodes of one row after another and no union: the generated code holds a document's words
    once, by reference, while its positions stream past.
    """
    least = min(len(m) for _, m in masks)
    hashed = df.where(F.size("words") >= least).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    at = hashed.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - least)))
    own = [F.when(F.col("at") + len(m) <= F.size("words"), F.xxhash64(F.lit(salt), *[F.get("hashes", F.col("at") + i) for i, c in enumerate(m) if c == "1"])) for salt, m in masks]
    return at.select(*keep, "at", F.explode(F.array(*own)).alias("seed")).where(F.col("seed").isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = 13, similarity: float = 0.8, broadcast_seeds: int = MAX_SEEDS, by_text: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): each document and item that overlap, with their longest overlap.

    With ``by_text`` rows that repeat an id keep apart by their text, and its ``xxhash64`` is returned as text_hash.
    """
    longest = max(len(m) for m in masks)
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    # Items may repeat an id, too.
    items = stored(items.withColumn("item", F.xxhash64("item_id", "words")), "items")
    # Items shorter than a mask are hashed whole; their lengths are fewer than the longest mask's.
    short = sorted(r[0] for r in items.where(F.size("words") < longest).select(F.size("words")).distinct().collect())
    every = [(mask, F.size("words") >= longest) for mask in masks] + [("1" * n, F.size("words") == n) for n in short]
    test = None
    for salt, (mask, fit) in enumerate(every):
        own = _seeds(items.where(fit), [(salt, mask)], "item").withColumnRenamed("at", "item_at")
        test = own if test is None else test.unionByName(own)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    train = _seeds(texts, [(salt, mask) for salt, (mask, _) in enumerate(every)], "doc_id", "text_hash")
    few = (items.agg(F.sum(F.size("words"))).first()[0] or 0) * len(every) <= broadcast_seeds
    # Most hits of a passage lie on one diagonal; repeated rows' on the same.
    hits = train.join(F.broadcast(test) if few else test, "seed").select("doc_id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("diag")).distinct()
    hits = stored(hits, "hits")
    met = hits.select(F.col("doc_id").alias("hit_id"), "text_hash").distinct()
    held = texts.join(small(met), (texts["text_hash"] == met["text_hash"]) & texts["doc_id"].eqNullSafe(F.col("hit_id")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    laid = held.join(hits.withColumnRenamed("doc_id", "hit_id"), (held["text_hash"] == hits["text_hash"]) & held["doc_id"].eqNullSafe(F.col("hit_id")))
    words = items.select("item", "item_id", F.col("words").alias("item_words"))
    laid = laid.select("doc_id", held["text_hash"], "words", "item", "diag").join(small(words, broadcast_seeds // 100), "item")
    m = F.size("item_words")
    same = laid.select("doc_id", "text_hash", "item_id", "diag", m.alias("m"), _equal_at().alias("equal"))
    whole = F.col("m") < longest
    need, share = F.when(whole, F.col("m")).otherwise(F.least(F.lit(min_words), F.col("m"))), F.when(whole, F.lit(1.0)).otherwise(F.lit(similarity))
    same = same.where(F.size("equal") >= F.ceil(need * share))
    best = same.select("doc_id", "text_hash", "item_id", "diag", _longest_run(need, share).alias("b")).where(F.col("b").isNotNull())
    ids = ["doc_id", *["text_hash"] * by_text, "item_id"]
    return (
        best.groupBy(*ids)
        .agg(F.min(F.struct((-F.col("b.n_words")).alias("n"), (-F.col("b.n_equal")).alias("e"), (F.col("diag") + F.col("b.at")).alias("at"))).alias("m"))
        .select(*ids, F.col("m.at").cast("long").alias("start_word"), (-F.col("m.n")).cast("long").alias("n_words"), (-F.col("m.e")).cast("long").alias("n_equal"))
    )


def _equal_at() -> Column:
    """Item positions whose word equals the document's on the diagonal."""
    lead = F.greatest(-F.col("diag"), F.lit(0))
    last = F.least(F.size("item_words"), F.size("words") - F.col("diag")) - 1
    return F.filter(F.sequence(lead, last), lambda i: F.get("words", F.col("diag") + i) == F.get("item_words", i))


def _longest_run(need: Column, share: Column) -> Column:
    """The longest run between two equal words that is long enough and equal enough; null if none.

    It begins where equal words begin and ends where they end, so only those places are paired.
    """
    places = F.transform("equal", lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    begins = F.filter(places, lambda s: (s["k"] == 0) | (F.get("equal", s["k"] - 1) != s["p"] - 1))
    ends = F.filter(places, lambda s: (s["k"] == F.size("equal") - 1) | (F.get("equal", s["k"] + 1) != s["p"] + 1))

    def begun(b: Column) -> Column:
        runs = F.transform(ends, lambda e: F.struct((e["p"] - b["p"] + 1).alias("n_words"), (e["k"] - b["k"] + 1).alias("n_equal"), (-b["p"]).alias("back")))
        return F.array_max(F.filter(runs, lambda s: (s["n_equal"] > 0) & (s["n_words"] >= need) & (s["n_equal"] >= s["n_words"] * share)))

    top = F.array_max(F.filter(F.transform(begins, begun), lambda s: s.isNotNull()))
    return F.when(top.isNotNull(), F.struct(top["n_words"].alias("n_words"), top["n_equal"].alias("n_equal"), (-top["back"]).alias("at")))
