"""Spelling variants by anagram hashing: words within one edit of each other, and the frequent form of each.

A word's key is the sum of a fifth power per letter, whatever their order.  Words one edit apart have keys
that differ by one letter's value (added or removed) or by the difference of two (exchanged), so a word meets
the others through its own key and through its key without each of its letters: equal keys after one
removal on either side, or on one.  The fifth powers of any two letters of the alphabet have a sum of their own, so
a pair meets by one pair of letters only.  Anagrams share keys, so a key goes with the first or with the last half
of the letters: one edit leaves one of them as it is.  Letter order is then verified.

Everything after the count of words is a join or a grouping of the vocabulary; a group of equal keys is a join's, never one row's.
No side of a join is broadcast: a vocabulary of a few MB of files has hundreds of MB of keys.

Edge cases: a null text has no words; a null document id is written as nothing before the colon; repeated rows
count again; ties of frequency go to the smallest word in code-point order; an empty table gives no words;
long runs of letters are words like others; no other columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unsized

#: The letters that words have: first and last code point of each range.
LETTERS = ((0x61, 0x7A), (0xC0, 0xFF))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_value(letter: Column) -> Column:
    """The fifth power of a letter's place in the alphabet, from 1."""
    (a, z), (first, _) = LETTERS
    code = F.ascii(letter)
    place = F.when(code <= z, code - (a - 1)).otherwise(code - (first - (z - a) - 2))
    place = place.cast("bigint")
    return place * place * place * place * place


def anagram_key(word: Column) -> Column:
    """The sum of the letters' values."""
    return F.aggregate(F.transform(F.split(word, ""), letter_value), F.lit(0).cast("bigint"), lambda s, v: s + v)


def occurrences(docs: DataFrame, least: int = 6, noise: int | None = 199) -> DataFrame:
    """(word): every run of letters of every text, A-Z lower-cased, if it has ``least`` letters or more.

    ``noise`` makes misspellings, for tests of what follows: of a run whose CRC-32, with its document's id, it divides, one letter goes.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if noise is None:
        return found.select(F.col("run").alias("word"))
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least)


def vocabulary(words: DataFrame, often: int = 5) -> DataFrame:
    """(word, n) of words that occur ``often`` or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, from both sides, once each."""
    keyed = vocab.select("word", "n", anagram_key(F.col("word")).alias("key"))
    # Without a letter: less its value, and one shorter.
    letters = F.array_distinct(F.split("word", ""))
    whole = F.struct(F.col("key").alias("key"), F.length("word").alias("size"))
    less = F.transform(letters, lambda c: F.struct((F.col("key") - letter_value(c)).alias("key"), (F.length("word") - 1).alias("size")))
    met = keyed.select("word", "n", F.col("key").alias("own"), F.explode(F.concat(F.array(whole), less)).alias("k")).select("word", "n", "own", "k.*")
    half = F.floor(F.col("size") / 2).cast("int")
    start, end = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - half + 1, half)
    sided = met.withColumn("start", start).withColumn("at", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("start").alias("part")), F.struct(F.lit(False).alias("first"), end.alias("part"))))).select("word", "n", "own", "key", "size", "start", "at.*")
    a, b = sided.alias("a"), unsized(sided.alias("b"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "size", "first", "part")]
    # Words of one key are anagrams, never one edit apart; a pair that both halves bring together comes by the first.
    fresh = (F.col("a.own") != F.col("b.own")) & (F.col("a.first") | (F.col("a.start") != F.col("b.start")))
    return a.join(b, [*same, fresh, F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1]).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): where the chain of forms (word, form) from a word ends; each round doubles the steps taken.

    Forms grow in frequency, so chains end; more than ``rounds`` rounds raise an error.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(unsized(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return now
        now = new.drop("moved")
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def variants(vocab: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (word, n).

    The form is the near word of largest n, the smallest in code-point order of several, if its n is ``times`` the word's or more;
    the root is where the forms lead from a word.
    """
    vocab = stored(vocab.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_pairs(vocab).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("m"))
    held = -F.col("m.n") >= F.lit(times) * F.col("n")
    near = stored(best.select("word", "n_near", F.when(held, F.col("m.word")).alias("form"), F.when(held, -F.col("m.n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null"))
    out = vocab.join(unsized(near), "word", "left").join(unsized(ends), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
