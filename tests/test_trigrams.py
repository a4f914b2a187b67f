import random
import time

from pyspark.sql import functions as F

from tessellar.functions import text as X


def windows(s):
    padded = "\0" + s + "\0"
    return {padded[i : i + 3] for i in range(len(s))}


def test_trigrams_are_windows_of_code_points(spark):
    texts = ["", "a", "ab", "aaaa", "a\n\r\nb", "né😀x😀😀", "😀", "x\0y", "漢字 é", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id long, s string").select("id", X.trigrams(F.col("s")).alias("t")).orderBy("id").collect()
    for r, s in zip(got, texts):
        assert (r.t is None) == (s is None)
        assert s is None or (set(r.t) == windows(s) and len(r.t) == len(windows(s)))


def test_trigrams_of_a_long_text_take_linear_time(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghij klmnö") for _ in range(600_000))
    df = spark.createDataFrame([(long, long[:300_000])], "x string, y string")
    start = time.monotonic()
    r = df.select(X.trigram_jaccard(F.col("x"), F.col("y")).alias("s"), X.grounding_coverage(F.col("x"), F.col("y")).alias("c")).first()
    assert time.monotonic() - start < 20
    both, every = len(windows(long) & windows(long[:300_000])), len(windows(long) | windows(long[:300_000]))
    assert r.s == both / every and r.c == both / len(windows(long))
