"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are native column expressions.  A forest and a series of
boosted trees are fitted on labelled rows; every path from a root down to a node
is a conjunctive rule.  A lasso logistic regression weighs the rules, most of
them to zero, and the rest compile to one Spark column expression, so scoring a
corpus is a projection: no Python and no shuffle.

The fit sees at most about ``max_rows`` labelled rows, drawn by a hash of their id
when there are more; scores are computed over every row.

Edge cases: a null text is an empty one, scored like any text; null labels are
left out, of several labels of a document the smallest holds; without labels of
both classes every score is the smoothed share of ones; repeated rows are each
scored; extra columns are passed on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

MAX_ROWS = 20_000
THRESHOLD = 0.3

#: In the order of the trees' features.
STATISTICS = ("n_words", "word_length", "upper", "marks", "odd_marks", "bangs", "digits", "distinct", "distinct_excess", "stops", "lines")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a double for each of ``STATISTICS``, over whole texts."""
    t = text_or_empty()
    first = docs.withColumns(
        {
            "_n": F.greatest(F.length(t), F.lit(1)).cast("double"),
            "_w": F.filter(F.split(t, r"\s+"), lambda w: w != ""),
            # Everything but letters and white space; short beside the text.
            "_m": F.regexp_replace(t, r"[\p{L}\s]+", ""),
            "_u": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("double"),
            "_l": F.size(F.split(t, "\n")).cast("double"),
        }
    )
    second = first.withColumns({"_c": F.greatest(F.size("_w"), F.lit(1)).cast("double"), "_d": F.size(F.array_distinct("_w")).cast("double")})

    def marks(pattern: str) -> Column:
        return F.length(F.regexp_replace("_m", pattern, "")).cast("double")

    third = second.withColumns(
        {
            "n_words": F.log1p(F.size("_w").cast("double")),
            "word_length": F.col("_n") / F.col("_c"),
            "upper": F.col("_u") / F.col("_n"),
            "marks": F.length("_m") / F.col("_n"),
            "odd_marks": marks(r"[^#$%&*|<>=_~^@{}\[\]\\+]+") / F.col("_c"),
            "bangs": marks(r"[^!?]+") / F.col("_c"),
            "digits": marks(r"[^0-9]+") / F.col("_c"),
            "distinct": F.col("_d") / F.col("_c"),
            # Texts repeat more words as they grow; this is what is left beside that.
            "distinct_excess": F.log(F.greatest(F.col("_d"), F.lit(1.0))) - F.lit(0.85) * F.log("_c"),
            "stops": marks(r"[^.]+") / F.col("_c"),
            "lines": F.col("_l") / F.col("_c"),
        }
    )
    return third.drop("_n", "_w", "_m", "_u", "_l", "_c", "_d")


@dataclass(frozen=True)
class RuleEnsemble:
    """An intercept and weighted conjunctions of (statistic, above, bound)."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...] = ()

    def score(self) -> Column:
        """The probability of label 1, over columns named as ``STATISTICS``."""
        total = F.lit(self.intercept)
        for weight, parts in self.rules:
            total = total + F.when(_holds(parts), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(parts) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(c) > bound) if above else (F.col(c) <= bound) for c, above, bound in parts])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document's label is never learned from: crc32 of its id as text, by the folds."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, trees: int = 16, boosts: int = 12, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Learn ``label`` from ``labels`` (doc_id, label) of documents that are not held out.

    The drawn labels, at most about ``max_rows``, are broadcast to the documents, so
    only drawn documents' statistics are computed for the fit.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("_y"))
    known = known.where(F.col("doc_id").isNotNull())
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    train = stored(with_statistics(drawn).drop("text"), "train")
    by = {r["_y"]: r["n"] for r in train.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = by.get(1.0, 0), by.get(0.0, 0)
    if not ones or not zeros:
        import math

        return RuleEnsemble(math.log((ones + 1) / (zeros + 1)))
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(train).select("_x", "_y", *STATISTICS).coalesce(4).cache()
    common = {"featuresCol": "_x", "labelCol": "_y", "maxDepth": depth, "seed": seed}
    grown = [
        RandomForestClassifier(numTrees=trees, minInstancesPerNode=5, **common).fit(rows),
        GBTClassifier(maxIter=boosts, minInstancesPerNode=5, **common).fit(rows),
    ]
    rules = sorted({r for model in grown for tree in model.trees for r in tree_paths(tree.toDebugString)})
    if not rules:
        import math

        return RuleEnsemble(math.log((ones + 1) / (zeros + 1)))
    names = [f"r{i}" for i in range(len(rules))]
    met = rows.select("_y", *[_holds(r).cast("double").alias(n) for n, r in zip(names, rules)])
    met = VectorAssembler(inputCols=names, outputCol="_r").transform(met).select("_r", "_y").cache()
    model = LogisticRegression(featuresCol="_r", labelCol="_y", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=80).fit(met)
    weighed = zip(model.coefficients.toArray().tolist(), rules)
    rows.unpersist()
    met.unpersist()
    return RuleEnsemble(float(model.intercept), tuple((w, r) for w, r in weighed if abs(w) > 1e-9))


def tree_paths(printed: str) -> set[tuple[tuple[str, bool, float], ...]]:
    """Every conjunction on a path from the root of a printed tree: each node's bounds, tightest per statistic and side."""
    out, path = set(), []
    for line in printed.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            path = path[: len(m[1]) - 2] + [(STATISTICS[int(m[2])], m[3] == ">", float(m[4]))]
            tight: dict[tuple[str, bool], float] = {}
            for c, above, bound in path:
                old = tight.get((c, above))
                tight[c, above] = bound if old is None else (max if above else min)(old, bound)
            out.add(tuple(sorted((c, above, bound) for (c, above), bound in tight.items())))
    return out


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit(docs, labels, **options)
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the same columns."""
    model = fit(docs, labels, **options)
    rows = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], "text")
    kept = with_statistics(rows).where(model.score() >= threshold)
    return kept.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
