"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host suffix with a path prefix (or a host pattern).  Its literal
tokens are the alphanumeric runs that every URL it fits must contain whole; it
is filed under the one that is rarest among the URLs at hand.  A URL's tokens
fetch the rules filed under them, and only those run regular expressions.  All
of it is DataFrame code.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no host rule and gets the default verdict; repeated rows are judged each; equal
long rules tie to the smaller rule string; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule sets up to this size travel in the plan as a literal; larger ones are joined.
LITERAL_RULES = 2_000
_RUN = re.compile(r"[A-Za-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<rule:string,verdict:string,host_re:string,path_re:string,rank:int>"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains with paths that start with ``path``; or, as a word, a part of a host name between dots and hyphens."""

    verdict: str
    host: str = ""
    path: str = ""
    word: str = ""

    @property
    def name(self) -> str:
        return f"~{self.word}" if self.word else f"{self.host}{self.path}"

    @property
    def host_re(self) -> str:
        if self.word:
            return rf"(^|[.-]){re.escape(self.word)}([.-]|$)"
        return rf"(^|\.){re.escape(self.host)}$" if self.host else ""

    @property
    def path_re(self) -> str:
        return "^" + re.escape(self.path) if self.path else ""

    @property
    def tokens(self) -> list[str]:
        """Runs that stand whole in every URL the rule fits: the path's last run may be a mere beginning."""
        path = _RUN.findall(self.path)
        if path and self.path[-1].isalnum():
            path.pop()
        return _RUN.findall(self.word) if self.word else _RUN.findall(self.host) + path


#: The method's own rules: words of host names that mark junk sites.
JUNK_WORDS = ["adult", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx"]
JUNK_RULES = [Rule("block", word=w) for w in JUNK_WORDS]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host between the first ``://`` and ``/?#`` with A-Z lower-cased, path up to ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.expr("substring(_rest, length(_host) + 1)")
    return rest, F.translate(host, _UPPER, _LOWER), path


def judge_urls(pages: DataFrame, rules: list[Rule], own_rules: list[Rule] = JUNK_RULES, default: str = "allow", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, own_rule) of every row.

    The longest fitting rule of ``rules`` decides; without one, ``own_rules``
    (any that fits blocks or allows, longest first), then ``default``.
    """
    spark = pages.sparkSession
    rest, host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("_rest", rest).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("_host", F.coalesce(F.substring_index("_rest", "/", 1), F.lit("")))
    urls = urls.withColumn("path", F.coalesce(path, F.lit(""))).select("page_id", "url", "host", "path")
    words = F.array_distinct(F.concat(F.split("host", "[^A-Za-z0-9]+"), F.split("path", "[^A-Za-z0-9]+"), F.array(F.lit(""))))
    filed = _filed(urls.select("host", "path"), words, [*[(0, r) for r in rules], *[(1, r) for r in own_rules]])
    if len(filed) <= literal_rules:
        index: dict[str, list] = {}
        for token, row in filed:
            index.setdefault(token, []).append(row)
        table = _literal(index)
        fetched = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.array().cast(f"array<{_RULE}>"))))
        judged = urls.withColumn("_fit", F.filter(fetched, _fits))
    else:
        # More rules than a plan should carry: distinct URLs meet the rules in a join on the filed token.
        rows = spark.createDataFrame([(t, r) for t, r in filed], f"token string, r {_RULE}")
        some = urls.select("host", "path").distinct()
        fits = some.withColumn("token", F.explode(words)).join(rows, "token").where(_fits(F.col("r")))
        fits = fits.groupBy("host", "path").agg(F.collect_set("r").alias("_fit"))
        judged = urls.join(fits, ["host", "path"], "left").withColumn("_fit", F.coalesce("_fit", F.array().cast(f"array<{_RULE}>")))
    return judged.select("page_id", "url", "host", "path", _longest(0).alias("_set"), _longest(1).alias("_own")).select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("_set.rule").alias("rule"),
        F.coalesce("_set.verdict", "_own.verdict", F.lit(default)).alias("verdict"),
        F.col("_own.rule").alias("own_rule"),
    )


def _fits(r: Column) -> Column:
    """The regular expressions of one fetched rule."""
    return F.rlike(F.col("host"), r["host_re"]) & F.rlike(F.col("path"), r["path_re"])


def _longest(rank: int) -> Column:
    """Of the fitting rules of one rank, the longest; of equally long ones the smallest."""
    own = F.filter("_fit", lambda r: r["rank"] == rank)
    best = F.array_sort(F.transform(own, lambda r: F.struct((-F.length(r["rule"])).alias("k"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.get(best, F.lit(0))


def _filed(urls: DataFrame, words: Column, rules: list[tuple[int, Rule]]) -> list[tuple[str, tuple]]:
    """(token, rule) with each rule under its rarest token; one without tokens stands under ''."""
    known = sorted({t for _, r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        spark = urls.sparkSession
        # One row per token of the rules comes back: bounded by the rules, not by the URLs.
        wanted = spark.createDataFrame([(t,) for t in known], "token string")
        found = urls.select(F.explode(words).alias("token")).join(F.broadcast(wanted) if len(known) <= LITERAL_RULES else wanted, "token")
        counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for rank, r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        out.append((token, (r.name, r.verdict, r.host_re, r.path_re, rank)))
    return out


def _literal(index: dict[str, list]) -> Column:
    import json

    names = ["rule", "verdict", "host_re", "path_re", "rank"]
    body = json.dumps({k: [dict(zip(names, r)) for r in v] for k, v in index.items()})
    return F.from_json(F.lit(body), f"map<string,array<{_RULE}>>")
