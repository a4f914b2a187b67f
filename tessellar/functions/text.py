"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellar import schema


@lru_cache
def _accent_map() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks, precomposed or combining."""
    marked, base = _accent_map()
    return F.regexp_replace(F.translate(c, marked, base), r"\p{M}+", "")


@lru_cache
def _compatible() -> tuple[str, str, list[str], list[str]]:
    """What compatibility decomposition leaves of a character in ASCII: characters that give one, with it, and those that give more, with them."""
    one, more = [], []
    for code in [*range(0xA0, 0xD800), *range(0xE000, 0x110000)]:
        left = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if x.isascii())
        if left:
            (one if len(left) == 1 else more).append((chr(code), left))
    return "".join(a for a, _ in one), "".join(b for _, b in one), [a for a, _ in more], [b for _, b in more]


def _character_class(chars: list[str]) -> str:
    """A pattern of the characters, neighbouring code points as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in ranges) + "]"


def ascii_form(c: Column) -> Column:
    """The ASCII characters of a text's compatibility decomposition: ``é`` and full-width ``Ｅ`` give one, ``ﬁ`` two, Cyrillic none."""
    single, its, several, theirs = _compatible()
    cut = "\x01"
    table = F.map_from_arrays(F.split(F.lit(cut.join(several)), cut), F.split(F.lit(cut.join(theirs)), cut))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    # Most texts are ASCII, and few others have characters that give several.
    whole = F.when(c.rlike(_character_class(several)), spelled).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(whole, single, its), r"[^\x00-\x7F]+", "")).otherwise(c)


def tokens(c: Column) -> Column:
    """Accent- and case-insensitive tokens: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), "")


def normalize_entity_name(c: Column) -> Column:
    """Kebab-case ASCII: compatibility forms decomposed, other non-ASCII dropped, the rest hyphens, collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_form(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def kebab_name(stem: Column, max_len: int = 60) -> Column:
    """A memory name from a file stem: marks and foreign characters dropped, blanks and underscores hyphens, ``doc-`` before a digit, cut."""
    low = F.regexp_replace(F.lower(F.regexp_replace(strip_accents(stem), r"[_\s]", "-")), r"[^a-z0-9-]+", "")
    trimmed = F.regexp_replace(F.regexp_replace(low, r"-+", "-"), r"^-+|-+$", "")
    named = F.when(trimmed.rlike("^[0-9]"), F.concat(F.lit("doc-"), trimmed)).otherwise(trimmed)
    return F.when(F.length(named) > max_len, F.regexp_replace(F.substring(named, 1, max_len), r"^-+|-+$", "")).otherwise(named)


def collapse_dashes(c: Column) -> Column:
    return F.regexp_replace(c, "-+", "-")


def normalize_relation(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit("_"))


# Relation aliases.
RELATION_ALIASES = {"adds": "causes", "creates": "causes", "implements": "supports", "blocks": "contradicts", "tested_by": "related", "related_to": "related", "part_of": "applies_to"}

# Entity-type aliases.
ENTITY_ALIASES = {
    "concept": "platform language feature framework library technology software service product system api component module package dependency protocol standard format algorithm pattern method function class interface command flag option config setting version release model metric topic skill reference note feedback url link keyword tag category",
    "file": "document doc artifact directory folder path repository repo codebase script",
    "person": "user author developer maintainer contributor agent owner assignee",
    "organization": "company org vendor group team department institution",
    "incident": "bug error failure outage vulnerability cve regression defect",
    "decision": "adr choice policy ruling",
    "date": "time datetime timestamp day month year deadline milestone",
    "location": "city country region place address site",
    "issue_tracker": "ticket issue jira github_issue pr pull_request",
    "dashboard": "panel board view report chart",
}


def canonical_relation(c: Column) -> Column:
    """One of the canonical relations; unknown labels become ``related``."""
    low = normalize_relation(c)
    out = F.when(low.isin(schema.RELATIONS), low)
    for alias, label in RELATION_ALIASES.items():
        out = out.when(low == alias, F.lit(label))
    return out.otherwise(F.lit("related"))


def is_canonical_relation(c: Column) -> Column:
    return c.isin(schema.RELATIONS)


def valid_relation(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_]*$")


def canonical_entity_type(c: Column) -> Column:
    """One of the canonical entity types; unknown labels become ``concept``."""
    low = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    out = F.when(low.isin(schema.ENTITY_TYPES), low)
    for label, aliases in ENTITY_ALIASES.items():
        out = out.when(low.isin(aliases.split()), F.lit(label))
    return out.otherwise(F.lit("concept"))


def valid_entity_name(c: Column) -> Column:
    """Two bytes or more, one line, not digits alone, not four or fewer capitals."""
    short_caps = (F.octet_length(c) <= 4) & c.rlike("^[A-Z_-]*$")
    return (F.octet_length(c) >= 2) & ~c.rlike(r"[\n\r]") & ~c.rlike("^[0-9]+$") & ~short_caps


def valid_memory_name(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9-]{0,78}[a-z0-9]$|^[a-z0-9]$")


def valid_namespace(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{1,80}$")


def jaro_winkler(query: str):
    """A pandas UDF of Jaro-Winkler similarity to a constant; Spark has no built-in."""
    @F.pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else _jaro_winkler(query, n))

    return score


def _jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    other = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    # The prefix counts only for pairs that are alike already.
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def entity_name_tier(query: str, name: Column) -> Column:
    """Tiers of likeness of an entity name to ``query``: equal, prefixes, first token, containment; null where only the letters can tell."""
    q = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query.strip())
    n = F.lower(F.trim(name))
    if not q:
        return F.lit(0.0)
    lit = F.lit(q)
    rest = F.substring(n, F.lit(len(q) + 1), F.lit(1))
    first = F.get(F.split(n, r"[-_\s]"), F.lit(0))
    out = F.when(n == "", 0.0).when(n == lit, 1.0)
    out = out.when(n.startswith(lit) & rest.isin("-", "_", " "), 0.95).when(n.startswith(lit), 0.88)
    out = out.when(lit.startswith(n) & (F.octet_length(n) >= 3), 0.80).when(first == lit, 0.92)
    if len(q.encode()) >= 3:
        out = out.when(n.contains(lit), 0.82)
    return out


def letters_similarity(query: str, name: Column) -> Column:
    """Jaro-Winkler of the trimmed, lower-cased name to ``query``."""
    q = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query.strip())
    return jaro_winkler(q)(F.lower(F.trim(name)))


def entity_name_similarity(query: str, name: Column) -> Column:
    """The tier of likeness, or else Jaro-Winkler."""
    return F.coalesce(entity_name_tier(query, name), letters_similarity(query, name))


def heuristic_description(body: Column, stem: Column | None = None) -> Column:
    """The first line of more than 20 bytes that is no header, cut to 100; else the stem; else a constant."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.get(F.filter(lines, lambda x: (F.octet_length(x) > 20) & ~x.startswith("#")), F.lit(0))
    own = F.when(F.octet_length(F.trim(stem)) >= 2, F.substring(F.trim(stem), 1, 100)) if stem is not None else F.lit(None)
    return F.coalesce(F.substring(first, 1, 100), own, F.lit("ingested document"))


def byte_prefix(c: Column, limit: Column) -> Column:
    """The longest prefix of whole characters in ``limit`` bytes."""
    data = F.encode(c, "UTF-8")

    def ends(back: int) -> Column:
        # A cut is between characters where the byte after it does not go on with one.
        following = F.hex(F.substring(data, limit - back + 1, F.lit(1)))
        return F.when(~following.between("80", "BF"), limit - back)

    at = F.coalesce(*[ends(back) for back in range(4)], F.lit(0))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substring(data, F.lit(1), at), "UTF-8"))


def partition_description(description: Column, i: Column, n: Column, limit: int = 500) -> Column:
    """The description with `` (part i/n)`` within the limit of bytes."""
    suffix = F.concat(F.lit(" (part "), i.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))
    return F.concat(byte_prefix(description, F.lit(limit) - F.octet_length(suffix)), suffix)


# Boilerplate of descriptions, lower-cased.
LOW_QUALITY = [
    "is a software component",
    "is a software system",
    "is a software application",
    "in the software project",
    "in the context of software",
    "of the software system",
    "in the software system",
    "software/system design",
    "is a configuration file",
    "a configuration file used",
    "generic configuration file",
    "configuration file in the software",
    "enhances chatbot",
    "chatbot response",
    "european digital identity",
]


def low_quality(c: Column) -> Column:
    """Boilerplate, or blank."""
    low = F.lower(c)
    out = F.trim(c) == ""
    for marker in LOW_QUALITY:
        out = out | low.contains(marker)
    return out


def generic_description(c: Column) -> Column:
    low = F.lower(c)
    return low.contains("ingested") | low.contains("imported") | low.contains("added") | (F.length(c) < 30)


def null_description(c: Column) -> Column:
    return c.isNull() | (c == "")


def short_body(c: Column, n: int = 500) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) < n


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def epoch_to_iso(epoch: Column, zone: str = "UTC") -> Column:
    """ISO 8601 with the zone's offset."""
    t = F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)
    minutes = ((F.unix_timestamp(t) - F.unix_timestamp(F.timestamp_seconds(epoch))) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def parse_expected_timestamp(c: Column) -> Column:
    """Epoch seconds, or an RFC 3339 time; null for neither."""
    whole = F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    return F.coalesce(whole, F.unix_seconds(F.try_to_timestamp(c)))


def parse_bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off", ""), False)


# What a version's reason is called.
ACTIONS = {"create": "created", "edit": "edited", "update": "updated", "rename": "renamed", "restore": "restored", "merge": "merged", "forget": "forgotten"}


def change_action(c: Column) -> Column:
    out = F.when(F.lit(False), c)
    for reason, action in ACTIONS.items():
        out = out.when(c == reason, action)
    return out.otherwise(c)


def token_estimate(c: Column) -> Column:
    """Three tokens for two words, rounded up."""
    words = F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")
    return F.ceil(F.size(words) * F.lit(1.5))


def passage_tokens(c: Column) -> Column:
    """The estimate for a text as it is embedded: with the word ``passage:`` before it."""
    words = F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")
    return F.ceil((F.size(words) + 1) * F.lit(1.5))


def score_from_distance(d: Column) -> Column:
    return F.when(F.isnan(d), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - d)))


def hop_distance(hop: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (hop + 1)


def rank_distance(rank: Column) -> Column:
    """Of a 0-based rank."""
    return F.lit(1.0) - F.lit(1.0) / (rank + 1)


def decay_score(seed: Column, hop: Column, decay: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), seed * F.pow(F.lit(decay), hop)))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.lit("pair"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def parse_pair_key(c: Column) -> Column:
    """(low, high) of a pair key, or null."""
    ok = c.rlike(r"^pair:-?\d+:-?\d+$")
    return F.when(ok, F.struct(F.split(c, ":")[1].cast("bigint").alias("low"), F.split(c, ":")[2].cast("bigint").alias("high")))


def safe_id(c: Column) -> Column:
    """An identifier for graph drawings."""
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def backoff_ms(attempt: Column, initial: int = 1000, multiplier: int = 2, limit: int = 60_000) -> Column:
    """The delay before an attempt, without jitter."""
    return F.least(F.lit(initial) * F.pow(F.lit(multiplier), attempt), F.lit(limit)).cast("bigint")


def valid_source(c: Column) -> Column:
    return c.isin(schema.MEMORY_SOURCES)


URL = r"https?://[^\s)\]}\"'<]*"


def extract_urls(c: Column) -> Column:
    """array<struct<url, start, end>> with byte offsets: addresses up to white space or a closing mark."""
    found = F.regexp_extract_all(c, F.lit(URL), F.lit(0))
    # The text before a match is what the matches and the gaps before it add up to.
    gaps = F.split(c, URL, -1)
    at = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, g: s + F.octet_length(g)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda s, g: s + F.octet_length(g)),
    )
    rows = F.zip_with(found, at, lambda u, s: F.struct(u.alias("url"), s.alias("start"), (s + F.octet_length(u)).alias("end")))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<url:string,start:int,end:int>>"))


def trigrams(c: Column) -> Column:
    """The set of three-character windows around each character, with NUL beyond the ends; in one pass over the text."""
    padded = F.concat(F.lit("\0"), c, F.lit("\0"))
    # Each match takes one character and looks at the two after it.
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))."), F.lit(1)))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(trigrams(a), trigrams(b))


def set_jaccard(ta: Column, tb: Column) -> Column:
    """Of two sets as arrays; those of two empty texts are equal."""
    both = F.size(F.array_intersect(ta, tb))
    union = F.size(ta) + F.size(tb) - both
    return F.when(union == 0, 1.0).otherwise(both.cast("double") / union)


def preservation(original: Column, rewritten: Column, threshold: float = 0.7) -> Column:
    """unchanged, preserved or rejected."""
    t = min(max(threshold, 0.0), 1.0)
    return F.when(original == rewritten, "unchanged").when(trigram_jaccard(original, rewritten) >= t, "preserved").otherwise("rejected")


def grounding_coverage(candidate: Column, evidence: Column) -> Column:
    return set_coverage(trigrams(candidate), trigrams(evidence))


def set_coverage(ta: Column, tb: Column) -> Column:
    """The share of the first set that the second holds."""
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(F.size(F.array_intersect(ta, tb)) / F.size(ta))


def grounded(candidate: Column, evidence: Column, threshold: float = 0.12, min_chars: int = 40) -> Column:
    """Whether a text is supported by its evidence: always by too little evidence, by half the threshold for little."""
    e = F.trim(F.coalesce(evidence, F.lit("")))
    bound = F.when(F.length(e) < 2 * min_chars, threshold * 0.5).otherwise(threshold)
    return (F.length(e) < max(min_chars, 1)) | (grounding_coverage(candidate, e) >= bound)
