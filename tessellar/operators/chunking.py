"""Chunking and partitioning of bodies: where look-back rules out column expressions, Arrow UDFs; token offsets are native."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk and of its overlap, and of a partition.
CHUNK, OVERLAP, PARTITION = 800, 100, 80 * 1024
CHUNKS = "array<struct<chunk_idx:int,chunk_text:string,start_offset:int,end_offset:int,token_count:int>>"


def _cut(data: bytes, i: int, step: int) -> int:
    """The nearest character boundary at or beside ``i``."""
    while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
        i += step
    return min(max(i, 0), len(data))


def chunk_spans(body: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte spans: a window backs up to a paragraph, a sentence or a word's end, and the next begins in its overlap."""
    data = body.encode()
    if len(data) <= size:
        return [(0, len(data))]
    spans, start = [], 0
    while True:
        stop = _cut(data, min(start + size, len(data)), -1)
        if stop < len(data):
            for mark in (b"\n\n", b". ", b" "):
                at = data.rfind(mark, start, stop)
                if at >= 0:
                    stop = at + len(mark)
                    break
        if stop <= start:
            stop = _cut(data, min(start + size, len(data)), -1)
            stop = stop if stop > start else len(data)
        spans.append((start, stop))
        if stop >= len(data):
            return spans
        following = _cut(data, stop - overlap, 1)
        # A window no longer than the overlap would begin again where it began.
        start = following if start < following < stop else stop


def chunked(c: Column, spans=chunk_spans) -> Column:
    """The chunks of a body with byte offsets, by one of the splitters; two characters count as a token."""
    @F.pandas_udf(CHUNKS)
    def run(bodies: pd.Series) -> pd.Series:
        def one(body):
            if body is None:
                return []
            data = body.encode()
            texts = [(a, b, data[a:b].decode()) for a, b in spans(body)]
            return [{"chunk_idx": i, "chunk_text": t, "start_offset": a, "end_offset": b, "token_count": len(t) // 2} for i, (a, b, t) in enumerate(texts)]

        return bodies.map(one)

    return run(c)


def chunks(memories: DataFrame, spans=chunk_spans) -> DataFrame:
    """(memory_id, chunk_idx, chunk_text, start_offset, end_offset, token_count)."""
    return memories.select(F.col("id").alias("memory_id"), F.inline(chunked(F.col("body"), spans)))


#: Strengths of breaks: after a word, a sentence, a line, a block, a rule, and before a heading of the sixth to the first level.
WORD, SENTENCE, LINE, BLOCK, RULE, HEADING = 1, 2, 3, 4, 5, 12
_MARKS = re.compile(r"(?P<fence>^ {0,3}(?:```|~~~).*\n?)|(?P<rule>^ {0,3}([-*_])(?:[ \t]*\3){2,}[ \t]*\n)|(?P<heading>^ {0,3}(?P<hashes>#{1,6})(?=[ \t\n]|\Z))|(?P<blank>\n(?:[ \t]*\n)+)|(?P<line>\n)|(?P<sentence>[.!?…][\"')\]]*[ \t]+)|(?P<word>[^\S\n]+)", re.M)


def markdown_breaks(body: str) -> dict[int, int]:
    """Where a body may be cut, and how strong a break is there; inside a code fence only lines and words part."""
    found: dict[int, int] = {}
    fenced = False

    def add(at: int, strength: int) -> None:
        found[at] = max(strength, found.get(at, 0))

    at = 0
    while m := _MARKS.search(body, at):
        kind, at = m.lastgroup if m.lastgroup != "hashes" else "heading", m.end()
        if kind == "fence":
            # A fence belongs to its block: the break is before the opening and after the closing one.
            add(m.end() if fenced else m.start(), BLOCK)
            add(m.end(), LINE)
            fenced = not fenced
        elif kind == "heading":
            add(m.start(), LINE if fenced else HEADING - len(m["hashes"]))
        elif kind == "rule":
            add(m.end(), LINE if fenced else RULE)
        elif kind == "blank":
            add(m.end(), LINE if fenced else BLOCK)
        elif kind == "line":
            add(m.end(), LINE)
        elif kind == "sentence":
            add(m.end(), WORD if fenced else SENTENCE)
        else:
            add(m.end(), WORD)
    return {p: s for p, s in found.items() if 0 < p < len(body)}


def markdown_spans(body: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte spans of a Markdown body, ``size`` characters or fewer each, that cover it in order.

    A chunk ends at the last of the strongest breaks that it can reach, and where there is none, when it is full.  The next begins
    within its last ``overlap`` characters: at the first of the strongest breaks there, or as early as it may.
    """
    breaks = markdown_breaks(body)
    at = sorted(breaks)
    strength = [breaks[p] for p in at]

    def best(low: int, high: int, last: bool) -> int | None:
        """The strongest break of ``low`` to ``high``."""
        i, j = bisect_left(at, low), bisect_right(at, high)
        if i == j:
            return None
        top = max(strength[i:j])
        return at[j - 1 - strength[i:j][::-1].index(top) if last else i + strength[i:j].index(top)]

    spans, start, stop = [], 0, 0
    while stop < len(body):
        full = start + size
        following = len(body) if full >= len(body) else best(stop + 1, full, True) or full
        spans.append((start, following))
        stop = following
        if stop < len(body):
            low = max(stop - overlap, start + 1)
            start = best(low, stop - 1, False) or low
    known, before, total = {}, 0, 0
    for p in sorted({p for span in spans for p in span}):
        total += len(body[before:p].encode())
        known[p], before = total, p
    return [(known[a], known[b]) for a, b in spans]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(lengths: Column) -> Column:
    """For each value of an array the sum of it and those before it.

    In blocks of the root of the array's size: blocks sum up by themselves, then their totals do, so no array grows value by value over the whole.
    """
    zero, nothing = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def summed(values: Column) -> Column:
        first = F.struct(zero.alias("sum"), nothing.alias("out"))
        step = lambda now, v: F.struct((now["sum"] + v).alias("sum"), F.concat(now["out"], F.array(now["sum"] + v)).alias("out"))
        return F.aggregate(values, first, step, lambda end: end["out"])

    def whole(values: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
        starts = _let(side, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), n), lambda i: F.struct(i.alias("i"), n.alias("n"))))
        blocks = F.transform(starts, lambda s: summed(F.slice(values, s["i"], s["n"])))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = summed(F.transform(blocks, lambda b: F.coalesce(F.get(b, F.size(b) - 1), zero)))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(zero), totals), lambda b, before: F.transform(F.coalesce(b, nothing), lambda v: v + before)))

    return _let(F.transform(lengths, lambda v: v.cast("bigint")), whole)


def token_offsets(c: Column, prefix: str = "") -> Column:
    """The byte spans (start, stop) of a text's white-space tokens, after a prefix; a null text has none."""
    text = F.concat(F.lit(prefix), F.coalesce(c, F.lit("")))
    # White space and tokens by turns, white space first: the first piece may be empty.
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)(\s*)(\S+)"), F.lit(0))

    def spans(words: Column) -> Column:
        lengths = F.transform(words, lambda w: F.struct(F.octet_length(w).alias("all"), F.octet_length(F.regexp_replace(w, r"(?U)^\s+", "")).alias("own")))
        return _let(lengths, lambda n: F.zip_with(running_sum(F.transform(n, lambda x: x["all"])), n, lambda stop, x: F.struct((stop - x["own"]).alias("start"), stop.alias("stop"))))

    return _let(pieces, spans)


def token_spans(offsets: Column, text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows (chunk_idx, start_offset, end_offset, token_count) over a text's token offsets; the first begins and the last ends with the text."""

    def windows(own: Column) -> Column:
        n = F.size(own)
        # A window that reaches the end is the last.
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: (i == 0) | (i + overlap < n))

        def window(i: Column, k: Column) -> Column:
            end = F.least(i + size, n)
            return F.struct(
                k.alias("chunk_idx"),
                F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(own, i)["start"]).alias("start_offset"),
                F.when(end == n, F.octet_length(text).cast("bigint")).otherwise(F.get(own, end - 1)["stop"]).alias("end_offset"),
                (end - i).alias("token_count"),
            )

        return F.transform(starts, window)

    return _let(offsets, windows)


def token_windows(c: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of white-space tokens, joined by blanks; each next begins ``overlap`` before the end."""
    words = F.array_remove(F.split(c, r"\s+"), "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap)), lambda i: (i == 0) | (i + overlap < F.size(words)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def sections(body: str, limit: int = PARTITION) -> list[str]:
    """A body in parts of at most ``limit`` bytes: whole sections under headers packed greedily, larger ones cut."""
    if len(body.encode()) <= limit:
        return [body]
    parts, current = [], ""
    for section in re.split(r"(?m)^(?= *#{1,6}(?:[ \t\n]|$))", body):
        if current and len(current.encode()) + len(section.encode()) > limit:
            parts.append(current)
            current = ""
        current += section
    parts.append(current)
    out = []
    for part in parts:
        data, at = part.encode(), 0
        while at < len(data):
            stop = _cut(data, min(at + limit, len(data)), -1)
            stop = stop if stop > at else _cut(data, at + 1, 1)
            out.append(data[at:stop].decode())
            at = stop
    return out or [body]


def partitioned(c: Column, limit: int = PARTITION) -> Column:
    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [] if b is None else sections(b, limit))

    return run(c)


def budget(memories: DataFrame, limit: int = PARTITION) -> DataFrame:
    """(id, bytes, tokens, chunks, partitions, exceeds)."""
    from tessellar.functions import text as X

    sized = memories.select("id", F.octet_length("body").cast("bigint").alias("bytes"), X.token_estimate(F.col("body")).alias("tokens"), F.size(chunked(F.col("body"))).alias("chunks"), F.size(partitioned(F.col("body"), limit)).alias("partitions"))
    return sized.withColumn("exceeds", F.col("partitions") > 1)
