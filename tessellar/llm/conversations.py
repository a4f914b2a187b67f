"""Repair of conversations by the cheapest edits that give ``system? (user assistant)+`` or nothing.

Windows flag each row's fault.  A conversation's rows, sorted, are one array, and ``aggregate()`` carries over it
four structs (cost, audit), one for each state of the pattern: nothing yet, after a system, a user, an assistant row.
A row's step tries to keep, rerole or delete it from every state, then to insert; ``least`` of two structs is the
cheaper, or of equal ones that with the smaller audit.  Two edit strings of equal cost that end in one state
after the same rows are never one the beginning of the other, so the smaller beginning stays the smaller.

A conversation of more than ``SEGMENT`` rows is cut in segments of consecutive rows: rows are sorted by range over all
tasks, each segment folds from each of the four states, and a second fold over the segments joins the
sixteen results of each.  Sorting, faults and the work on rows are spread; only the row of the result is as long as its conversation.

Edge cases: null ids form one conversation, whose id is null; a null role or text, and in the keys of ``damaged`` a null id or turn, is
one blank; null turns come first and count in no gap; rows of one turn are in order of role and text, so equal rows are neighbours; a
conversation without rows has zeros and empty results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Rows of a conversation that one fold takes.
SEGMENT = 256
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: nothing, after a system, a user, an assistant row.
STATES = ("e", "s", "u", "a")
_NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows with made faults, by the CRC-32 of conversation and turn; dropped rows are marked."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = own.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") != 0).alias("there"), F.when(F.col("h") == 3, 2).otherwise(1).alias("times"))
    return made.select("conv_id", "turn", "role", "text", "there", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_again")).drop("_again")


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), audit.alias("audit"))


def _after(state: Column, cost, op: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(op)))


def _bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inserted(states: Column) -> Column:
    """The four states after any inserts that can pay: a user row after all but itself, then an assistant row."""

    def user(now: Column) -> Column:
        u = F.least(now["u"], *[_after(now[x], INSERT, "I") for x in ("e", "s", "a")])
        return F.struct(now["e"].alias("e"), now["s"].alias("s"), u.alias("u"), now["a"].alias("a"))

    def assistant(now: Column) -> Column:
        return F.struct(now["e"].alias("e"), now["s"].alias("s"), now["u"].alias("u"), F.least(now["a"], _after(now["u"], INSERT, "I")).alias("a"))

    return _bound(_bound(states, user), assistant)


def _step(now: Column, turn: Column) -> Column:
    """The four states after one more row."""
    e, s, u, a = [now[x] for x in STATES]
    never = _state(F.lit(_NEVER), F.lit(""))
    fault = F.coalesce(turn["fault"], F.lit(""))
    # Deleted, or kept or reroled where the fault allows it and the role fits.
    own, good = turn["initial"], ~fault.isin("blank", "duplicate")
    more = F.when(fault == "truncated", TRUNCATED).otherwise(0)
    before_user = F.least(e, s, a)

    def stay(frm: Column, role: str) -> Column:
        kept = own == role
        return F.when(good, _state(frm["cost"] + more + F.when(kept, KEEP).otherwise(REROLE), F.concat(frm["audit"], F.when(kept, "K").otherwise("R")))).otherwise(never)

    return _inserted(
        F.struct(
            _after(e, DELETE, "D").alias("e"),
            F.least(_after(s, DELETE, "D"), F.when(good & (own == "s"), _after(e, more + KEEP, "K")).otherwise(never)).alias("s"),
            F.least(_after(u, DELETE, "D"), stay(before_user, "u")).alias("u"),
            F.least(_after(a, DELETE, "D"), stay(u, "a")).alias("a"),
        )
    )


def _start(state: str) -> Column:
    """The four states of no rows, as reached from one of them."""
    return F.struct(*[_state(F.lit(0 if x == state else _NEVER), F.lit("")).alias(x) for x in STATES])


def _opened() -> Column:
    """The four states before a conversation's first row: nothing yet, or inserts."""
    return _inserted(_start("e"))


def _edited(turns: Column, audit: Column, state: Column) -> Column:
    """The rows (role, text) that edits make of an array of rows from a state on."""
    item = "array<struct<role:string,text:string>>"
    zero = F.struct(F.lit(0).alias("at"), state.alias("state"), F.array().cast(item).alias("out"))

    def one(now: Column, op: Column) -> Column:
        row = F.get(turns, now["at"])
        role = F.when(op == "K", row["role"]).when(now["state"] == "u", "assistant").otherwise("user")
        new = F.struct(role.alias("role"), F.when(op == "I", "").otherwise(row["text"]).alias("text"))
        gone = op == "D"
        return F.struct(
            (now["at"] + F.when(op == "I", 0).otherwise(1)).alias("at"),
            F.when(gone, now["state"]).otherwise(F.substring(role, 1, 1)).alias("state"),
            F.when(gone, now["out"]).otherwise(F.concat(now["out"], F.array(new).cast(item))).alias("out"),
        )

    return F.aggregate(F.filter(F.split(audit, ""), lambda op: op != ""), zero, one, lambda end: end["out"])


_ORDER = ("turn", "role", "text")
_LEGAL = ("su", "ua", "au")
_SUMS = ("blank", "duplicate", "truncated")


def _sorted_rows() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _with_turns(rows: DataFrame, *by: str) -> DataFrame:
    """(by, turns): the rows of each group as a sorted array with the first fault of each: blank, duplicate, truncated or none (null)."""
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(kept == "", "blank").when(F.col("again"), "duplicate").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated")
    turn = F.struct(*_ORDER, "again", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("there"), turn))).alias("turns"))


def _figures(turns: Column) -> list[Column]:
    """Of an array of rows: faults by kind, illegal neighbours, turns without nulls from first to last."""
    initials = F.transform(turns, lambda t: t["initial"])
    pairs = F.zip_with(initials, F.slice(initials, 2, F.size(initials)), lambda x, y: F.concat(x, y))
    count = lambda kind: F.size(F.filter(turns, lambda t: t["fault"] == kind)).cast("bigint").alias(kind)
    known = F.filter(F.transform(turns, lambda t: t["turn"]), lambda t: t.isNotNull())
    return [
        *[count(kind) for kind in _SUMS],
        F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL))).cast("bigint").alias("illegal"),
        F.array_min(known).alias("low"),
        F.array_max(known).alias("high"),
        F.size(F.array_distinct(known)).cast("bigint").alias("distinct"),
    ]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of at most a segment's rows, each by one fold."""
    # Dealt by conversation once: the window and the grouping after it need no more.
    dealt = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("there").desc(), *_sorted_rows())) > 1
    found = _with_turns(dealt.withColumn("again", seen), "conv_id")
    folded = found.withColumn("end", F.aggregate("turns", _opened(), _step))
    least = folded.withColumn("end", F.least("end.e", "end.a"))
    return least.select("conv_id", *_figures(F.col("turns")), "end.cost", "end.audit", _edited(F.col("turns"), F.col("end.audit"), F.lit("e")).alias("repaired"))


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Longer conversations: sorted by range over all tasks, cut in segments, and the segments' results joined by a second fold."""
    order = [F.col("conv_id").asc_nulls_first(), *_sorted_rows()]
    there = rows.where("there").repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(there.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256)), "turns")
    first = laid.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("id"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = laid.join(first, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    cut = met.select("conv_id", *_ORDER, "there", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"), (F.col("at") - F.col("at") % segment).alias("segment"))
    # A conversation whose rows are all dropped still has a place.
    none = rows.where("not there").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("bigint").alias("segment"), F.array().cast("array<struct<turn:bigint,role:string,text:string,again:boolean,initial:string,fault:string>>").alias("turns"))
    parts = _with_turns(cut, "conv_id", "segment").unionByName(none)
    folds = [F.aggregate("turns", _start(x), _step).alias(x) for x in STATES]
    ends = [F.get(F.col("turns"), F.lit(0))["initial"].alias("opens"), F.get(F.col("turns"), F.size("turns") - 1)["initial"].alias("closes")]
    one = parts.select("conv_id", F.struct("segment", "turns", *_figures(F.col("turns")), F.struct(*folds).alias("folds"), *ends).alias("part"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def walked(state: Column, way: Column) -> Column:
        return F.struct(state["cost"].alias("cost"), state["audit"].alias("audit"), way.alias("way"))

    def join(now: Column, part: Column) -> Column:
        def best(to: str) -> Column:
            ways = [(now[x], part["folds"][x][to], x) for x in STATES]
            return F.least(*[walked(_state(F.least(a["cost"] + b["cost"], F.lit(_NEVER)), F.concat(a["audit"], b["audit"])), F.concat(a["way"], F.lit(x))) for a, b, x in ways])

        return F.struct(*[best(x).alias(x) for x in STATES])

    opened = _opened()
    zero = F.struct(*[walked(opened[x], F.lit("")).alias(x) for x in STATES])
    e, a = [F.struct(F.col("end")[x]["cost"].alias("cost"), F.col("end")[x]["audit"].alias("audit"), F.concat(F.col("end")[x]["way"], F.lit(x)).alias("way")) for x in ("e", "a")]
    least = whole.withColumn("end", F.aggregate("parts", zero, join)).withColumn("end", F.least(e, a))

    def piece(part: Column, i: Column) -> Column:
        frm, to = [F.substring(F.col("end.way"), i + n, F.lit(1)) for n in (1, 2)]
        pick = lambda s, c: F.coalesce(*[F.when(c == x, s[x]) for x in STATES])
        return _edited(part["turns"], pick(pick(part["folds"], frm), to)["audit"], frm)

    opening = F.substring("end.way", 1, 1)
    item = "array<struct<role:string,text:string>>"
    said = lambda *roles: F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in roles]).cast(item)
    before = F.when(opening == "u", said("user")).when(opening == "a", said("user", "assistant")).otherwise(said())
    pieces = F.concat(F.array(before), F.transform("parts", piece))
    total = lambda name: F.aggregate(F.transform("parts", lambda p: p[name]), F.lit(0).cast("bigint"), lambda s, v: s + v)
    spoken = F.filter("parts", lambda p: p["opens"].isNotNull())
    edges = F.zip_with(spoken, F.slice(spoken, 2, F.size(spoken)), lambda x, y: F.struct(F.concat(x["closes"], y["opens"]).alias("pair"), (x["high"] == y["low"]).alias("shared")))
    return least.select(
        "conv_id",
        *[total(kind).alias(kind) for kind in _SUMS],
        (total("illegal") + F.size(F.filter(edges, lambda x: ~x["pair"].isin(*_LEGAL)))).alias("illegal"),
        F.array_min(F.transform("parts", lambda p: p["low"])).alias("low"),
        F.array_max(F.transform("parts", lambda p: p["high"])).alias("high"),
        (total("distinct") - F.size(F.filter(edges, lambda x: x["shared"]))).alias("distinct"),
        "end.cost",
        "end.audit",
        F.flatten(pieces).alias("repaired"),
    )


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each conversation of (conv_id, turn, role, text, there).

    ``repaired`` is the array of rows (role, text) after the edits; rows that are not ``there`` only name their conversation.
    """
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = small(stored(counts.where(F.col("n") > segment).select(F.col("conv_id").alias("long_id")), "long"))
    met = F.col("conv_id").eqNullSafe(F.col("long_id"))
    both = _short(rows.join(long, met, "left_anti")).unionByName(_long(rows.join(long, met, "left_semi"), segment))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("bigint"))
    return both.select("conv_id", gaps.alias("gaps"), *_SUMS, "illegal", "cost", "audit", "repaired")


def repaired_text(repaired: Column) -> Column:
    """Rows as ``role:text`` lines."""
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
