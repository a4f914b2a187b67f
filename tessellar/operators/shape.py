"""Shaping of results: filter, sort, dedupe, limit, project, in that order; and a byte budget."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.storage import snapshot

#: Separators of the filter grammar, longest first.
OPS = ("==", "!=", "=", "~")


def parse_filter(text: str) -> tuple[str, str, str]:
    """(key, operator, value) of ``key op value``: the earliest separator, the longest on a tie."""
    found = [(text.find(op), -len(op), op) for op in OPS if op in text]
    if not found:
        raise ValueError(f"no operator in filter: {text}")
    at, _, op = min(found)
    key = text[:at].strip()
    if not key:
        raise ValueError(f"no key in filter: {text}")
    return key, "=" if op == "==" else op, text[at + len(op) :].strip()


def _field(df: DataFrame, key: str) -> Column | None:
    kind: T.DataType = df.schema
    for part in key.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return None if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.col(key)


def matches(df: DataFrame, text: str) -> Column:
    """A filter as a condition: a missing key equals nothing; null has empty text."""
    key, op, value = parse_filter(text)
    c = _field(df, key)
    if c is None:
        return F.lit(op == "!=")
    s = F.coalesce(c.cast("string"), F.lit(""))
    if op == "~":
        return F.lower(s).contains(value.lower())
    return s == value if op == "=" else s != value


def shape(df: DataFrame, filters: list[str] = (), sort: str | None = None, descending: bool = False, dedupe: str | None = None, limit: int | None = None, select: list[str] | None = None) -> DataFrame:
    """The shaped rows.  Rows of a null or missing key are never duplicates; of equal rows the first by the sort, then by all columns, stays."""
    out = df
    for f in filters:
        out = out.where(matches(df, f))
    ties = [F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType))]
    order = ties
    if sort is not None and (key := _field(df, sort)) is not None:
        order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), *ties]
    if dedupe is not None and _field(df, dedupe) is not None:
        w = Window.partitionBy(dedupe).orderBy(*order)
        out = out.withColumn("_n", F.when(F.col(dedupe).isNull(), 1).otherwise(F.row_number().over(w))).where("_n = 1").drop("_n")
    if sort is not None or limit is not None:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    if select is not None:
        out = out.select(*[F.col(k).alias(k) for k in select if _path(df, k)])
    return out


def _path(df: DataFrame, key: str) -> bool:
    kind: T.DataType = df.schema
    for part in key.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def truncate_strings(df: DataFrame, n: int) -> DataFrame:
    """Every string, at any depth, cut to n characters."""

    def cut(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.substring(c, 1, n)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: cut(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[cut(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[cut(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _prefix(sized: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The rows (_b: bytes) whose running sum in the order stays within the limit.

    Rows are sorted by range; sums of whole ranges, a row each, tell which ranges begin within the limit, and only those are summed up row by row.
    """
    laid = snapshot(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sized")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = laid.groupBy("_part").agg(F.sum("_b").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") < limit)
    local = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laid.join(F.broadcast(before), "_part").withColumn("_s", F.col("_before") + F.sum("_b").over(local)).where(F.col("_s") <= limit).drop("_b", "_s", "_before", "_part", "_at")


def _json_bytes(df: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("bigint")


def byte_budget(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The longest prefix whose JSON array fits in ``limit`` bytes."""
    # Brackets, and a comma for each element but the first.
    return _prefix(df.withColumn("_b", F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint") + 1), order, limit - 1)


@dataclass(frozen=True)
class Fitted:
    """An envelope under a ceiling: its rows, the secondary arrays it keeps, how many elements went, and whether only a stub is left."""

    rows: DataFrame
    secondary: dict[str, DataFrame]
    truncated: bool
    dropped: int
    stub: bool


def fit(rows: DataFrame, order: list[Column], limit: int, scalars: dict | None = None, secondary: dict[str, DataFrame] | None = None, key: str = "items") -> Fitted:
    """``{scalars, key: [rows], secondary arrays}`` in ``limit`` bytes of JSON: secondary arrays go if they alone do not fit, then rows from the end, then all but a stub; 0 sets no ceiling."""
    scalars, secondary = scalars or {}, secondary or {}
    skeleton = len(json.dumps({**scalars, key: [], **{k: [] for k in secondary}}, separators=(",", ":"), ensure_ascii=False).encode())

    def total(df: DataFrame) -> tuple[int, int]:
        """(bytes between the brackets, elements)."""
        n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_json_bytes(df)), F.lit(0))).first()
        return b + max(n - 1, 0), n

    own, others = total(rows), {k: total(df) for k, df in secondary.items()}
    side = sum(b for b, _ in others.values())
    if limit == 0 or skeleton + own[0] + side <= limit:
        return Fitted(rows, secondary, False, 0, False)
    gone = 0
    if skeleton + side > limit:
        gone, side, secondary = sum(n for _, n in others.values()), 0, {k: df.limit(0) for k, df in secondary.items()}
    if skeleton + side > limit:
        return Fitted(rows.limit(0), secondary, True, own[1] + gone, True)
    kept = snapshot(_prefix(rows.withColumn("_b", _json_bytes(rows) + 1), order, limit - skeleton - side + 1).select(*rows.columns), "fitted")
    return Fitted(kept, secondary, True, own[1] - kept.count() + gone, False)


# Values of JSON text: a path finds a value of any type, or nothing.


def json_at(c: Column, key: str) -> Column:
    """The value at a dotted path of a variant; null where there is none."""
    path = "$" + "".join("['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']" for part in key.split("."))
    return F.try_variant_get(c, path, "variant")


def json_text(v: Column) -> Column:
    """A scalar as text, JSON null as empty text; arrays, objects and nothing as null."""
    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | kind.startswith("OBJECT") | kind.startswith("ARRAY"), None).when(F.is_variant_null(v), "").otherwise(F.try_variant_get(v, "$", "string"))


def json_keys(df: DataFrame, column: str, key: str, names: tuple[str, str, str]) -> DataFrame:
    """``df`` with three columns whose order is that of the values at a path: numbers as numbers, other scalars as text, arrays and objects, and last what is missing."""
    v = json_at(F.col(column), key)
    number = F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    text = F.when(number.isNull(), json_text(v))
    rank = F.when(v.isNull(), 3).when(number.isNotNull(), 0).when(text.isNotNull(), 1).otherwise(2)
    return df.withColumns(dict(zip(names, (rank, number, text))))


def json_matches(c: Column, text: str) -> Column:
    """A filter on a variant: a path without a scalar equals and contains nothing."""
    key, op, value = parse_filter(text)
    s = json_text(json_at(c, key))
    if op == "~":
        return F.coalesce(F.lower(s).contains(value.lower()), F.lit(False))
    return F.coalesce(s == value, F.lit(False)) if op == "=" else F.coalesce(s != value, F.lit(True))


def json_shape(df: DataFrame, column: str, ties: list[str], filters: list[str] = (), sort: str | None = None, descending: bool = False, dedupe: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows shaped by paths in a variant column; of equal ones those come first that do by ``ties``, which tell rows apart."""
    out, c = df, F.col(column)
    for f in filters:
        out = out.where(json_matches(c, f))
    order = [F.col(t) for t in ties]
    if sort is not None:
        rank, *values = names = ("_rank", "_number", "_text")
        out = json_keys(out, column, sort, names)
        order = [F.col(rank), *[F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last() for x in values], *order]
    if dedupe is not None:
        # Values are told apart by their texts; a row without one is no duplicate.
        keyed = out.withColumn("_key", json_text(json_at(c, dedupe)))
        w = Window.partitionBy("_key").orderBy(*order)
        out = keyed.where("_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(keyed.where("_key is null"))
    if sort is not None or limit is not None:
        out = out.orderBy(*order)
    return (out.limit(limit) if limit is not None else out).select(*df.columns)


def count_only(df: DataFrame, filters: list[str] = ()) -> DataFrame:
    """One row: how many rows pass the filters."""
    return shape(df, filters).agg(F.count(F.lit(1)).alias("n"))


def meta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows in, out and dropped."""
    a, b = before.agg(F.count(F.lit(1)).alias("input")), after.agg(F.count(F.lit(1)).alias("output"))
    return a.crossJoin(b).withColumn("dropped", F.col("input") - F.col("output"))
