"""Approximate nearest neighbours over low-dimensional stable projections and kd-trees.

Vectors are scaled to length one and projected to ``m`` dimensions by Gaussian
(2-stable) directions, so a projected squared distance over the true one is
chi-square distributed with m degrees of freedom.

Rows are indexed in cells of the projected space: the splits of a kd-tree over a bounded sample (``SAMPLE`` rows), so a cell
holds about ``BLOCK`` rows; every row is in one cell, once, and a cell too full is dealt to several blocks by hash.
A task builds the kd-tree of a block and queries stream past it.  A query
walks a block's leaves by rising projected distance and verifies their vectors; it stops when, by the chi-square law, a vector nearer than
the k-th found would lie in a visited leaf with probability ``sure``.  First each query visits its own cell; the k-th
found there bounds, by the same law, which other cells it visits at all.  It visits those in rounds by rising distance, few at first, and
each round's finds tighten the bound of the next, so cells that a near find rules out never get a copy of the query.

Vectors of one direction are one entry of the index with their k + 1 smallest ids (counted out before any shuffle by a
limited window), so a vector that a third of all rows share, or multiples of, costs no more than one.  Scores are
cosines of the rows' own vectors: where rows of one direction differ, those of the last k are fetched and computed anew.

Edge cases: vectors null, empty, zero or with null or non-finite components take
no part, nor do null ids; vectors of other widths are searched among their own;
repeated rows of one id are one row, the smallest, where the direction is equal, and else different rows (each a query, each with its ranking);
scores that round to the same twelve digits are ties and go to the smaller id;
fewer candidates than k are all returned; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Vectors of an index block, queries that a task takes past it, rows that cells are fitted on, and cells at most: every task has their table.
BLOCK, CHUNK, SAMPLE, CELLS = 16_384, 65_536, 20_000, 16_384
LEAF = 64
#: Digits after which directions and scores are equal.
DIGITS = 12
#: Cells that a query visits in the first round beyond its own; each further round goes four times as far.
NEXT = 4


def _valid(rows: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(e, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & fine & some)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, not once for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _direction() -> tuple[Column, Column]:
    """(scaled, direction): the embedding at length one, rounded; scaled first by its largest component, so squares stay finite."""
    scaled = _with(F.array_max(F.transform("embedding", F.abs)), lambda top: F.transform("embedding", lambda x: x / top))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    return scaled, _with(norm, lambda n: F.transform("scaled", lambda x: F.round(x / n, DIGITS) + F.lit(0.0)))


def cosines(u, v):
    """The cosine of each row of ``u`` with that of ``v``; scaled by powers of two, which change no digit, so squares stay finite."""
    import numpy as np

    u, v = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (u, v))
    return (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)))


def chi_square(x, m: int):
    """The chi-square distribution function for even ``m``: a finite sum."""
    import numpy as np

    h = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isfinite(h), 1 - np.exp(-h) * total, 1.0)


class Tree:
    """A kd-tree over projected points, split at medians of the widest dimension; its leaves hold at most ``leaf`` points."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        self.order = np.arange(len(points))
        bounds = []
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            at = self.order[lo:hi]
            if hi - lo <= leaf:
                bounds.append((lo, hi))
                continue
            own = points[at]
            d = int(np.argmax(own.max(0) - own.min(0)))
            half = (hi - lo) // 2
            self.order[lo:hi] = at[np.argpartition(own[:, d], half)]
            todo += [(lo, lo + half), (lo + half, hi)]
        bounds.sort()
        self.bounds = bounds
        ordered = points[self.order]
        self.low = np.array([ordered[a:b].min(0) for a, b in bounds])
        self.high = np.array([ordered[a:b].max(0) for a, b in bounds])

    def walk(self, q):
        """Leaves by rising squared projected distance of their box, and those distances."""
        import numpy as np

        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        d = (gap * gap).sum(1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def lines_for(width: int, m: int, seed: int):
    """The projection of vectors of ``width`` components: (width, up to m) Gaussian directions, an even number."""
    import numpy as np

    return np.random.default_rng(seed).standard_normal((width, min(m, max(2, width // 2 * 2))))


def projected(vectors, m: int, seed: int):
    """Vectors of one width at length one, and their projections, filled with zeros to ``m`` dimensions."""
    import numpy as np

    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    points = unit @ lines_for(vectors.shape[1], m, seed)
    return unit, np.pad(points, ((0, 0), (0, m - points.shape[1])))


class Block:
    """Rows of one width under a kd-tree, searched for many queries at once."""

    def __init__(self, vectors, m: int, seed: int):
        import numpy as np

        self.vectors, self.m, self.seed = vectors, m, seed
        unit, points = projected(vectors, m, seed)
        self.free = lines_for(vectors.shape[1], m, seed).shape[1]
        self.tree = Tree(points)
        size = max(b - a for a, b in self.tree.bounds)
        # Leaves of equal size; what fills one up repeats its first row and does not count.
        at = np.array([[a + min(i, b - a - 1) for i in range(size)] for a, b in self.tree.bounds])
        self.rows = self.tree.order[at]
        self.real = np.arange(size)[None, :] < np.array([[b - a] for a, b in self.tree.bounds])
        self.laid = unit[self.rows]

    def search(self, queries, k: int, sure: float, far=None):
        """(rows, cosines), each (queries, k): the best first, ties to the earlier row; -1 and -inf where there are fewer.

        ``far`` are squared distances that the k-th of each query is known not to exceed.
        """
        import numpy as np

        unit, points = projected(queries, self.m, self.seed)
        gap = np.maximum(np.maximum(self.tree.low[None] - points[:, None], points[:, None] - self.tree.high[None]), 0)
        near = (gap * gap).sum(2)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        best_c, best_r = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        far = np.full(len(queries), np.inf) if far is None else far
        on = np.arange(len(queries))
        for step in range(near.shape[1]):
            # The squared distance of the k-th on the unit sphere; rounding may leave a trace below zero.
            kth = np.minimum(np.maximum(2 - 2 * best_c[on, -1], 1e-12), far[on])
            d = near[on, step]
            stop = (d > 1e-9) & np.isfinite(kth) & (chi_square(d / kth, self.free) >= sure)
            on = on[~stop]
            if not len(on):
                break
            leaf = order[on, step]
            c = np.where(self.real[leaf], np.round(np.einsum("qw,qlw->ql", unit[on], self.laid[leaf]), DIGITS), -np.inf)
            c, r = np.concatenate([best_c[on], c], 1), np.concatenate([best_r[on], np.where(self.real[leaf], self.rows[leaf], -1)], 1)
            by_row = np.argsort(r, axis=1, kind="stable")
            c, r = np.take_along_axis(c, by_row, 1), np.take_along_axis(r, by_row, 1)
            top = np.argsort(-c, axis=1, kind="stable")[:, :k]
            best_c[on], best_r[on] = np.take_along_axis(c, top, 1), np.take_along_axis(r, top, 1)
        return best_r, best_c


def splits_of(points, cells: int):
    """A kd-tree's splits as (dimension, bound, left, right) by number, a negative number being a cell; () for one cell."""
    import numpy as np

    out, count = [], [0]

    def grow(at, parts: int) -> int:
        if parts <= 1 or len(at) < 2:
            count[0] += 1
            return -count[0]
        d = int(np.argmax(points[at].max(0) - points[at].min(0)))
        bound = float(np.median(points[at, d]))
        low = points[at, d] <= bound
        me = len(out)
        out.append(None)
        if low.all():
            out.pop()
            count[0] += 1
            return -count[0]
        out[me] = (d, bound, grow(at[low], parts // 2), grow(at[~low], parts - parts // 2))
        return me

    grow(np.arange(len(points)), cells)
    return tuple(out)


def cells_of(points, splits):
    """The cell of each point."""
    import numpy as np

    out, todo = np.ones(len(points), np.int64), [(0, np.arange(len(points)))]
    while splits and todo:
        node, at = todo.pop()
        if node < 0:
            out[at] = -node
            continue
        d, bound, left, right = splits[node]
        low = points[at, d] <= bound
        todo += [(left, at[low]), (right, at[~low])]
    return out


def _pointed(rows: DataFrame, m: int, seed: int, splits=()) -> DataFrame:
    """``rows`` with the projection of their embedding as point, and its cell."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType

    schema = rows.schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            e, widths = b.column("embedding"), b.column("width").to_numpy()
            values, edges = e.values.to_numpy(), e.offsets.to_numpy()
            points = np.zeros((b.num_rows, m))
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                points[at] = projected(values[edges[at][:, None] + np.arange(w)], m, seed)[1]
            own = [pa.array(list(points), pa.list_(pa.float64())), pa.array(cells_of(points, splits), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "point", "cell"])

    from pyspark.sql.types import StructField, StructType

    return rows.mapInArrow(run, StructType([*schema.fields, StructField("point", ArrayType(DoubleType())), StructField("cell", IntegerType())]))


def _found(index: DataFrame, asked: DataFrame, k: int, m: int, sure: float, seed: int) -> DataFrame:
    """(q, d, ids, alike, score): for each (q, embedding, width, cell, far) of ``asked`` the k best entries of its cell's blocks.

    A block goes once to each ``CHUNK`` of the queries of its cell, ahead of them.
    """
    blocks = index.select("width", "cell", "sub").distinct()
    visits = asked.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    keys = ["width", "cell", "sub", "part"]
    left = index.join(visits, ["width", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select(*keys, F.lit(None).cast("long").alias("q"), "entry", "d", "ids", "alike", "embedding", F.lit(None).cast("double").alias("far"))
    right = asked.join(visits, ["width", "cell"]).join(blocks, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    right = right.select(*keys, "q", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("boolean").alias("alike"), "embedding", "far")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, rows, named, block = None, [], [], None
        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in keys], 1)
            e = b.column("embedding")
            values, edges, q = e.values.to_numpy(), e.offsets.to_numpy(), b.column("q")
            cut = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1)))
            for lo, hi in zip(cut, np.append(cut[1:], len(where))):
                if now is None or (where[lo] != now).any():
                    now, rows, named, block = where[lo], [], [], None
                asks = np.asarray(q.slice(lo, hi - lo).is_valid())
                n = int(np.argmax(np.append(asks, True)))
                vectors = values[edges[lo] : edges[hi]].reshape(hi - lo, -1)
                if n:
                    rows.append(vectors[:n])
                    named += zip(*(b.column(c).slice(lo, n).to_pylist() for c in ("d", "ids", "alike")))
                if n == hi - lo:
                    continue
                if block is None:
                    block = Block(np.concatenate(rows), m, seed)
                far, names = b.column("far").to_numpy(zero_copy_only=False)[lo + n : hi], q.slice(lo + n, hi - lo - n).to_numpy()
                for i in range(0, len(names), 128):
                    x = vectors[n + i : n + i + 128]
                    r, _ = block.search(x, k, sure, np.where(np.isnan(f := far[i : i + 128].astype(float)), np.inf, f))
                    at, _ = np.nonzero(r >= 0)
                    r = r[r >= 0]
                    # The measure itself, on the original vectors.
                    score = cosines(x[at], block.vectors[r])
                    d, ids, alike = zip(*(named[j] for j in r)) if len(r) else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 128][at]), pa.array(d, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(alike, pa.bool_()), pa.array(score)], ["q", "d", "ids", "alike", "score"])

    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, F.col("q").asc_nulls_first(), "entry")
    return both.drop("entry").mapInArrow(run, "q long, d long, ids array<long>, alike boolean, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of each query."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", DIGITS)), F.get("ids", F.lit(0)))
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, m: int = 8, sure: float = 0.97, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of ``rows`` other than itself, by cosine.

    ``queries`` (vec_id, embedding) need not be among ``rows``; a row of the same id is left out.
    """
    scaled, direction = _direction()

    def directed(df: DataFrame) -> DataFrame:
        return _valid(df).withColumn("scaled", scaled).withColumn("direction", direction).drop("scaled").withColumn("d", F.xxhash64("direction"))

    valid = stored(directed(rows), "vectors")
    # One entry per direction, with the k + 1 smallest of its ids.
    w = Window.partitionBy("direction").orderBy("vec_id")
    first = valid.groupBy("vec_id", "direction", "d").agg(F.min("embedding").alias("embedding")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    alike = (F.min("embedding") == F.max("embedding")).alias("alike")
    entries = first.groupBy("direction", "d").agg(F.min(F.struct("vec_id", "embedding")).alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids"), alike)
    entries = stored(entries.select(F.col("x.vec_id").alias("entry"), "d", "ids", "alike", "x.embedding", F.size("x.embedding").alias("width")), "entries")
    asked = directed(queries).groupBy(F.col("vec_id").alias("query_id"), "direction", F.col("d").alias("q")).agg(F.min("embedding").alias("embedding"))
    asked = stored(asked, "asked")
    wanted = asked.groupBy("direction", "q").agg(F.min(F.struct("query_id", "embedding")).alias("x"), alike)
    wanted = stored(wanted.select("q", F.col("alike").alias("asked_alike"), "x.embedding", F.size("x.embedding").alias("width")), "wanted")

    n = entries.count()
    splits = ()
    if n > block:
        # Cells are fitted on a sample of bounded size.
        some = entries.where(F.pmod(F.xxhash64("entry", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, SAMPLE / n) * 1_000_000)) if n > SAMPLE else entries
        import numpy as np

        points = [r["point"] for r in _pointed(some, m, seed).select("point").limit(2 * SAMPLE).collect()]
        splits = splits_of(np.array(points), min(CELLS, -(-n // block))) if points else ()
    index = _pointed(entries, m, seed, splits)
    sizes = None
    if n > block:
        index = stored(index, "index")
        sizes = index.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("subs"))
        index = index.join(sizes, ["width", "cell"]).withColumn("sub", F.pmod(F.xxhash64("entry"), F.col("subs")).cast("int")).drop("subs")
    else:
        index = index.withColumn("sub", F.lit(0))
    own = _pointed(wanted.drop("asked_alike"), m, seed, splits).withColumn("far", F.lit(None).cast("double"))
    if splits:
        own = stored(own, "own")
    # A query of a width that its cell lacks finds nothing there and visits all cells.
    found = _found(index, own, k + 1, m, sure, seed)
    if splits:
        found, boxes = stored(found, "found"), _boxes(index, m)
        lo, hi = 0, NEXT
        while lo < len(boxes):
            last = found.groupBy("q").agg(F.sort_array(F.collect_list("score"), False).alias("c")).select("q", F.get("c", F.lit(k)).alias("c"))
            bounds = own.select("q", "width", "point", "cell").join(last, "q", "left").withColumn("far", F.lit(2.0) - F.lit(2.0) * F.col("c")).drop("c")
            visits = stored(_visits(bounds, boxes, m, sure, lo, hi), "visits")
            # Cells come by rising distance, so who visits none of a round visits none later.
            if visits.isEmpty():
                break
            more = _found(index, visits.join(own.select("q", "embedding"), "q"), k + 1, m, sure, seed)
            found = stored(_best(found.unionByName(more), k + 1), "found")
            lo, hi = hi, 4 * hi
    # An entry stands for its k + 1 smallest ids: enough to fill k places beside the query's own.
    ids = found.select("q", "d", "alike", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("q").orderBy(F.desc(F.round("score", DIGITS)), "vec_id")
    best = ids.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "d", "alike"))).alias("best"))
    best = best.join(wanted.select("q", "asked_alike"), "q")
    each = asked.select("query_id", "q").join(best, "q")
    mine = F.filter("best", lambda s: s["vec_id"] != F.col("query_id"))
    each = each.select("query_id", "q", "asked_alike", F.posexplode(F.slice(mine, 1, k)).alias("i", "s"))
    ranked = each.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "s.vec_id", "s.score", "q", "s.d", (F.col("asked_alike") & F.col("s.alike")).alias("alike"))
    ranked = stored(ranked, "ranked")
    names = ["query_id", "rank", "vec_id", "score"]
    return ranked.where("alike").select(names).unionByName(_rescored(ranked.where("not alike"), asked, valid).select(names))


def _rescored(ranked: DataFrame, asked: DataFrame, valid: DataFrame) -> DataFrame:
    """``ranked`` with the cosines of the rows' own vectors, where rows of one direction differ."""
    if ranked.isEmpty():
        return ranked
    ours = asked.join(small(ranked.select("query_id", "q").distinct()), ["query_id", "q"]).select("query_id", "q", F.col("embedding").alias("u"))
    theirs = valid.join(small(ranked.select("vec_id", "d").distinct()), ["vec_id", "d"]).groupBy("vec_id", "d").agg(F.min("embedding").alias("v"))
    # A vector that very many queries found is in a small table or in a join that Spark splits.
    both = ranked.drop("score").join(ours, ["query_id", "q"]).join(small(stored(theirs, "theirs"), 4096), ["vec_id", "d"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            score = np.zeros(b.num_rows)
            u, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            for i in range(b.num_rows):
                score[i] = cosines(u[i][None], v[i][None])[0]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("rank"), b.column("vec_id"), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

    return both.select("query_id", "rank", "vec_id", "u", "v").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def _boxes(index: DataFrame, m: int) -> list[tuple]:
    """(width, cell, lows, highs) of each cell's points."""
    ends = [F.min(F.get("point", F.lit(i))).alias(f"l{i}") for i in range(m)] + [F.max(F.get("point", F.lit(i))).alias(f"h{i}") for i in range(m)]
    # A row per cell and width.
    return [(r["width"], r["cell"], [r[f"l{i}"] for i in range(m)], [r[f"h{i}"] for i in range(m)]) for r in index.groupBy("width", "cell").agg(*ends).collect()]


def _visits(bounds: DataFrame, boxes: list[tuple], m: int, sure: float, lo: int, hi: int) -> DataFrame:
    """(q, width, cell, far): of the other cells by rising distance, numbers ``lo`` to ``hi``, those where something nearer than a query's ``far`` may lie."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        widths, cells, low, high = (np.array(x) for x in zip(*boxes))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x = b.slice(i, 256)
                points = np.stack(x.column("point").to_numpy(zero_copy_only=False))
                near = np.zeros((len(points), len(cells)))
                for d in range(m):
                    own = points[:, d, None]
                    near += np.maximum(np.maximum(low[None, :, d] - own, own - high[None, :, d]), 0) ** 2
                width = x.column("width").to_numpy()
                near[(widths[None] != width[:, None]) | (cells[None] == x.column("cell").to_numpy()[:, None])] = np.inf
                order = np.argsort(near, axis=1, kind="stable")[:, lo:hi]
                near = np.take_along_axis(near, order, 1)
                far = x.column("far").to_numpy(zero_copy_only=False).astype(float)
                far = np.where(np.isnan(far), np.inf, np.maximum(far, 1e-12))
                free = np.minimum(m, np.maximum(2, width // 2 * 2))
                go = np.zeros(near.shape, bool)
                for f in np.unique(free):
                    at = free == f
                    with np.errstate(invalid="ignore"):
                        go[at] = (near[at] <= 1e-9) | ~np.isfinite(far[at])[:, None] | (chi_square(near[at] / far[at][:, None], int(f)) < sure)
                go &= np.isfinite(near)
                q, c = np.nonzero(go)
                q_ = pa.array(q)
                yield pa.RecordBatch.from_arrays([x.column("q").take(q_), x.column("width").take(q_), pa.array(cells[order[q, c]].astype(np.int32)), pa.array(np.where(np.isinf(far[q]), np.nan, far[q]))], ["q", "width", "cell", "far"])

    return bounds.mapInArrow(run, "q long, width int, cell int, far double")
