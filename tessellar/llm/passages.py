"""Substring dedup by compact windows.

For each hash function the five-word shingles of a text have hash values.  A
compact window (left, centre, right) is a shingle with the bounds inside which it is
the smallest: all subsequences between the bounds that hold the centre share its
value as min-hash.  The windows of at least ``min_words`` words are the nodes of
the text's Cartesian tree that are that wide.

1. Hash functions are dealt to bands of two.  Where windows of a band's functions overlap in ``min_words`` words or
   more that hold both centres, every subsequence between the bounds of the overlap that holds both shares
   both min-hashes: the overlap is one interval of the band, keyed by the two values.  Intervals of different texts
   meet in a join on that key, so two hash functions agree on overlapping windows before anything is compared.
   Passages of similarity s escape all bands with probability (1 - s * s) ** bands.
2. Of a key with up to ``few`` intervals all pairs of texts are compared, of a larger one every text with
   the first.  The comparison chains the shingles that both texts share from the meeting centres on, over insertions
   and deletions, takes the longest stretch of the chain in which enough are shared, and keeps it if
   it has ``min_words`` words on both sides and its shingle sets are similar enough.
3. Classes are connected components of passages.  Intervals of a large key that lie in no passage of the first one's class
   are compared among each other and, where one is as near to the first as two texts similar to a third, with all
   of that class: blocks of intervals by counts of shared shingles (a matrix product inside a task), and those that may
   share enough for a passage by the comparison above, but for pairs already in one class.
   Intervals that can have no passage with one of another class drop out first: the shingles that others have
   are too few around the centre.  In a key of more than ``many`` intervals, such as that of a line that every other document has,
   this is found by slices of its intervals and parts of its shingles, so no task has the whole key; nothing else is left out.

A key that many texts of one task's slice hold is salted by the slice: its first text stands for them among
the slices, and they are compared with it apart.

Texts with equal words are one node; copies get its passages, and a text of ``min_words`` words with
copies is a passage as a whole.

Edge cases: a null, empty or short text has no passage; a passage repeated within
one text alone is none; rows that repeat an id are documents each; a null id is left out; very
long texts are cut nowhere; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, sliced, small, stored

#: Bands of two hash functions; passages of the threshold similarity escape them all with probability (1 - s * s) ** 4.
BANDS = 4
#: Intervals of one key whose pairs are all compared, partners that a task compares with one text, and intervals of a block.
FEW, PARTNERS, BLOCK = 16, 256, 512
#: Shingles that a comparison of much repeated words looks ahead and back from a centre; longer passages are found from several centres and merged.
REACH = 1024
#: Intervals of a key beyond which it is thinned by slices, and intervals of a slice.
MANY, SLICE = 256, 1 << 13
#: Bits of a place that hold how far an interval reaches beyond its centre, and of a value that hold its band.
SIDE, BAND_BITS = 16, 4


def compact_windows(values, width: int, ends=None):
    """(left, centre, right) of every compact window of at least ``width`` items, by centre; ties are smaller at the left.

    ``values`` may hold several texts one after another, ``ends`` being where each ends; windows lie within texts,
    and a text shorter than ``width`` has none.
    """
    return windows_of_stretches(values, width, ends)[0]


def windows_of_stretches(values, width: int, ends=None):
    """The compact windows, and for each stretch of ``width`` items within a text, in order, the number of the window whose centre is its smallest."""
    import numpy as np

    n = len(values)
    ends = np.array([n]) if ends is None else np.asarray(ends)
    sizes = np.diff(ends, prepend=0)
    if n == 0 or sizes.max() < width:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64)
    # Distinct numbers in the order of the values: the place fills the low bits of large ones, small ones are ranked.
    bits = np.uint64(n.bit_length())
    if int(values.max()) >> 60:
        keyed, back = (values >> bits << bits) | np.arange(n, dtype=np.uint64), None
    else:
        back = np.argsort(values, kind="stable")
        keyed = np.empty(n, np.uint64)
        keyed[back] = np.arange(n, dtype=np.uint64)
    # Stretches that cross a text's end do not count; the rest change their smallest item from centre to centre.
    fits = np.arange(n) <= np.repeat(ends, sizes) - width
    low = sliding_min(keyed, width)[fits]
    new = np.append(True, low[1:] != low[:-1])
    which, low = np.cumsum(new) - 1, low[new]
    centres = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) if back is None else back[low.astype(np.int64)]
    # The Cartesian tree of the centres: each one's nearest smaller neighbours in its text.
    text = np.searchsorted(ends, centres, "right")
    first, last = (ends - sizes)[text], (ends - 1)[text]
    before = nearest_smaller(low, text)
    after = len(low) - 1 - nearest_smaller(low[::-1], text[::-1])[::-1]
    left = np.where(before >= 0, centres[before] + 1, first)
    right = np.where(after < len(low), centres[np.minimum(after, len(low) - 1)] - 1, last)
    return np.stack([left, centres, right], 1), which


def nearest_smaller(values, text):
    """The place of the last smaller item before each of the distinct ``values`` in its ``text``; -1 where there is none."""
    import numpy as np

    at = np.arange(len(values)) - 1
    at[np.append(True, text[1:] != text[:-1])] = -1
    # All between an item and its pointer is larger, so a pointer to a larger item may follow that item's own.
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[at[todo] >= 0]
        todo = todo[values[at[todo]] > values[todo]]
        at[todo] = at[at[todo]]
    return at


def sliding_min(values, width: int):
    """The smallest of each ``width`` items in a row, and of the shorter rests at the end."""
    import numpy as np

    out, span = np.append(values, np.full(width - 1, np.iinfo(values.dtype).max, values.dtype)), 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    if span < width:
        out = np.minimum(out[: len(values)], out[width - span : width - span + len(values)])
    return out[: len(values)]


def band_intervals(hashed, width: int, ends):
    """(band, left, centre, right, low, low) per band of two functions: the overlaps of their windows that stretches of ``width`` items lie in.

    ``hashed`` has a row per function; ``centre`` is the first function's, ``low`` are the two smallest values.
    """
    import numpy as np

    ends = np.asarray(ends)
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), np.maximum(sizes - width + 1, 0))
    out = []
    for band in range(len(hashed) // 2):
        (wa, ia), (wb, ib) = (windows_of_stretches(h, width, ends) for h in hashed[2 * band : 2 * band + 2])
        new = np.append(True, (ia[1:] != ia[:-1]) | (ib[1:] != ib[:-1]) | (text[1:] != text[:-1]))
        a, b = wa[ia[new]], wb[ib[new]]
        left, right = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 2], b[:, 2])
        low, also, own = hashed[2 * band][a[:, 1]], hashed[2 * band + 1][b[:, 1]], text[new]
        # Words that repeat give neighbouring intervals the same values: they are one.
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (also[1:] != also[:-1]) | (own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
        right = np.maximum.reduceat(right, first) if len(own) else right
        out.append((np.full(len(first), band), own[first], left[first], a[first, 1], right, low[first], also[first]))
    return [np.concatenate(x) for x in zip(*out)]


def placed(left, centre, right):
    """Intervals as one number each: the centre, and how far the interval reaches to its left and right."""
    import numpy as np

    most = (1 << SIDE) - 1
    return centre << 2 * SIDE | np.minimum(centre - left, most) << SIDE | np.minimum(right - centre, most)


def _centre(place: str) -> Column:
    return F.shiftright(F.col(place), 2 * SIDE)


def _before(place: str) -> Column:
    return F.shiftright(F.col(place), SIDE).bitwiseAND((1 << SIDE) - 1)


def _after(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << SIDE) - 1)


def intervals(docs: DataFrame, min_words: int, size: int, bands: int, seed: int = 5, hot: int = FEW) -> DataFrame:
    """(value, salt, key, place): the bands' intervals of every text.

    A value that more than ``hot`` texts of a slice hold is salted with the slice's number; its first text has it with salt 0 too.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .shingles import mixed, shingles_of

        salts = mixed(np.arange(seed, seed + 2 * bands, dtype=np.uint64))
        wide, number, task = min_words - size + 1, 0, TaskContext.get().partitionId()
        for batch in sliced(batches):
            texts = {}
            for t in batch.column("text").to_pylist():
                key, own = keyed(t)
                if len(own) >= min_words:
                    texts.setdefault(key, own)
            if not texts:
                continue
            number += 1
            every = shingles_of(list(texts.values()), size)
            flat, ends = np.concatenate(every), np.cumsum([len(x) for x in every])
            band, text, left, centre, right, low, also = band_intervals([mixed(flat ^ s) for s in salts], wide, ends)
            with np.errstate(over="ignore"):
                # The lowest bits tell the band.
                value = (mixed(mixed(low + band.astype(np.uint64)) + also) << np.uint64(BAND_BITS) | band.astype(np.uint64)).view(np.int64)
            start = (ends - np.diff(ends, prepend=0))[text]
            key = np.array(list(texts), np.int64)[text]
            place = placed(left - start, centre - start, right - start)
            order = np.argsort(value, kind="stable")
            value, key, place = value[order], key[order], place[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            held = np.diff(np.append(first, len(value)))
            many = np.repeat(held > hot, held)
            again = first[held > hot]
            salt = np.where(many, (task << 24) + number, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])) for x, y in ((value, value[again]), (salt, np.zeros(len(again), np.int64)), (key, key[again]), (place, place[again]))], ["value", "salt", "key", "place"])

    return docs.select("text").mapInArrow(run, "value long, salt long, key long, place long")


def keyed(text: str | None) -> tuple[int, list[str]]:
    """A text's key, which equal words share, and its words."""
    import xxhash

    from .shingles import words

    own = words(text)
    return xxhash.xxh3_64_intdigest(" ".join(own)) - (1 << 63), own


def _meets(rows: DataFrame, few: int) -> DataFrame:
    """(value, large, a, pa, b, pb): of values that up to ``few`` intervals share all pairs of them, of others each interval with the first.

    Rows are read in order of value, so a group of any size passes a task in pieces.
    Values of a single text give nothing; the first interval of a large value meets itself too.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["value", "large", "a", "pa", "b", "pb"]

        def told(x, i, j, large):
            v, _, k, p = x
            i, j = i[keep := large | (k[i] != k[j])], j[keep]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (v[i], np.full(len(i), large), k[i], p[i], k[j], p[j])], names)

        def groups(x):
            v, s = x[0], x[1]
            return np.append(np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (s[1:] != s[:-1]))), len(v)) if len(v) else np.array([0])

        def done(x):
            """Of whole groups."""
            at = groups(x)
            held, first = np.diff(at), np.repeat(at[:-1], np.diff(at))
            several = np.zeros(len(held), bool)
            if len(held):
                several = np.minimum.reduceat(x[2], at[:-1]) < np.maximum.reduceat(x[2], at[:-1])
            several = np.repeat(several, held)
            big = np.repeat(held > few, held)
            i = np.flatnonzero(several & big)
            yield told(x, first[i], i, True)
            small_ = np.flatnonzero(several & ~big)
            ends = np.repeat(at[1:], held)
            for step in range(1, few):
                small_ = small_[small_ + step < ends[small_]]
                if not len(small_):
                    break
                yield told(x, small_, small_ + step, False)

        rest, lead = None, None
        for b in batches:
            x = [b.column(n).to_numpy() for n in ("value", "salt", "key", "place")]
            if not len(x[0]):
                continue
            if lead is not None:
                # The last group was large already: what goes on of it meets its first interval.
                n = int(np.argmin(np.append((x[0] == lead[0]) & (x[1] == lead[1]), False)))
                own = [np.append(np.array([one], np.int64), c[:n]) for one, c in zip(lead, x)]
                yield told(own, np.zeros(n, np.int64), np.arange(1, n + 1), True)
                x = [c[n:] for c in x]
                if not len(x[0]):
                    continue
                lead = None
            if rest is not None:
                x = [np.concatenate(y) for y in zip(rest, x)]
                rest = None
            at = groups(x)[-2]
            yield from done([c[:at] for c in x])
            rest = [c[at:] for c in x]
            # One text's own intervals say nothing until another comes.
            if len(rest[0]) > few and rest[2].min() < rest[2].max():
                yield from done(rest)
                lead, rest = [c[0] for c in rest], None
        if rest is not None:
            yield from done(rest)

    keys = ["value", "salt", "key", "place"]
    return rows.repartition("value", "salt").sortWithinPartitions(*keys).mapInArrow(run, "value long, large boolean, a long, pa long, b long, pb long")


def shared_runs(a, b, order, bounds_a=None, bounds_b=None, most: int = 2_000_000, least: float = 0):
    """(first, last, diagonal, shared on it in all) of the runs of neighbouring shared shingles on one diagonal, as arrays.

    ``order`` sorts ``b``.  None if the texts repeat so much that more than ``most`` places face each other; () if fewer than ``least`` of ``a`` are shared.
    """
    import numpy as np

    (alo, ahi), (blo, bhi) = bounds_a or (0, len(a) - 1), bounds_b or (0, len(b) - 1)
    order = order[(order >= blo) & (order <= bhi)] if bounds_b else order
    sorted_, own = b[order], a[alo : ahi + 1]
    first = np.searchsorted(sorted_, own, "left")
    has = np.flatnonzero(sorted_[np.minimum(first, len(sorted_) - 1)] == own)
    if len(has) < least:
        return ()
    first = first[has]
    counts = np.searchsorted(sorted_, own[has], "right") - first
    if not bounds_a and counts.sum() > most:
        return None
    i = np.repeat(has, counts) + alo
    j = order[np.repeat(first, counts) + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)]
    # Diagonals, and places in order on each, as one number.
    by = np.sort((j - i + len(a)) << 32 | i)
    i, d = by & 0xFFFFFFFF, (by >> 32) - len(a)
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)))
    runs_d, runs_lo, runs_hi = d[cut], i[cut], i[np.append(cut[1:], len(i)) - 1]
    edge = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    return runs_lo, runs_hi, runs_d, np.diff(np.append(edge, len(d)))[np.searchsorted(d[edge], runs_d)]


def aligned(runs, pa_: int, pb: int, threshold: float, slack: int = 8):
    """(i, j): the shared shingles' places in both texts on a chain of ``runs`` through ``pa_`` and ``pb``, both rising.

    The chain changes to another diagonal by up to ``slack`` places, or by more if enough shared
    shingles lie on that one to pay for the places that the change leaves unshared.
    """
    import numpy as np

    runs_lo, runs_hi, runs_d, on = runs

    def side(sign: int) -> list[tuple[int, int, int]]:
        """(first, last, diagonal) of the runs from the centre on, to the right or to the left."""
        lo, hi = (runs_lo, runs_hi) if sign > 0 else (-runs_hi, -runs_lo)
        c, now, at = sign * pa_, pb - pa_, sign * pa_ - 1
        end_b, out = sign * pb - 1, []
        ahead = np.flatnonzero(hi >= c)
        ahead = ahead[np.lexsort((np.abs(runs_d[ahead] - now), np.maximum(lo[ahead], c)))]
        for s, e, x, n in zip(lo[ahead].tolist(), hi[ahead].tolist(), runs_d[ahead].tolist(), on[ahead].tolist()):
            jump = abs(x - now)
            if jump > slack and n * (1 - threshold) < jump * threshold:
                continue
            # What the chain already has of either text is passed over.
            s = max(s, at + 1, end_b + 1 - sign * x)
            if s <= e:
                out.append((s, e, x))
                now, at, end_b = x, e, e + sign * x
        return out

    parts = [(np.arange(-s, -e - 1, -1), x) for s, e, x in side(-1)]
    left = np.concatenate([p for p, _ in parts])[:0:-1], np.concatenate([p + x for p, x in parts])[:0:-1]
    parts = [(np.arange(s, e + 1), x) for s, e, x in side(1)]
    right = np.concatenate([p for p, _ in parts]), np.concatenate([p + x for p, x in parts])
    return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])


def stretches(chain, pa_: int, size_a: int, size_b: int, threshold: float, wide: int):
    """Stretches of at least ``wide`` shingles of a chain around the place ``pa_`` on it, as ((lo, hi), (lo, hi)), best first.

    With m shared shingles, (1 + threshold) * m - threshold * (places of a and of b) is not negative where the similarity is
    reached.  The first is the longest such stretch between two shared shingles, or one that is widened by unshared ones to
    ``wide``; the second, for texts that repeat shingles, has the largest such sum.
    """
    import numpy as np

    i, j = chain
    c = int(np.searchsorted(i, pa_))
    # The sum from match k to match l is sums[l] - sums[k] + 1 - threshold.
    sums = (1 + threshold) * np.arange(len(i)) - threshold * (i + j)
    far = np.maximum.accumulate(sums[c:][::-1])[::-1]
    least = sums[: c + 1] - (1 - threshold) - 1e-9
    end = c + np.searchsorted(-far, -least, "right") - 1
    k = int(np.argmax(np.where(end >= c, i[end] + j[end] - i[: c + 1] - j[: c + 1], -1)))
    found = [(k, int(end[k]))] if end[k] >= c else []
    found.append((int(sums[: c + 1].argmin()), c + int(sums[c:].argmax())))
    out = [((int(i[k]), int(i[l])), (int(j[k]), int(j[l]))) for k, l in found if min(i[l] - i[k], j[l] - j[k]) + 1 >= wide]
    if out:
        return out
    # Nothing is wide enough between shared shingles: the ends may be unshared.
    k0, l0 = np.searchsorted(i, pa_ - wide, "right"), np.searchsorted(i, pa_ + wide, "left")
    if min(size_a, size_b) < wide or (l0 - k0) * (1 + threshold) + 1e-9 < 2 * threshold * wide:
        return out
    k, l = np.arange(k0, c + 1)[:, None], np.arange(c, l0)[None, :]
    more_a, more_b = np.maximum(wide - 1 - (i[l] - i[k]), 0), np.maximum(wide - 1 - (j[l] - j[k]), 0)
    rest = sums[l] - sums[k] + 1 - threshold - threshold * (more_a + more_b)
    x, y = np.unravel_index(int(rest.argmax()), rest.shape)
    if rest[x, y] < -1e-9:
        return out
    k, l = int(k0 + x), int(c + y)
    spans = []
    for at in (i, j):
        need = max(wide, int(at[l] - at[k]) + 1)
        lo = max(0, int(at[l]) - need + 1)
        spans.append((lo, lo + need - 1))
    return [tuple(spans)]


def _covered(begin, end, n: int):
    """Which of a text's ``n`` places lie in runs from ``begin`` to ``end``."""
    import numpy as np

    return np.cumsum(np.bincount(begin, minlength=n)[:n] - np.bincount(end + 1, minlength=n + 1)[:n]) > 0


def _dense(shared, share: float, wide: int):
    """Which of a text's places lie in a stretch of ``wide`` or more of which a share of ``share`` or more is ``shared``."""
    import numpy as np

    n = len(shared)
    sums = np.append(0.0, np.cumsum(shared - share))
    far = np.maximum.accumulate(sums[::-1])[::-1]
    # The last place up to which the stretch from each place is dense enough.
    last = np.searchsorted(-far, -(sums[:-1] - 1e-9), "right") - 2
    last[last - np.arange(n) + 1 < wide] = -1
    return np.maximum.accumulate(last) >= np.arange(n)


def _dense_at(shared, share: float, wide: int, places):
    """``_dense`` at some places."""
    import numpy as np

    n = len(shared)
    if n < wide or len(places) > 8:
        return _dense(shared, share, wide)[places]
    sums = np.zeros(n + 1)
    np.cumsum(shared - share, out=sums[1:])
    far = np.maximum.accumulate(sums[::-1])[::-1]
    least, ends = sums[: n - wide + 1] - 1e-9, far[wide:]
    out = np.empty(len(places), bool)
    for k, p in enumerate(places.tolist()):
        # Stretches that begin where ``wide`` places reach beyond this one, and those whose end is this one or a later one.
        mid = min(max(0, p + 2 - wide), len(least))
        out[k] = (mid > 0 and bool((least[:mid] <= far[p + 1]).any())) or bool((least[mid : p + 1] <= ends[mid : p + 1]).any())
    return out


def _may_meet(shared_a, shared_b, meets, threshold: float, wide: int):
    """The meets whose places may lie in a passage: its stretch has a share of t or more in the other text on both sides, and on one side of 2t / (1 + t)."""
    meets = meets[_dense_at(shared_a, threshold, wide, meets[:, 0])]
    if len(meets):
        meets = meets[_dense_at(shared_b, threshold, wide, meets[:, 1])]
    if len(meets):
        share = 2 * threshold / (1 + threshold)
        on = _dense_at(shared_a, share, wide, meets[:, 0])
        meets = meets if on.all() else meets[on | _dense_at(shared_b, share, wide, meets[:, 1])]
    return meets


def _hold(held, sizes, centre, share: float, wide: int):
    """For rows of places (``held``, of which the first ``sizes`` count), whether a stretch of ``wide`` or more around the ``centre`` has a share of ``share`` or more that is held."""
    import numpy as np

    n, m = held.shape
    if m < wide:
        return np.zeros(n, bool)
    sums = np.zeros((n, m + 1), np.float32)
    np.cumsum(held, axis=1, out=sums[:, 1:])
    place = np.arange(m + 1, dtype=np.float32)
    sums -= np.float32(share) * place
    # A stretch ends beyond the centre and begins up to it.
    inner = place <= centre[:, None]
    far = np.where(inner | (place > sizes[:, None]), np.float32(-np.inf), sums)
    far = np.maximum.accumulate(far[:, ::-1], axis=1)[:, ::-1]
    return (inner[:, : m - wide + 1] & (far[:, wide:] >= sums[:, : m - wide + 1] - np.float32(1e-3))).any(1)


def _alike(sizes, places: int = 1 << 20):
    """Rows in groups of like sizes that have up to so many places together, each with its largest size."""
    import numpy as np

    order = np.argsort(sizes, kind="stable")
    end = len(order)
    while end:
        most = int(sizes[order[end - 1]])
        begin = max(int(np.searchsorted(sizes[order], most // 3)), end - max(1, places // max(most, 1)))
        yield order[begin:end], most
        end = begin


def _dense_pairs(col, who, s, sets, centre, might, threshold: float, wide: int, dense: int = 1 << 26):
    """Of the pairs (i, j) that ``might`` marks, those whose centres may lie in a passage: ``_dense`` for many at once.

    A passage's stretch has a share of ``threshold`` or more in the other text on both sides, and on one side of 2t / (1 + t).
    ``col`` numbers the shared shingles of the ``sets``, one after another, of which ``who`` has each.
    """
    import numpy as np

    edges = np.searchsorted(who, np.arange(len(s) + 1))
    # Small blocks have a table of who holds what; in others, where the interval that asks has a shared shingle is marked and the rest look theirs up.
    spot = np.full(int(col.max(initial=-1)) + 1, -1)
    columns = len(spot) + 1
    if len(s) * columns <= dense:
        table = np.zeros((len(s), columns), bool)
        table[who, col] = True
        table[:, -1] = False
        table, upper = table.ravel(), 2 * threshold / (1 + threshold)
        lengths = np.array([len(v) for v in s])
        have = np.concatenate([col[edges[i] : edges[i + 1]][np.searchsorted(sets[i], s[i])] for i in range(len(s))]) % columns
        begins = np.cumsum(lengths) - lengths

        def holds(x, y, share):
            out = np.zeros(len(x), bool)
            # Rows of like lengths together.
            for pairs, n in _alike(lengths[x]):
                i, j = x[pairs], y[pairs]
                held = np.take(have, begins[i][:, None] + np.arange(n), mode="clip")
                held += (j * columns)[:, None]
                out[pairs] = _hold(np.take(table, held), lengths[i], centre[i], share, wide)
            return out

        # Each pair once; what one side does not hold the other is not asked for.
        x, y = np.nonzero(np.triu(might | might.T))
        for one, other in ((0, 1), (1, 0)):
            on = holds(*((x, y)[k] for k in (one, other)), threshold)
            x, y = x[on], y[on]
        most = holds(x, y, upper)
        most[~most] = holds(y[~most], x[~most], upper)
        out = np.zeros_like(might)
        out[x[most], y[most]] = out[y[most], x[most]] = True
        return out
    some, most, asked = np.zeros_like(might), np.zeros_like(might), np.zeros_like(might)

    def ask(i, others) -> None:
        c, n = int(centre[i]), len(s[i])
        own = col[edges[i] : edges[i + 1]]
        mine = np.flatnonzero(own >= 0)
        spot[own[mine]] = mine
        at = np.searchsorted(sets[i], s[i])
        begin = np.arange(min(c, n - wide) + 1)
        least = np.maximum(c + 1, begin + wide)
        asked[i, others] = True
        for lo in range(0, len(others), 128):
            j = others[lo : lo + 128]
            held = edges[j + 1] - edges[j]
            theirs = col[np.repeat(edges[j] - np.cumsum(held) + held, held) + np.arange(held.sum())]
            row, theirs = np.repeat(np.arange(len(j)), held)[theirs >= 0], theirs[theirs >= 0]
            met = spot[theirs]
            holds = np.zeros((len(j), len(own)), bool)
            holds[row[met >= 0], met[met >= 0]] = True
            holds = holds[:, at]
            shared = np.zeros((len(j), n + 1), np.float32)
            np.cumsum(holds, axis=1, out=shared[:, 1:])
            for share, out in ((threshold, some), (2 * threshold / (1 + threshold), most)):
                sums = shared - np.float32(share) * np.arange(n + 1, dtype=np.float32)
                far = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
                out[i, j] = (far[:, least] >= sums[:, begin] - 1e-3).any(1)
        spot[own[mine]] = -1

    # Each pair once, from the side that has most of them, and then what is left from the other side.
    for i in np.argsort(-might.sum(1), kind="stable"):
        others = np.flatnonzero(might[i] & ~asked[:, i])
        if len(others):
            ask(i, others)
    left = (some & might).T & ~asked
    for i in np.flatnonzero(left.any(1)):
        ask(i, np.flatnonzero(left[i]))
    return some & some.T & (most | most.T)


def _numbered(flat):
    """The number of each shingle among those that occur more than once, or -1."""
    import numpy as np

    values, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    return np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[at]


def _shared_counts(col, who, n: int, few: int = 16, columns: int = 1 << 14):
    """How many shared shingles each two of ``n`` intervals have, above the diagonal: of shingles that few intervals have, by their pairs, of others by a matrix product."""
    import numpy as np

    order = np.lexsort((who, col))
    order = order[np.searchsorted(col[order], 0) :]
    c, w = col[order], who[order]
    at = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
    held = np.diff(np.append(at, len(c)))
    # Few shingles are soon multiplied.
    few = few if len(at) > columns else 1
    both = np.zeros(n * n if few > 1 else 1)
    for k in range(2, few + 1):
        own = at[held == k]
        # A block of shingles at a time, so the pairs take little memory.
        for lo in range(0, len(own), 1 << 14):
            rows = w[own[lo : lo + (1 << 14), None] + np.arange(k)].astype(np.int64)
            x, y = np.triu_indices(k, 1)
            both += np.bincount((rows[:, x] * n + rows[:, y]).ravel(), minlength=n * n)
    both = both.astype(np.float32).reshape(n, n) if few > 1 else np.zeros((n, n), np.float32)
    wide_ = held > few
    number = np.repeat(np.cumsum(wide_) - 1, held)
    keep = np.repeat(wide_, held)
    number, w = number[keep], w[keep]
    for lo in range(0, int(wide_.sum()), 4096):
        inside = (number >= lo) & (number < lo + 4096)
        m = np.zeros((n, 4096), np.float32)
        m[w[inside], number[inside] - lo] = 1
        both += m @ m.T
    return both


def _near_share(threshold: float) -> float:
    """The share that two texts have in common where both are similar to a third: distances, 1 - similarity, add up at most."""
    least = max(0.0, 2 * threshold - 1)
    return 2 * least / (1 + least)


def _passages_of(a, b, order, meets, threshold: float, wide: int, near: list | None = None):
    """((a_lo, a_hi), (b_lo, b_hi)) in shingles, ends included: the similar passages of two texts that hold one of the meeting places.

    ``order`` sorts ``b``; ``meets`` is an array of places in both.  ``near`` gets the places of ``a`` that no passage
    holds though a share of ``_near_share`` of a stretch around them is shared.
    """
    import numpy as np

    from .shingles import jaccard

    least = 2 * threshold / (1 + threshold) * wide - 1e-9
    runs = shared_runs(a, b, order, least=least if near is None else wide * _near_share(threshold))
    close = np.empty(0, np.int64)
    if runs is not None:
        if not runs:
            return []
        shared = _covered(runs[0], runs[1], len(a))
        if near is not None:
            close = meets[_dense_at(shared, _near_share(threshold), wide, meets[:, 0]), 0]
            near += close.tolist()
        if (runs[1] - runs[0] + 1).sum() < least:
            return []
        meets = _may_meet(shared, _covered(runs[0] + runs[2], runs[1] + runs[2], len(b)), meets[a[meets[:, 0]] == b[meets[:, 1]]], threshold, wide)
    elif near is not None:
        # So much is repeated that every place may be near.
        close = np.unique(meets[:, 0])
        near += close.tolist()
    found, chains, tried = [], [], set()
    held_a, held_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for ca, cb in sorted(set(map(tuple, meets.tolist()))):
        # Places that passages hold on both sides are done with: a place met its first partner when it was not yet held.
        if held_a[ca] and held_b[cb]:
            continue
        if runs is None:
            # Much repeated words: chains reach so far from the centre.
            around = shared_runs(a, b, order, (max(0, ca - REACH), min(len(a) - 1, ca + REACH)), (max(0, cb - REACH), min(len(b) - 1, cb + REACH)))
            chain = aligned(around, ca, cb, threshold)
        else:
            chain = next((h for h in chains if (k := int(np.searchsorted(h[0], ca))) < len(h[0]) and h[0][k] == ca and h[1][k] == cb), None)
            if chain is None:
                chain = aligned(runs, ca, cb, threshold)
                chains.append(chain)
        if len(chain[0]) < least:
            continue
        for (al, ah), (bl, bh) in stretches(chain, ca, len(a), len(b), threshold, wide):
            if (al, ah, bl, bh) in tried:
                continue
            tried.add((al, ah, bl, bh))
            if jaccard(np.unique(a[al : ah + 1]), np.unique(b[bl : bh + 1])) >= threshold:
                found.append(((al, ah), (bl, bh)))
                held_a[al : ah + 1] = held_b[bl : bh + 1] = True
                break
    if len(close) and found:
        near[:] = close[~held_a[close]].tolist()
    return found


_PAIR = "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long"
_NAMES = ["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"]


def _arrays(found: list[tuple]):
    import pyarrow as pa

    f = list(zip(*found)) or [()] * 6
    return [pa.array(f[k], pa.int64()) for k in range(6)]


def _compared(meets: DataFrame, texts: DataFrame, min_words: int, size: int, threshold: float) -> DataFrame:
    """(a, a_lo, a_hi, b, b_lo, b_hi): word ranges, ends excluded, of similar passages of each pair of texts that met.

    Rows with a null ``a_lo`` tell a place of ``b`` where a pair nearly has a passage.

    A text's shingles are made once.  The host ``a`` goes whole to each ``PARTNERS`` of its partners, and of each
    partner only what its intervals span, since they hold all passages that share their values.
    """
    met = meets.where("a <> b").groupBy("a", "b").agg(
        F.min(_centre("pb") - _before("pb")).alias("lo"), F.max(_centre("pb") + _after("pb")).alias("hi"), F.collect_list(_centre("pa")).alias("ca"), F.collect_list(_centre("pb")).alias("cb")
    )
    met = stored(met, "met")
    homes = met.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    role = ["a", "part", "lo", "hi", "ca", "cb"]
    guests = met.join(homes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select(F.col("b").alias("key"), F.struct(*role).alias("g"))
    none = {"lo": F.lit(0).cast("long"), "hi": F.lit((1 << 62) - 1), "ca": F.lit(None).cast("array<bigint>"), "cb": F.lit(None).cast("array<bigint>")}
    hosts = homes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(none).select(F.col("a").alias("key"), F.struct(*role).alias("g"))
    roles = guests.unionByName(hosts).groupBy("key").agg(F.collect_list("g").alias("roles")).join(texts, "key")
    wide = min_words - size + 1

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from .shingles import shingles_of, words

        for x in sliced(batches, 32):
            every = shingles_of([words(t) for t in x.column("text").to_pylist()], size)
            flat, who = pc.list_flatten(x.column("roles")), pc.list_parent_indices(x.column("roles"))
            pieces = [every[i][lo : hi + 1] for i, lo, hi in zip(who.to_numpy(), flat.field("lo").to_numpy(), flat.field("hi").to_numpy())]
            edges = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            s = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(pieces).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[flat.field(n) for n in ("a", "part", "lo", "ca", "cb")], x.column("key").take(who), s], ["a", "part", "lo", "ca", "cb", "b", "s"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def lists(column):
            values, edges = column.values.to_numpy(), column.offsets.to_numpy()
            return lambda i: values[edges[i] : edges[i + 1]]

        home = None
        for x in sliced(batches):
            out, s, ca, cb = [], *(lists(x.column(n)) for n in ("s", "ca", "cb"))
            hosts = x.column("ca").is_null().to_pylist()
            for i, (ka, kb, lo, host) in enumerate(zip(*(x.column(n).to_pylist() for n in ("a", "b", "lo")), hosts)):
                own = s(i).view(np.uint64)
                if host:
                    home = own.copy(), np.argsort(own, kind="stable")
                    continue
                near = []
                for (bl, bh), (al, ah) in _passages_of(own, *home, np.stack([cb(i) - lo, ca(i)], 1), threshold, wide, near):
                    out.append((ka, al, ah + size, kb, lo + bl, lo + bh + size))
                out += [(ka, None, None, kb, lo + c, None) for c in dict.fromkeys(near)]
            yield pa.RecordBatch.from_arrays(_arrays(out), _NAMES)

    pieces = roles.mapInArrow(cut, "a long, part int, lo long, ca array<long>, cb array<long>, b long, s array<long>")
    return pieces.repartition("a", "part").sortWithinPartitions("a", "part", F.col("ca").isNotNull()).mapInArrow(run, _PAIR)


def _may_link(flat, edges, centre, root, threshold: float, wide: int):
    """Which intervals may have a passage with one of another root.

    ``flat`` has the shingles of all, one interval after another, and ``edges`` where each begins.  A passage's stretch around
    the centre has a share of ``threshold`` in the other text, so in intervals of other roots taken together.  What drops out holds nothing for the rest.
    """
    import numpy as np

    at = np.unique(flat, return_inverse=True)[1]
    sizes = np.diff(edges)
    who, alive = np.repeat(np.arange(len(sizes)), sizes), np.ones(len(sizes), bool)
    of, most = root[who], int(root.max()) + 1
    while True:
        low, high = np.full(at.max() + 1, most), np.full(at.max() + 1, -1)
        on = alive[who]
        np.minimum.at(low, at[on], of[on])
        np.maximum.at(high, at[on], of[on])
        held = (low < high)[at]
        now = alive & (np.add.reduceat(held, edges[:-1], dtype=np.int64) >= threshold * wide - 1e-9)
        todo = np.flatnonzero(now)
        for some, most_ in _alike(sizes[todo]):
            i = todo[some]
            own = held[np.minimum(edges[i][:, None] + np.arange(most_), len(held) - 1)]
            now[i] = _hold(own, sizes[i], centre[i], threshold, wide)
        # Each round leaves less; the last ones are not worth their time.
        if now.sum() * 10 > alive.sum() * 9 or not now.any():
            return now
        alive = now


_PIECE = "value long, key long, root long, left long, centre long, s array<long>, beside boolean"


def _thinned(pieces: DataFrame, sizes: DataFrame, threshold: float, wide: int) -> DataFrame:
    """The ``pieces`` of values that are too large for a task which may have a passage with a piece of another root, as ``_may_link`` tells.

    ``sizes`` (value, n, shingles) has these values.  Slices of a value's pieces tell their shingles with the smallest and largest root, parts of
    the shingles are put together, and those of several roots go to each slice before its pieces.
    """
    dealt = sizes.select("value", F.ceil(F.greatest(F.col("n"), F.col("shingles") / 64) / SLICE).cast("int").alias("slices"), F.ceil(F.col("shingles") / 64 / SLICE).cast("int").alias("parts"))
    own = pieces.join(dealt, "value").withColumn("slice", F.pmod(F.xxhash64("key", "left"), F.col("slices")).cast("int"))
    own = stored(own.repartition("value", "slice").sortWithinPartitions("value", "slice"), "slices")

    def tell(keys, table):
        import numpy as np
        import pyarrow as pa

        lists, parts = table["s"].combine_chunks(), table["parts"][0].as_py()
        flat, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        root = np.repeat(table["root"].to_numpy(), np.diff(lists.offsets.to_numpy()))
        low, high = np.full(len(flat), np.iinfo(np.int64).max), np.full(len(flat), np.iinfo(np.int64).min)
        np.minimum.at(low, at, root)
        np.maximum.at(high, at, root)
        part = flat.view(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        edges = pa.array(np.append(first, len(order)).astype(np.int32))
        cut = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (flat, low, high)]
        return pa.Table.from_arrays([pa.array(np.full(len(found), keys[0].as_py())), pa.array(found.astype(np.int32)), *cut], ["value", "part", "s", "low", "high"])

    def join(keys, table):
        import numpy as np
        import pyarrow as pa

        flat, root_low, root_high = (table[c].combine_chunks().flatten().to_numpy() for c in ("s", "low", "high"))
        flat, at = np.unique(flat, return_inverse=True)
        low, high = np.full(len(flat), np.iinfo(np.int64).max), np.full(len(flat), np.iinfo(np.int64).min)
        np.minimum.at(low, at, root_low)
        np.maximum.at(high, at, root_high)
        return pa.table({"value": pa.array([keys[0].as_py()]), "s": pa.array([flat[low < high]], pa.list_(pa.int64()))})

    told = own.groupBy("value", "slice").applyInArrow(tell, "value long, part int, s array<long>, low array<long>, high array<long>")
    several = told.groupBy("value", "part").applyInArrow(join, "value long, s array<long>")
    heads = several.join(dealt, "value").select("value", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("key"), "s")

    def keep(batches: Iterator) -> Iterator:
        import numpy as np

        now, held, sorted_ = None, [], None
        for x in sliced(batches):
            kept, lists = [], x.column("s")
            flat, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            names = [x.column(c).to_pylist() for c in ("value", "slice", "key", "centre")]
            for i, (value, slice_, key, centre) in enumerate(zip(*names)):
                own_ = flat[edges[i] : edges[i + 1]]
                if (value, slice_) != now:
                    now, held, sorted_ = (value, slice_), [], None
                if key is None:
                    held.append(own_.copy())
                    continue
                if sorted_ is None:
                    sorted_ = np.sort(np.concatenate(held)) if held else np.empty(0, np.int64)
                if len(sorted_):
                    have = sorted_[np.minimum(np.searchsorted(sorted_, own_), len(sorted_) - 1)] == own_
                    kept += [i] if _hold(have[None, :], np.array([len(own_)]), np.array([centre]), threshold, wide)[0] else []
            yield x.take(pa_indices(kept)).select(["value", "key", "root", "left", "centre", "s", "beside"])

    def pa_indices(kept):
        import pyarrow as pa

        return pa.array(kept, pa.int64())

    both = own.drop("slices", "parts").unionByName(heads, allowMissingColumns=True)
    return both.repartition("value", "slice").sortWithinPartitions("value", "slice", F.col("key").isNotNull()).mapInArrow(keep, _PIECE)


def _crowded(members: DataFrame, texts: DataFrame, min_words: int, size: int, threshold: float, many: int) -> DataFrame:
    """As ``_compared``: links between intervals of one value (value, key, place, root, beside) whose passages have different roots.

    A link is left out only where its two roots are already joined within the task.
    Values of more than ``many`` intervals are thinned before they are dealt.
    """
    wide = min_words - size + 1
    of_text = members.groupBy("key").agg(F.collect_list(F.struct("value", "place", "root", "beside")).alias("own")).join(texts, "key")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import shingles_of, words

        side = (1 << SIDE) - 1
        for x in sliced(batches, 32):
            out, every = [], shingles_of([words(t) for t in x.column("text").to_pylist()], size)
            for key, own, s in zip(x.column("key").to_pylist(), x.column("own").to_pylist(), every):
                s = s.view(np.int64)
                for m in own:
                    c, before, after = m["place"] >> 2 * SIDE, m["place"] >> SIDE & side, m["place"] & side
                    out.append((m["value"], key, m["root"], c - before, before, s[c - before : c + after + 1], m["beside"]))
            f = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(f, kinds)], ["value", "key", "root", "left", "centre", "s", "beside"])

    pieces = stored(of_text.mapInArrow(cut, _PIECE), "pieces")
    hot = stored(members.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum(_before("place") + _after("place") + 1).alias("shingles")).where(F.col("n") > many), "hot")
    if not hot.isEmpty():
        few = pieces.join(hot.select("value"), "value", "left_anti").select(*pieces.columns)
        pieces = stored(few.unionByName(_thinned(pieces.join(hot.select("value"), "value", "left_semi"), hot, threshold, wide)), "pieces")
    # Small values are one block.  Else blocks of what lies beside the first interval's class meet each other and the blocks of that class, which do not meet each other.
    sized = pieces.groupBy("value").agg(F.ceil(F.count_if("beside") / BLOCK).cast("int").alias("nb"), F.ceil(F.count_if(~F.col("beside")) / BLOCK).cast("int").alias("nh"), (F.count(F.lit(1)) <= BLOCK).alias("one"))
    held = pieces.join(sized, "value").withColumn("own", F.when(F.col("one"), 0).otherwise(F.pmod(F.xxhash64("key", "left"), F.greatest(F.when(F.col("beside"), F.col("nb")).otherwise(F.col("nh")), F.lit(1)))).cast("int"))
    spot = lambda i, j, h: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), h.cast("int").alias("h"))
    among = F.transform(F.sequence(F.lit(0), F.greatest("nb", F.lit(1)) - 1), lambda k: spot(F.least("own", k), F.greatest("own", k), F.lit(-1)))
    across = F.when(F.col("nh") > 0, F.transform(F.sequence(F.lit(0), F.greatest("nh", F.lit(1)) - 1), lambda k: spot(F.col("own"), F.col("own"), k))).otherwise(F.array().cast("array<struct<i:int,j:int,h:int>>"))
    of_class = F.when(F.col("nb") > 0, F.transform(F.sequence(F.lit(0), F.greatest("nb", F.lit(1)) - 1), lambda k: spot(k, k, F.col("own")))).otherwise(F.array().cast("array<struct<i:int,j:int,h:int>>"))
    dealt = held.withColumn("spot", F.explode(F.when(F.col("one"), F.array(spot(F.lit(0), F.lit(0), F.lit(-1)))).when(F.col("beside"), F.concat(among, across)).otherwise(of_class))).select("value", "key", "root", "left", "centre", "s", "beside", "own", "spot.*")

    def run(keys, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("key", "ascending"), ("left", "ascending")]).combine_chunks()
        lists = table["s"].combine_chunks()
        edges = lists.offsets.to_numpy()
        roots = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        table = table.filter(pa.array(_may_link(lists.values.to_numpy()[edges[0] : edges[-1]], edges - edges[0], table["centre"].to_numpy(), roots, threshold, wide)))
        if not len(table):
            return pa.Table.from_arrays(_arrays([]), _NAMES)
        lists = table["s"].combine_chunks()
        flat, edges = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        s = [flat[i:j] for i, j in zip(edges[:-1], edges[1:])]
        # Each interval's different shingles in order, one interval after another.
        flat, who = flat[edges[0] : edges[-1]], np.repeat(np.arange(len(s)), np.diff(edges))
        order = np.lexsort((flat, who))
        flat, who = flat[order], who[order]
        new = np.append(True, (flat[1:] != flat[:-1]) | (who[1:] != who[:-1]))
        # A shingle that both intervals repeat is shared as often.
        first = np.flatnonzero(new)
        with np.errstate(over="ignore"):
            repeats = flat + (np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        both = _shared_counts(_numbered(repeats), who, len(s))
        flat, who = flat[new], who[new]
        sets = np.split(flat, np.searchsorted(who, np.arange(1, len(s))))
        col = _numbered(flat)
        key, left, centre, side, root = (table[c].to_numpy() for c in ("key", "left", "centre", "own", "root"))
        root, beside = np.unique(root, return_inverse=True)[1], np.asarray(table["beside"].to_pylist(), bool)
        might = np.triu(both >= 2 * threshold / (1 + threshold) * wide - 1e-3, 1) & (key[:, None] != key[None, :])
        if keys[3].as_py() >= 0:
            might &= beside[:, None] != beside[None, :]
        elif keys[1] != keys[2]:
            might &= side[:, None] != side[None, :]
        might &= root[:, None] != root[None, :]
        might |= might.T
        might &= _dense_pairs(col, who, s, sets, centre, might, threshold, wide)
        x, y = np.nonzero(np.triu(might))
        orders, out = {}, []
        for k in np.argsort(-both[x, y], kind="stable"):
            i, j = int(x[k]), int(y[k])
            if root[i] == root[j]:
                continue
            if j not in orders:
                orders[j] = np.argsort(s[j], kind="stable")
            found = _passages_of(s[i], s[j], orders[j], np.array([[centre[i], centre[j]]]), threshold, wide)
            out += [(int(key[i]), int(left[i]) + p[0], int(left[i]) + p[1] + size, int(key[j]), int(left[j]) + q[0], int(left[j]) + q[1] + size) for p, q in found]
            if found:
                root[root == root[j]] = root[i]
        return pa.Table.from_arrays(_arrays(out), _NAMES)

    return dealt.groupBy("value", "i", "j", "h").applyInArrow(run, _PAIR)


def _classed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, lo, hi, p, root): merged passages of each text and the smallest passage of each one's class."""
    whole = nodes.where("copies > 1").select("key", F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))
    spans = links.select(F.col("a").alias("key"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).unionByName(links.select(F.col("b").alias("key"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))).unionByName(whole).distinct()
    p = stored(_merged(spans), "passages").withColumn("p", F.struct("key", "lo"))
    l = links.join(p.select(F.col("key").alias("a"), F.col("lo").alias("pl"), F.col("hi").alias("ph"), F.col("p").alias("x")), "a").where("a_lo >= pl and a_hi <= ph").select("b", "b_lo", "b_hi", "x")
    l = l.join(p.select(F.col("key").alias("b"), F.col("lo").alias("pl"), F.col("hi").alias("ph"), F.col("p").alias("y")), "b").where("b_lo >= pl and b_hi <= ph").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return p.join(components(l).withColumnRenamed("node", "p"), "p", "left").withColumn("root", F.coalesce("root", "p"))


def repeated(docs: DataFrame, min_words: int = 50, size: int = 5, threshold: float = 0.8, bands: int = BANDS, few: int = FEW, many: int | None = None) -> DataFrame:
    """(doc_id, start_word, n_words, class_doc, class_start): passages that are near duplicates of passages of other documents.

    A class is named by its smallest document and the passage's start there.
    Overlapping passages of a document are one.  Keys that more than ``many`` (``MANY``) intervals have lose those that can have no passage with
    one outside their class before the rest is compared; the result does not depend on it.
    """
    many = MANY if many is None else many
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = stored(_named(own, min_words), "named")
    nodes = stored(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.min("n").alias("n")), "nodes")
    meets = stored(_meets(intervals(own, min_words, size, bands), few), "meets")
    # Texts that met, one per key: fetched by id and hash of a row that has it.
    wanted = meets.where("a <> b").select(F.col("a").alias("key")).union(meets.where("a <> b").select("b")).distinct()
    reps = named.join(wanted, "key").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("key", "r.doc_id", "r.text_hash")
    texts = own.withColumn("text_hash", F.xxhash64("text")).join(small(stored(reps, "reps")), ["doc_id", "text_hash"]).dropDuplicates(["key"]).select("key", "text")
    texts = stored(texts, "texts")

    compared = stored(_compared(meets, texts, min_words, size, threshold), "compared")
    links = compared.where("a_lo is not null")
    placed_ = stored(_classed(links, nodes), "classed")
    # Intervals of large values, with the class of the passage that holds them or one of their own.
    members = meets.where("large").select("value", F.col("b").alias("key"), F.col("pb").alias("place")).distinct()
    inside = placed_.select("key", "lo", "hi", F.xxhash64("root.key", "root.lo").alias("root"))
    met = members.join(inside, (members["key"] == inside["key"]) & (_centre("place") >= F.col("lo")) & (_centre("place") < F.col("hi")), "left")
    met = met.select("value", members["key"], "place", F.coalesce("root", F.xxhash64(members["key"], "place")).alias("root"))
    met = stored(met, "members")
    # What lies in a passage of the first interval's class is compared again only where another comes near it.
    nearly = compared.where("a_lo is null").select(F.col("b").alias("key"), F.col("b_lo").alias("centre")).distinct().withColumn("near", F.lit(True))
    met = met.withColumn("centre", _centre("place")).join(nearly, ["key", "centre"], "left").select("value", "key", "place", "root", F.coalesce("near", F.lit(False)).alias("near"))
    heads = met.groupBy("value").agg(F.min_by("root", "key").alias("head"))
    met = stored(met.join(heads, "value").withColumn("beside", F.col("root") != F.col("head")), "members")
    apart = met.where("beside").groupBy("value").agg(F.max("near").alias("any_near"), F.min("root").alias("x"), F.max("root").alias("y")).where("any_near or x <> y").select("value", "any_near")
    crowd = stored(met.join(apart, "value").where("beside or any_near").select("value", "key", "place", "root", "beside"), "crowd")
    more = stored(_crowded(crowd, texts, min_words, size, threshold, many), "links")
    if not more.isEmpty():
        placed_ = _classed(links.unionByName(more), nodes)
    placed_ = placed_.join(nodes.select("key", "rep"), "key")
    names = placed_.groupBy("root").agg(F.min(F.struct("rep", "lo")).alias("name"))
    info = placed_.join(names, "root").select("key", "lo", "hi", F.col("name.rep").alias("class_doc"), F.col("name.lo").alias("class_start"))
    return named.select("doc_id", "key").join(info, "key").select("doc_id", F.col("lo").alias("start_word"), (F.col("hi") - F.col("lo")).alias("n_words"), "class_doc", "class_start")


def _named(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, key, n) of every text of ``min_words`` words or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x in sliced(batches):
            found = [keyed(t) for t in x.column("text").to_pylist()]
            n = pa.array([len(w) for _, w in found], pa.int32())
            keep = pa.array([len(w) >= min_words for _, w in found], pa.bool_())
            columns = [x.column("doc_id"), x.column("text_hash"), pa.array([k for k, _ in found], pa.int64()), n]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["doc_id", "text_hash", "key", "n"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, key long, n int")


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text as one: the classic gaps-and-islands window, per text."""
    w = Window.partitionBy("key").orderBy("lo", "hi")
    far = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(far.isNull() | (F.col("lo") >= far), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy("key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")
