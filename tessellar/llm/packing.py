"""Mixture-controlled packing by deficit round-robin over source queues.

A source's documents, each with its end id, form one queue of tokens, cut into
packets of ``packet`` tokens (the last may be shorter).  In every round a queue's
credit grows by its quantum, the share of a window that its target proportion
gives it, and it sends every whole packet its credit covers; what is left is the
deficit that the next round begins with.  Rounds follow one another and windows of
``length`` tokens are cut from the whole, so a window holds the target
proportions but for the deficits, and only the last one can be short.

With equal packets the rounds have a closed form: after round r a queue has sent
``packet * floor(r * quantum / packet)`` tokens, or all it has.  A token's window
follows from its place in its queue and the table of queues alone, so after a
document knows its place nothing is shuffled and no state passes from task to
task: the deficits carry across windows and partitions by arithmetic.

A document's place comes from two running counts: within the task that encoded
it, kept with its row, and over the tasks before, from a sum per task and queue.

Proportions are those of the corpus or ``weights`` by source; a queue that ends early leaves
its turn to the rest.  There are at most ``max_queues`` queues, since every task holds their table: more sources than that share
queues by a hash of their name, and a shared queue has its sources' proportions together.

Edge cases: a null text is an empty one and has only the end id; a null source
is a queue of its own; rows that repeat an id are documents each; a very long text spans windows;
sources of unknown weight get the smallest; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, small, stored

#: Credits are counted in 1/2**16 tokens.
UNIT = 1 << 16
MAX_QUEUES = 1024
#: Rounds times queues that a task works on at once.
CELLS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, packet: int = 64, weights: dict[str, float] | None = None, max_queues: int = MAX_QUEUES, with_ids: bool = False) -> DataFrame:
    """A row per piece: its document, where it starts there, its length and checksum, and its sequence and offset; with ``with_ids`` the ids."""
    tokens = stored(_encoded(docs, tokenizer, end_id, max_queues), "packed")
    # What was encoded before, per task and queue, and the queues: rows that count tasks and queues, not documents.
    sums = stored(tokens.groupBy("queue", "task").agg(F.sum("n").alias("n")), "sums")
    w = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("queue", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("before"))
    # At most max_queues rows come to the driver.
    held = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    held = held.join(_shares(tokens, weights), "queue") if weights is not None else held.withColumn("share", F.col("n").cast("double"))
    queues = sorted((r["queue"], r["n"], r["share"]) for r in held.collect())
    placed = tokens.join(small(before), ["queue", "task"]).select("doc_id", "queue", (F.col("before") + F.col("start_in_task")).alias("place"), "n", "ids")
    return _pieces(placed, queues, length, packet, with_ids)


def _shares(tokens: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(queue, share): the weights of each queue's sources together; sources that ``weights`` lacks have its smallest."""
    known = tokens.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
    names = tokens.select("queue", "name").distinct().join(small(known), "name", "left")
    return names.groupBy("queue").agg(F.sum(F.coalesce("weight", F.lit(min(weights.values(), default=1.0)))).alias("share"))


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, max_queues: int) -> DataFrame:
    """(task, queue, name, doc_id, n, start_in_task, ids): ids as bytes, counted along each queue within the task."""
    sources = docs.select("source").distinct().limit(max_queues + 1).count()
    queue = F.coalesce(F.pmod(F.xxhash64("source"), F.lit(2**40 if sources <= max_queues else max_queues)), F.lit(-1)).cast("long")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokenize import encoder

        enc, task, so_far = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for b in sliced(batches):
            ids = [enc.encode(t) + end for t in b.column("text").to_pylist()]
            n, at = [len(x) // 4 for x in ids], []
            for q, k in zip(b.column("queue").to_pylist(), n):
                at.append(so_far.get(q, 0))
                so_far[q] = at[-1] + k
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), task, np.int32)), b.column("queue"), b.column("name"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())],
                ["task", "queue", "name", "doc_id", "n", "start_in_task", "ids"],
            )

    rows = docs.select(queue.alias("queue"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "task int, queue long, name string, doc_id long, n long, start_in_task long, ids binary")


def quanta(queues: list[tuple[int, int, float]], length: int) -> list[int]:
    """Each queue's credit per round, in 1/``UNIT`` tokens: together a window."""
    total = sum(share for _, _, share in queues) or 1.0
    return [max(1, round(length * UNIT * share / total)) for _, _, share in queues]


def _pieces(placed: DataFrame, queues: list[tuple[int, int, float]], length: int, packet: int, with_ids: bool) -> DataFrame:
    names = [q for q, _, _ in queues]
    held, credit = [n for _, n, _ in queues], quanta(queues, length)
    total = sum(held)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        own = {q: i for i, q in enumerate(names)}
        T, Q = np.array(held, np.int64), np.array(credit, np.int64)

        def sent(r):
            """Tokens that each queue has sent after each of the rounds ``r``: (rounds, queues)."""
            return np.minimum(T, packet * (r[:, None] * Q // (packet * UNIT)))

        def runs(q, place, n):
            """Of documents in queue ``q`` from ``place`` on: (document, begin, stop, position) of what each round sends of them."""
            first, last = place // packet, (place + n - 1) // packet
            count = last - first + 1
            doc = np.repeat(np.arange(len(q)), count)
            pack_ = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
            rounds = -(-((pack_ + 1) * packet * UNIT) // Q[q[doc]])
            # Packets of one document and round lie together.
            new = np.flatnonzero(np.append(True, (rounds[1:] != rounds[:-1]) | (doc[1:] != doc[:-1])))
            doc, r = doc[new], rounds[new]
            begin = np.maximum(pack_[new] * packet, place[doc])
            end = (place + n)[doc]
            stop = np.where(np.append(doc[1:] == doc[:-1], False), np.append(begin[1:], 0), end)
            own, at = np.unique(r, return_inverse=True)
            x, by_round, step = np.empty(len(r), np.int64), np.argsort(at, kind="stable"), max(1, CELLS // len(T))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                was, now = sent(some - 1), sent(some)
                before = np.cumsum(now - was, axis=1) - (now - was)
                i = by_round[slice(*np.searchsorted(at[by_round], [lo, lo + step]))]
                k, mine = at[i] - lo, q[doc[i]]
                x[i] = was.sum(1)[k] + before[k, mine] + begin[i] - was[k, mine]
            return doc, begin, stop, x

        def cut(doc, begin, stop, x):
            """The same, cut at the ends of windows."""
            count = (x + (stop - begin) - 1) // length - x // length + 1
            i = np.repeat(np.arange(len(doc)), count)
            k = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            lo = np.maximum(x[i], (x[i] // length + k) * length)
            hi = np.minimum(x[i] + (stop - begin)[i], (x[i] // length + k + 1) * length)
            return doc[i], begin[i] + lo - x[i], hi - lo, lo

        for b in sliced(batches):
            q = np.array([own[v] for v in b.column("queue").to_pylist()], np.int64)
            place, n = b.column("place").to_numpy(), b.column("n").to_numpy()
            doc, begin, size, x = cut(*runs(q, place, n))
            start = begin - place[doc]
            texts = b.column("ids").to_pylist()
            pieces = [memoryview(texts[d])[lo:hi] for d, lo, hi in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist())]
            crc = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces))
            # Only the last sequence can be short; one that ends at a power of two needs no padding.
            filled = np.minimum(length, total - x // length * length)
            pad = np.where(filled & (filled - 1) == 0, 0, length - filled)
            arrays = [b.column("doc_id").take(pa.array(doc)), *[pa.array(v.astype(np.int64)) for v in (start, size, crc, n[doc], x // length, x % length, pad)]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<i4") for p in pieces], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids)

    return placed.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
