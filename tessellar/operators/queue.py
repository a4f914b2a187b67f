"""The durable work queue, as snapshots: every transition is a conditional column, every claim a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.storage import snapshot

KEY = ["namespace", "operation", "item_key"]
MAX_ATTEMPTS, STALE_S, BREAKER = 8, 1800, 5


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New keys are added as pending; known ones stay, dead ones dead."""
    rows = new.dropDuplicates(KEY).join(queue, KEY, "left_anti").withColumn("status", F.lit("pending"))
    return queue.unionByName(rows, allowMissingColumns=True)


def enqueue_with_priority(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Raises priorities; what is failed or skipped is pending again, what is done or dead stays."""
    raised = new.groupBy(*KEY).agg(F.max("priority").alias("_p"))
    met = queue.join(raised, KEY, "left")
    hit = F.col("_p").isNotNull()
    known = met.withColumns({"priority": F.when(hit, F.greatest("priority", "_p")).otherwise(F.col("priority")), "status": F.when(hit & F.col("status").isin("failed", "skipped"), "pending").otherwise(F.col("status"))})
    return enqueue(known.select(*queue.columns), new)


def eligible(now: int, backoff: Column | None = None) -> Column:
    """Pending, and past its backoff where it has one."""
    ok = F.col("status") == "pending"
    return ok & (backoff.isNull() | (backoff <= now)) if backoff is not None else ok


def claim(queue: DataFrame, n: int, now: int, operation: str | None = None, namespace: str | None = None) -> DataFrame:
    """The rows that the next claims of each operation and namespace take: by priority, then id; with their attempt counted.

    The rank filter limits within each task before the shuffle, so a long queue does not gather.
    """
    rows = queue.where(eligible(now, F.col("next_retry_at") if "next_retry_at" in queue.columns else None))
    if operation:
        rows = rows.where(F.col("operation") == operation)
    if namespace:
        rows = rows.where(F.col("namespace") == namespace)
    w = Window.partitionBy("namespace", "operation").orderBy(F.desc("priority"), "id")
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return top.withColumns({"status": F.lit("processing"), "attempt": F.col("attempt") + 1, "claimed_at": F.lit(now).cast("bigint")})


def apply_changes(queue: DataFrame, changed: DataFrame) -> DataFrame:
    return queue.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def status(queue: DataFrame) -> DataFrame:
    """(operation, pending, processing, done, dead, state)."""
    by = queue.groupBy("operation").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "dead")])
    return by.withColumn("state", derived_state())


def derived_state(cooling: Column | None = None) -> Column:
    work = F.when(F.col("processing") > 0, "draining")
    if cooling is not None:
        work = work.when((F.col("pending") > 0) & cooling, "cooldown")
    return work.when(F.col("pending") > 0, "draining").when(F.col("dead") > 0, "blocked_dead").when(F.col("done") > 0, "pending-scan").otherwise("empty")


def eligible_count(queue: DataFrame, now: int) -> DataFrame:
    return queue.where(eligible(now)).groupBy("operation").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("priority") > 0).alias("urgent"))


def fail(queue: DataFrame, failures: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failures (id, error, hard): hard ones and worn-out ones are dead, others wait for their backoff."""
    from tessellar.functions import text as X

    met = queue.join(failures.select("id", F.col("error").alias("_e"), F.col("hard").alias("_h")), "id", "left")
    hit = F.col("_h").isNotNull()
    dead = F.col("_h") | (F.col("attempt") >= max_attempts)
    out = met.withColumn("status", F.when(hit & dead, "dead").when(hit, "pending").otherwise(F.col("status")))
    out = out.withColumn("error", F.when(hit, F.col("_e")).otherwise(F.col("error") if "error" in queue.columns else F.lit(None)))
    return out.withColumn("next_retry_at", F.when(hit & ~dead, F.lit(now) + (X.backoff_ms(F.col("attempt")) / 1000).cast("bigint")).otherwise(F.col("next_retry_at") if "next_retry_at" in queue.columns else F.lit(None))).drop("_e", "_h")


def reset_stale(queue: DataFrame, now: int, after: int = STALE_S) -> DataFrame:
    """Claims without a heartbeat are pending again."""
    old = (F.col("status") == "processing") & (F.col("claimed_at") <= now - after)
    return queue.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def heartbeat(queue: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return transition(queue, ids, claimed_at=F.lit(now).cast("bigint"))


def transition(queue: DataFrame, ids: DataFrame, where: Column | None = None, **new: Column) -> DataFrame:
    """Columns set on the rows of the ids: done, skipped, rate-limited, wrong operation, re-opened."""
    met = queue.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (where if where is not None else F.lit(True))
    return met.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(*queue.columns)


def mark_done(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(queue, ids, status=F.lit("done"))


def mark_skipped(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(queue, ids, status=F.lit("skipped"))


def reopen(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(queue, ids, F.col("status").isin("skipped", "done"), status=F.lit("pending"))


def reset_operation(queue: DataFrame, operation: str, state: str = "processing") -> DataFrame:
    hit = (F.col("operation") == operation) & (F.col("status") == state)
    return queue.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def listed(queue: DataFrame, state: str, operation: str | None = None, limit: int = 100) -> DataFrame:
    """The rows of a state, dead or skipped ones for instance, by id."""
    rows = queue.where(F.col("status") == state)
    return (rows.where(F.col("operation") == operation) if operation else rows).orderBy("id").limit(limit)


def requeue(queue: DataFrame, state: str = "dead", operation: str | None = None) -> DataFrame:
    """Rows of a state are pending again, with their attempts forgotten."""
    hit = F.col("status") == state
    if operation:
        hit = hit & (F.col("operation") == operation)
    return queue.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "attempt": F.when(hit, 0).otherwise(F.col("attempt"))})


def reconcile(queue: DataFrame, satisfied: DataFrame) -> DataFrame:
    """Pending re-embed rows whose vector exists (item_key) are done."""
    met = queue.join(satisfied.select("item_key", F.lit(True).alias("_ok")).distinct(), "item_key", "left")
    hit = F.coalesce("_ok", F.lit(False)) & (F.col("operation") == "ReEmbed") & (F.col("status") == "pending")
    return met.withColumn("status", F.when(hit, "done").otherwise(F.col("status"))).select(*queue.columns)


def prune_dead(queue: DataFrame, memories: DataFrame) -> DataFrame:
    """Without dead rows of memories that are gone, and dead rows of entities."""
    dead = F.col("status") == "dead"
    gone = queue.where(dead & (item_type(F.col("item_key")) == "memory")).join(memories.select(F.col("name").alias("item_key")), "item_key", "left_anti").select("id")
    return queue.join(gone, "id", "left_anti").where(~(dead & (item_type(F.col("item_key")) == "entity")))


def item_type(key: Column) -> Column:
    """What a key's shape stands for."""
    return F.when(key.startswith("pair:"), "entity_pair").when(key.startswith("entity:"), "entity").when(key.startswith("chunk:"), "chunk").otherwise("memory")


def drop_items(queue: DataFrame, keys: DataFrame) -> DataFrame:
    """Without rows of forgotten or purged items (item_key)."""
    return queue.join(keys.select("item_key"), "item_key", "left_anti")


def breaker(outcomes: DataFrame, limit: int = BREAKER) -> DataFrame:
    """(operation, seq, open): outcomes (operation, seq, hard) in order; open from the ``limit``-th hard failure in a row on, until a success or a soft one.

    Runs are counted within ranges of the order; a range that begins inside a run adds what the ranges before it carry over, a row for each range and operation.
    """
    order = ["operation", "seq"]
    laid = outcomes.select("operation", "seq", F.coalesce("hard", F.lit(False)).alias("hard")).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = snapshot(laid.withColumn("_part", F.spark_partition_id()), "outcomes")
    w = Window.partitionBy("_part", "operation").orderBy("seq")
    # Rows since the last one that ends a run; none yet in the range's first run.
    local = laid.withColumns({"_k": F.row_number().over(w), "_end": F.max(~F.col("hard")).over(w)})
    local = local.withColumn("_run", F.col("_k") - F.coalesce(F.max(F.when(~F.col("hard"), F.col("_k"))).over(w), F.lit(0)))
    edge = local.groupBy("_part", "operation").agg(F.max_by("_run", "_k").alias("_tail"), F.count_if(~F.col("hard")).alias("_ends"))
    before = Window.partitionBy("operation").orderBy("_part")
    # Ranges since the last one with an end, that one's tail included.
    grouped = edge.withColumn("_group", F.sum(F.when(F.col("_ends") > 0, 1).otherwise(0)).over(before))
    carry = grouped.withColumn("_sum", F.sum("_tail").over(Window.partitionBy("operation", "_group").orderBy("_part"))).withColumn("_carry", F.coalesce(F.lag("_sum").over(before), F.lit(0)))
    met = local.join(F.broadcast(carry.select("_part", "operation", "_carry")), ["_part", "operation"])
    run = F.col("_run") + F.when(F.col("_end"), 0).otherwise(F.col("_carry"))
    return met.select("operation", "seq", (run >= limit).alias("open"))


def stage_cleanup(staged: DataFrame, before: int, terminal: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Staging rows without terminal ones older than a time."""
    return staged.where(~(F.col("status").isin(*terminal) & (F.col("updated_at") < before)))
