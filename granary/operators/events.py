"""Event-state operators in batch form; `now` is always a parameter."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X

# Days after which a follow-up is due, by the status reached.
INTERVALS = (("sent", 3), ("followup_1", 4), ("followup_2", 7))


def due_at(status: Column, last: Column, intervals=INTERVALS) -> Column:
    out = F.lit(None).cast("timestamp")
    for name, days in intervals:
        out = F.when(status == name, last + F.expr(f"INTERVAL {days} DAYS")).otherwise(out)
    return out


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; ties are broken by the given columns."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rate_limited(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """key, event_id, allowed, retry_s: a window opens with the first request after the last one's end.

    The fold runs over a key's requests in order; denied ones don't count. Keys are dealt over tasks and sorted with
    spill; a task holds one batch of rows and the state of one key, however many requests the key has.
    """
    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    rows = requests.select("key", F.col("ts").cast("double").alias("t"), "event_id")

    def run(batches):
        last, start, n = None, -1e18, 0
        for batch in batches:
            allowed, retry = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (k,) != last:
                    last, start, n = (k,), -1e18, 0
                gap = None if t is None else t - start
                fresh = gap is not None and gap >= window_s
                denied = not fresh and n >= limit
                if fresh:
                    start, n = t, 1
                elif not denied:
                    n += 1
                allowed.append(not denied)
                retry.append(math.ceil(start + window_s - t) if denied and t is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, type=pa.bool_()), pa.array(retry, type=pa.int64())], names=["key", "event_id", "allowed", "retry_s"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "t", "event_id")
    return ordered.mapInArrow(run, f"key {kind['key']}, event_id {kind['event_id']}, allowed boolean, retry_s long")


def streaks(rows: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """The number of hits in a row up to each row; a miss sets it to 0."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = rows.withColumn("_hit", hit.cast("int")).withColumn("_island", F.sum(1 - F.col("_hit")).over(w))
    own = Window.partitionBy(key, "_island").orderBy(*order)
    return islands.withColumn("streak", F.sum("_hit").over(own)).drop("_hit", "_island")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with changes written over it: the row with the greatest `order` of each key, changes first on ties."""
    both = base.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    return latest(both, key, [order, "_rank"]).drop("_rank")


def insert_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return base.unionByName(rows.join(base.select(key), key, "left_anti"))


def cooled_down(requests: DataFrame, seconds: int) -> DataFrame:
    """key, event_id, tried: a request isn't tried within so many seconds after a tried one that was limited.

    requests has key, ts, event_id and limited. As in rate_limited a task holds one batch and the state of one key.
    """
    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def run(batches):
        last, until = None, -1e18
        for batch in batches:
            tried = []
            for k, t, limited in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if (k,) != last:
                    last, until = (k,), -1e18
                ok = t is None or t >= until
                if ok and limited and t is not None:
                    until = t + seconds
                tried.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tried, type=pa.bool_())], names=["key", "event_id", "tried"])

    rows = requests.select("key", F.col("ts").cast("double").alias("t"), "event_id", "limited")
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInArrow(run, f"key {kind['key']}, event_id {kind['event_id']}, tried boolean")


# The follow-up that comes after each status.
NEXT_FOLLOWUP = (("sent", 1), ("followup_1", 2), ("followup_2", 3))


def next_followup(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, number in NEXT_FOLLOWUP:
        out = F.when(status == name, number).otherwise(out)
    return out


def followup_outcome(status: Column, last: Column, now: Column, replied: Column, bounced: Column, email: Column, draft: Column, suppressed: Column, forced: Column) -> Column:
    """What happens to a follow-up; the order of the tests is the meaning."""
    due = F.coalesce(due_at(status, last) <= now, F.lit(False))
    return (F.when(next_followup(status).isNull(), "skipped").when(~forced & ~due, "not_due").when(replied & bounced, "cancelled_bounce").when(replied, "cancelled_reply")
            .when(email.isNull() | (email == ""), "no_email").when(draft.isNull() | (draft == ""), "no_draft").when(suppressed, "suppressed").otherwise("sent"))


def updated(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the values of changes (unique by key) in the columns that both have; other rows stay."""
    shared = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in shared], F.lit(True).alias("_hit"))
    joined = base.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns])


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti").select(base.columns)


def snapshots(base: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """base with new rows appended and `pos`, the place of each in its key's order of time."""
    return base.unionByName(new).withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def last_reply(messages: DataFrame, key: str) -> DataFrame:
    """key, message_id, sender, is_bounce: the last message of a thread that isn't from the connected address.

    messages has key, place, message_id, sender, subject and connected (the own address, in any case). Messages without a
    sender don't count; threads without a reply have no row.
    """
    other = messages.where(F.col("sender").isNotNull() & ~F.contains(F.lower("sender"), F.lower("connected")))
    last = other.groupBy(key).agg(F.max_by(F.struct("message_id", "sender", "subject"), F.struct("place", "message_id")).alias("m"))
    return last.select(key, "m.message_id", "m.sender", F.coalesce(X.is_bounce(F.col("m.sender"), F.col("m.subject")), F.lit(False)).alias("is_bounce"))
