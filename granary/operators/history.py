"""Versioned history of a keyed table from a feed of inserts, updates and deletes.

Per key, changes count in the order of their time and number, however they arrive. An insert of a key that is there, and
an update or delete of one that isn't, change nothing; an update replaces what it names and leaves its nulls as they
were. Every insert and update that counts begins a version, which ends with the next change.

What a change finds is the last thing said before it. That is worked out inside pieces of a key's time (`span` seconds),
and carried over from piece to piece by one row each, so that a key with a third of all changes is no single task's work.

Defined results: changes without key, time or kind are left out; repeated changes (same key, time and number) count
once, conflicting ones by their least values; an empty feed gives an empty history; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import stored

KINDS = ("insert", "update", "delete")
SPAN, BUCKETS = 86_400, 64


def with_last(rows: DataFrame, key: str, order: list[str], events: dict[str, Column], inclusive: bool) -> DataFrame:
    """rows with, for each name, the last event that isn't null up to a row (before it, unless inclusive). rows has piece."""
    inside = Window.partitionBy(key, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.select("*", *[F.last(e, True).over(inside).alias(f"_in_{n}") for n, e in events.items()])
    ends = rows.groupBy(key, "piece").agg(*[F.max_by(e, F.when(e.isNotNull(), F.struct(*order))).alias(n) for n, e in events.items()])
    earlier = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(key, "piece", *[F.last(n, True).over(earlier).alias(f"_out_{n}") for n in events])
    return own.join(before, [key, "piece"]).select(*rows.columns, *[F.coalesce(f"_in_{n}", f"_out_{n}").alias(n) for n in events])


def versions(changes: DataFrame, values: list[str], span: int = SPAN) -> DataFrame:
    """key, the values, valid_from, valid_to (null while current), is_current. changes has key, at (timestamp), seq, op and the values."""
    given = changes.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("op").isin(*KINDS))
    once = given.groupBy("key", "at", "seq").agg(F.min(F.struct("op", *values)).alias("c")).select("key", "at", "seq", "c.*")
    rows = once.withColumn("piece", F.floor(F.unix_timestamp("at") / span))
    order, op = ["at", "seq"], F.col("op")
    told = with_last(rows, "key", order, {"state": F.when(op != "update", op)}, False)
    there = F.coalesce(F.col("state") == "insert", F.lit(False))
    counting = told.where(F.when(op == "insert", ~there).otherwise(there)).drop("state")
    # an insert says all values, also those that are null
    said = {f"new_{v}": F.when((op == "insert") | ((op == "update") & F.col(v).isNotNull()), F.struct(F.col(v).alias("v"))) for v in values}
    full = with_last(counting, "key", order, said, True)
    inside = Window.partitionBy("key", "piece").orderBy(*order)
    later = full.groupBy("key", "piece").agg(F.min("at").alias("first")).withColumn("after", F.lead("first").over(Window.partitionBy("key").orderBy("piece"))).drop("first")
    ended = full.withColumn("next", F.lead("at").over(inside)).join(later, ["key", "piece"]).withColumn("valid_to", F.coalesce("next", "after"))
    return ended.where(op != "delete").select("key", *[F.col(f"new_{v}.v").alias(v) for v in values], F.col("at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path).select(like.columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return like.limit(0)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, values: list[str], buckets: int = BUCKETS, span: int = SPAN) -> None:
    """Adds changes to the log under a path and renews the history beside it, in the buckets of keys that they touch.

    Changes are known by key, time and number, so a slice that comes again, or late, leaves what it would have left in
    its place. Buckets are overwritten as a whole when all are written: a failed run leaves the old ones, and its
    repetition the same new ones.
    """
    columns = ["key", "at", "seq", "op", *values]
    of = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    new = changes.where("key IS NOT NULL AND at IS NOT NULL").select(*columns, of.alias("bucket"))
    touched = new.select("bucket").distinct()
    old = _read(spark, f"{path}/log", new).join(F.broadcast(touched), "bucket", "left_semi").select(new.columns)  # at most `buckets` rows
    log = stored(old.unionByName(new).dropDuplicates(["key", "at", "seq", "op", *values]), "change-log")
    renewed = stored(versions(log, values, span).withColumn("bucket", of), "history")
    for name, rows in (("log", log), ("history", renewed)):
        rows.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """The versions under a path."""
    return spark.read.parquet(f"{path}/history").drop("bucket")


def cache_hits(requests: DataFrame, cache: DataFrame, hours: int) -> DataFrame:
    """requests (id, url, now) with value and is_hit: what the cache (url, at, value) holds and isn't older than so many hours.

    An entry of just that age still counts; of entries with one url the latest does; requests beyond are to be served live.
    """
    latest = cache.where("url IS NOT NULL AND at IS NOT NULL").groupBy("url").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    fresh = F.coalesce(F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("at").cast("timestamp")) <= hours * 3_600_000, F.lit(False))
    return requests.join(latest, "url", "left").select("id", "url", F.when(fresh, F.col("value")).alias("value"), fresh.alias("is_hit"))
