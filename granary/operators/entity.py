"""Entity resolution and mention mining."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.session import stored


def unseen(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows whose domain isn't in history; those without a domain are looked up by name key."""
    with_domain = rows.where("domain IS NOT NULL").join(history.where("domain IS NOT NULL").select("domain").distinct(), "domain", "left_anti")
    named = rows.where("domain IS NULL").withColumn("_k", X.name_key(F.col("name")))
    return with_domain.unionByName(named.join(history.select(X.name_key(F.col("name")).alias("_k")).distinct(), "_k", "left_anti").drop("_k"))


def same_company(a, b):
    """Equal keys, equal without spaces, or a word overlap of 0.6 either way."""
    ka, kb = X.name_key(a), X.name_key(b)
    wa, wb = X.significant_words(ka), X.significant_words(kb)
    return (ka == kb) | (X.squash(ka) == X.squash(kb)) | (F.greatest(X.overlap_ratio(wa, wb), X.overlap_ratio(wb, wa)) >= 0.6)


def group_mentions(mentions: DataFrame) -> DataFrame:
    """key, name, mention_count, n_sources, snippets, framed: a name counts once per result; the first name and two snippets stay."""
    once = mentions.groupBy("key", "result_id").agg(F.min(F.struct("pos", "name", "url", F.substring("snippet", 1, 300).alias("snippet"))).alias("m"), F.max("framed").alias("framed"))
    return once.groupBy("key").agg(F.min_by("m.name", "m.pos").alias("name"), F.count("*").alias("mention_count"), F.count_distinct("m.url").alias("n_sources"),
                                   F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("m.pos", "m.snippet"))), 1, 2), lambda s: s["snippet"]), " | ").alias("snippets"), F.max("framed").alias("framed"))


def framed_confidence(count, framed):
    """high for two mentions with explicit framing, medium for either, else low."""
    return F.when((count >= 2) & framed, "high").when((count >= 2) | ((count == 1) & framed), "medium").otherwise("low")


def counted_confidence(count):
    return F.when(count >= 2, "high").when(count == 1, "medium").otherwise("low")


def title_confidence(ratio, is_current):
    return F.when((ratio >= 1) & is_current, "high").when(ratio >= 0.5, "medium").otherwise("low")


def leader_clusters(rows: DataFrame) -> DataFrame:
    """pos, leader_pos: rows join the earliest leader of equal domain, else equal name key, else equal squashed key (5 characters or more).

    Leaders keep their own keys. Components of shared keys are found first, as no merge crosses them: rounds go on
    until no label changes, and each is written to the shared folder. Each component is then replayed in order; a task
    holds one batch of rows and the leaders' keys of one component. pos identifies a row.
    """
    tiers = ("domain", "k", "s")
    keyed = rows.select("pos", "domain", X.ascii_name_key(F.col("name")).alias("k")).withColumn("s", F.when(F.length(X.squash(F.col("k"))) >= 5, X.squash(F.col("k"))))
    comp = stored(keyed.withColumn("c", F.col("pos")), "leaders")
    while True:
        new = comp.withColumn("old", F.col("c"))
        for key in tiers:
            low = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("c").alias("m"))
            new = new.join(low, key, "left").withColumn("c", F.least("c", F.coalesce("m", "c"))).drop("m")
        jumps = comp.select(F.col("pos").alias("c"), F.col("c").alias("j"))
        new = new.join(jumps, "c", "left").withColumn("c", F.least("c", F.coalesce("j", "c")))
        new = stored(new.select("pos", *tiers, "c", "old"), "leaders")
        comp = new.drop("old")
        if new.where("c < old").isEmpty():
            break

    def replay(batches):
        last, leaders = None, {}
        for batch in batches:
            found = []
            for c, pos, *keys in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if c != last:
                    last, leaders = c, {}
                own = [(tier, v) for tier, v in zip(tiers, keys) if v is not None]
                leader = next((leaders[x] for x in own if x in leaders), None)
                if leader is None:
                    leader = pos
                    for x in own:
                        leaders.setdefault(x, pos)
                found.append(leader)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, type=pa.int64())], names=["pos", "leader_pos"])

    ordered = comp.select("c", F.col("pos").cast("long").alias("pos"), *tiers).repartition("c").sortWithinPartitions("c", "pos")
    return ordered.mapInArrow(replay, "pos long, leader_pos long")


def aggregate_leads(leads: DataFrame) -> DataFrame:
    """key, name, segments: a lead's best row (confidence rank, then pos) and its segments in order of first sight."""
    first = leads.groupBy("key", "segment").agg(F.min("pos").alias("seen"))
    order = first.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seen", "segment"))), lambda s: s["segment"]), ",").alias("segments"))
    return leads.groupBy("key").agg(F.min_by("name", F.struct("rank", "pos")).alias("name")).join(order, "key")


def ambiguous_tops(rows: DataFrame, key: str) -> DataFrame:
    """key, candidate, confidence of the best candidate; null candidate where two share the best confidence."""
    best = rows.groupBy(key).agg(F.max("confidence").alias("confidence"))
    tied = rows.join(best, [key, "confidence"]).groupBy(key, "confidence").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    return tied.select(key, F.when(F.col("n") == 1, F.col("candidate")).alias("candidate"), "confidence")
