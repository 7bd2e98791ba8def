"""Moves of contacts through a campaign, and enrichment that comes in time, late or too late.

The states are few, so what a stretch of events does is a table from state to state. Each key's time is cut into pieces
of `span` seconds; a first pass works out every piece's table, a second one joins the tables piece by piece (a row each)
to the state that a piece begins with, and a third goes through the events. So no key's events are one task's work, and
a task holds one batch of rows and one table.

Defined results: events without key or time are left out; unknown kinds are rejected and change nothing; repeated events
are judged one after the other, in the order of time and number; an empty table gives an empty one; extra columns go.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a contact, and the moves that each kind of event allows.
STATES = ("queued", "sent", "followup_1", "followup_2", "followup_3", "replied", "bounced", "stopped")
WRITTEN = ("sent", "followup_1", "followup_2", "followup_3")
MOVES = {
    "sent": {"queued": "sent"},
    "followup": {"sent": "followup_1", "followup_1": "followup_2", "followup_2": "followup_3"},
    "replied": {s: "replied" for s in WRITTEN},
    "bounced": {s: "bounced" for s in WRITTEN},
    "stopped": {s: "stopped" for s in ("queued", *WRITTEN)},
}
SPAN = 86_400
# Milliseconds within which enrichment reaches the prompt, and those within which it is used at all.
SOFT_MS, HARD_MS = 8_000, 70_000


def moved(state: str, kind: str | None) -> tuple[str, bool]:
    """The state after an event, and whether it is allowed."""
    to = MOVES.get(kind, {}).get(state)
    return (to, True) if to is not None else (state, False)


_TABLES = {kind: [STATES.index(moved(s, kind)[0]) for s in STATES] for kind in MOVES}


def transitions(events: DataFrame, span: int = SPAN) -> DataFrame:
    """key, seq, kind, before, state, accepted of every event. events has key, at (timestamp), seq (long), kind."""
    key_kind = dict(events.dtypes)["key"]
    rows = events.where("key IS NOT NULL AND at IS NOT NULL").select("key", F.floor(F.unix_timestamp("at") / span).alias("piece"), "at", "seq", "kind")
    own = lambda df: df.repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "seq")

    def tables(batches):
        last, table = None, []
        for batch in batches:
            out = []
            for key, piece, kind in zip(*[batch.column(k).to_pylist() for k in (0, 1, 4)]):
                if (key, piece) != last:
                    if last is not None:
                        out.append((*last, table))
                    last, table = (key, piece), list(range(len(STATES)))
                if kind in _TABLES:
                    table = [_TABLES[kind][s] for s in table]
            yield _batch(out, batch, ("key", "piece", "to"))
        if last is not None:
            yield _batch([(*last, table)], batch, ("key", "piece", "to"))

    def starts(batches):
        last, state = None, 0
        for batch in batches:
            out = []
            for key, piece, to in zip(*[c.to_pylist() for c in batch.columns]):
                last, state = key, 0 if key != last else state
                out.append((key, piece, state))
                state = to[state]
            yield _batch(out, batch, ("key", "piece", "start"))

    def steps(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for key, piece, seq, kind, start in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]):
                if (key, piece) != last:
                    last, state = (key, piece), STATES[start]
                before = state
                state, accepted = moved(state, kind)
                out.append((key, seq, kind, before, state, accepted))
            yield _batch(out, batch, ("key", "seq", "kind", "before", "state", "accepted"))

    pieces = own(rows).mapInArrow(tables, f"key {key_kind}, piece long, to array<int>")
    begun = pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(starts, f"key {key_kind}, piece long, start int")
    return own(rows.join(begun, ["key", "piece"]).select("key", "piece", "at", "seq", "kind", "start")).mapInArrow(steps, f"key {key_kind}, seq long, kind string, before string, state string, accepted boolean")


_TYPES = {"piece": pa.int64(), "to": pa.list_(pa.int32()), "start": pa.int32(), "seq": pa.int64(), "kind": pa.string(), "before": pa.string(), "state": pa.string(), "accepted": pa.bool_()}


def _batch(rows: list[tuple], like: pa.RecordBatch, names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=like.column(0).type if n == "key" else _TYPES[n]) for n, c in zip(names, columns)], names=list(names))


def arrival(waited_ms: Column, soft: int = SOFT_MS, hard: int = HARD_MS) -> Column:
    return F.when(waited_ms <= soft, "prompt").when(waited_ms <= hard, "late").otherwise("dropped")


def arrivals(events: DataFrame, soft: int = SOFT_MS, hard: int = HARD_MS) -> DataFrame:
    """key, seq, waited_ms, arrived (prompt, late, dropped) of every result, by the first start of its key.

    events has key, at (timestamp), seq, kind (start or result). Results without a start, or before it, are dropped.
    """
    known = events.where("key IS NOT NULL AND at IS NOT NULL").withColumn("at", F.col("at").cast("timestamp"))
    begun = known.where("kind = 'start'").groupBy("key").agg(F.min("at").alias("start"))
    waited = F.unix_millis("at") - F.unix_millis("start")
    joined = known.where("kind = 'result'").join(begun, "key", "left").withColumn("waited_ms", F.when(F.col("at") >= F.col("start"), waited))
    return joined.select("key", "seq", "waited_ms", arrival(F.col("waited_ms"), soft, hard).alias("arrived"))


def enriched(arrived: DataFrame) -> DataFrame:
    """key, n_prompt, n_late, prompt_enriched, reextract: prompt results reach the prompt, late ones only what is extracted again."""
    n = arrived.groupBy("key").agg(F.count_if(F.col("arrived") == "prompt").alias("n_prompt"), F.count_if(F.col("arrived") == "late").alias("n_late"))
    return n.select("key", "n_prompt", "n_late", (F.col("n_prompt") > 0).alias("prompt_enriched"), (F.col("n_late") > 0).alias("reextract"))
