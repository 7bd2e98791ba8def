"""State machines, late arrivals and the rate limiter as streams, in event order and with state that ends.

A key's rows wait until the watermark has passed them and are then folded in the order of time and number, so that the
result doesn't depend on how triggers cut the stream. Rows that come behind the watermark can't be put in order any more
and are told apart as such. A key's state is what its fold keeps, plus the rows of the watermark's delay; an event-time
timer removes it when nothing has come for `idle`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import states

STATE = "fold string, waiting string, last long"


def in_order(stream: DataFrame, fold: Callable, late: Callable, columns: list[str], schema: str, delay: str, idle_ms: int) -> DataFrame:
    """A fold over each key's rows (ms, seq, *columns) in event order; stream has key, at, seq and the columns.

    fold takes the state so far (None at first) and one row, and returns the new state and one row of output without the
    key; late makes the output of a row behind the watermark. States and rows are kept as JSON. Rows that a fold has no
    use for should come too, as filters are pushed below the watermark, which then waits for what is left.
    """
    names = [f.split(" ")[0] for f in schema.split(", ")]
    given = stream.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).where("key IS NOT NULL AND at IS NOT NULL").select("key", "at", F.unix_millis("at").alias("ms"), "seq", *columns)

    def run(key, batches, state):
        kept, waiting, last = state.get if state.exists else ("null", "[]", 0)
        kept, waiting, out = json.loads(kept), json.loads(waiting), []
        passed = state.getCurrentWatermarkMs()
        for pdf in () if state.hasTimedOut else batches:
            for row in pdf[["ms", "seq", *columns]].astype(object).where(pdf[["ms", "seq", *columns]].notna(), None).values.tolist():
                row[:2] = int(row[0]), int(row[1])
                if row[0] <= passed:
                    out.append((key[0], *late(row)))
                else:
                    waiting.append(row)
        waiting.sort(key=lambda r: (r[0], r[1]))
        while waiting and waiting[0][0] <= passed:
            row = waiting.pop(0)
            kept, told = fold(kept, row)
            last = row[0]
            out.append((key[0], *told))
        if not waiting and last + idle_ms <= passed:
            state.remove()
        else:
            state.update((json.dumps(kept), json.dumps(waiting), last))
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else last + idle_ms, passed) + 1)
        yield pd.DataFrame(out, columns=names)

    return given.groupBy("key").applyInPandasWithState(run, schema, STATE, "append", "EventTimeTimeout")


def transitions(stream: DataFrame, delay: str = "10 minutes", idle_ms: int = 60 * 86_400_000) -> DataFrame:
    """As operators.states.transitions; events behind the watermark are rejected with a null state. Contacts idle for idle_ms begin anew."""

    def fold(state, row):
        before = state or states.STATES[0]
        after, accepted = states.moved(before, row[2])
        return after, (row[1], row[2], before, after, accepted)

    kind = dict(stream.dtypes)["key"]
    return in_order(stream, fold, lambda row: (row[1], row[2], None, None, False), ["kind"], f"key {kind}, seq long, kind string, before string, state string, accepted boolean", delay, idle_ms)


def arrivals(stream: DataFrame, soft: int = states.SOFT_MS, hard: int = states.HARD_MS, delay: str = "10 seconds") -> DataFrame:
    """As operators.states.arrivals, one row per result; what comes behind the watermark is dropped, and so is a key's state at the hard limit.

    Late results are their own output: `prompt_and_late` splits the stream.
    """

    def fold(start, row):
        if row[2] != "result":
            return (row[0] if start is None and row[2] == "start" else start), (row[1], None, None)
        waited = None if start is None else row[0] - start
        return start, (row[1], waited, "prompt" if waited is not None and waited <= soft else "late" if waited is not None and waited <= hard else "dropped")

    kind = dict(stream.dtypes)["key"]
    told = in_order(stream, fold, lambda row: (row[1], None, "dropped" if row[2] == "result" else None), ["kind"], f"key {kind}, seq long, waited_ms long, arrived string", delay, hard)
    return told.where("arrived IS NOT NULL")


def prompt_and_late(arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What reaches the prompt, and what only feeds another extraction."""
    return arrived.where("arrived = 'prompt'"), arrived.where("arrived = 'late'")


def rate_limited(stream: DataFrame, limit: int, window_s: int, delay: str = "10 minutes") -> DataFrame:
    """key, seq, allowed as operators.events.rate_limited decides; requests behind the watermark are denied. A window's state ends with it."""

    def fold(state, row):
        start, n = state or (None, 0)
        if start is None or row[0] - start >= window_s * 1000:
            start, n = row[0], 0
        allowed = n < limit
        return (start, n + allowed), (row[1], allowed)

    kind = dict(stream.dtypes)["key"]
    return in_order(stream, fold, lambda row: (row[1], False), [], f"key {kind}, seq long, allowed boolean", delay, window_s * 1000)
