"""Streaming forms of the event operators, with the results of the batch forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))


def rate_limited(stream: DataFrame, limit: int, window_s: int) -> DataFrame:
    """key, event_id, allowed of a stream with key, event_id and t (seconds). A key's state is its window's start and count.

    A trigger's rows of a key are put in order; order across triggers and an end of state need event time: see `ordered`.
    """

    def run(key, batches, state):
        start, n = state.get if state.exists else (-1e18, 0)
        rows = []
        # requests without a time come first and open no window, as in the batch form
        for event_id, t in pd.concat(batches).sort_values(["t", "event_id"], na_position="first")[["event_id", "t"]].itertuples(index=False):
            if t - start >= window_s:
                start, n = t, 0
            allowed = n < limit
            n += allowed
            rows.append((key[0], int(event_id), bool(allowed)))
        yield pd.DataFrame(rows, columns=["key", "event_id", "allowed"])
        state.update((float(start), int(n)))

    return stream.groupBy("key").applyInPandasWithState(run, "key long, event_id long, allowed boolean", "start double, n int", "append", "NoTimeout")
