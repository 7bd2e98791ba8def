"""Rule-based evidence: segments, matches with their places, signals, factors and validation.

Rules are data: (signal, pattern) pairs whose order counts. Only the extraction of places runs in Python, as an Arrow
function over batches; whatever follows is grouping.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AROUND, LONGEST, CAP = 90, 250, 3
MATCH = "array<struct<seq:int,signal:string,rule:int,pos:int,match:string,quote:string>>"


def segments(blobs: DataFrame, key: str) -> DataFrame:
    """key, seg_no, path, url, text of a blob's `--- PAGE: path (url) ---` blocks; without a marker all is the homepage."""
    marked = F.split(F.regexp_replace("content", r"--- PAGE: (\S+) \(([^)]*)\) ---", "\u0001$1\u0002$2\u0002"), "\u0001")
    parts = blobs.select(key, F.posexplode_outer(F.filter(marked, lambda x: F.trim(x) != "")).alias("seg_no", "s"))
    fields = F.split("s", "\u0002")
    has = F.size(fields) >= 3
    return parts.select(key, "seg_no", F.when(has, F.element_at(fields, 1)).otherwise("/").alias("path"), F.when(has, F.try_element_at(fields, F.lit(2))).alias("url"), F.trim(F.when(has, F.try_element_at(fields, F.lit(3))).otherwise(F.col("s"))).alias("text"))


def matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All matches of every rule in order, with the text around them on one line; at most CAP of a signal, but one per rule."""

    @F.pandas_udf(MATCH)
    def find(values: pd.Series) -> pd.Series:
        compiled = [(signal, regex.compile(p, regex.I | regex.A)) for signal, p in rules]

        def one(t):
            out, count = [], {}
            for number, (signal, pattern) in enumerate(compiled):
                for m in pattern.finditer(t or ""):
                    quote = " ".join(t[max(0, m.start() - AROUND) : m.end() + AROUND].split())[:LONGEST]
                    out.append((len(out), signal, number, m.start(), m.group(), quote))
                    count[signal] = count.get(signal, 0) + 1
                    if count[signal] >= CAP:
                        break
            return out

        return values.map(one)

    return find(text)


def extract(rows: DataFrame, keys: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """keys, seq, signal, rule, pos, match, quote."""
    return rows.select(*keys, F.explode_outer(matches(F.col("text"), rules)).alias("m")).where("m IS NOT NULL").select(*keys, "m.*")


def keep_first_quotes(evidence: DataFrame, key: str) -> DataFrame:
    """One item per signal and first 60 characters of the quote."""
    w = Window.partitionBy(key, "signal", F.substring("quote", 1, 60)).orderBy("seq")
    return evidence.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def signals(evidence: DataFrame, key: str) -> DataFrame:
    """Per signal: number of items, best tier, its strength, validated (two items or a first-tier one), best quote."""
    return evidence.groupBy(key, "signal").agg(F.count("*").alias("n"), F.min("tier").alias("best_tier"), F.min_by("quote", F.struct("tier", "seq")).alias("quote")).select(
        key, "signal", "n", "best_tier", F.when(F.col("best_tier") == 1, "strong").when(F.col("best_tier") == 2, "medium").otherwise("weak").alias("strength"), ((F.col("n") >= 2) | (F.col("best_tier") == 1)).alias("validated"), "quote")


def factors(signal_rows: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """key, factor, n_signals: mapping has signal and factor."""
    return signal_rows.join(F.broadcast(mapping), "signal").groupBy(key, "factor").agg(F.count_distinct("signal").alias("n_signals"))


def validation_score(n_source_types: Column) -> Column:
    return F.when(n_source_types >= 4, 90).when(n_source_types == 3, 75).when(n_source_types == 2, 55).when(n_source_types == 1, 30).otherwise(0)


def worst(status: Column) -> Column:
    """The worst of grouped statuses: FAIL, PARTIAL, WARN, PASS."""
    rank = F.when(status == "FAIL", 3).when(status == "PARTIAL", 2).when(status == "WARN", 1).otherwise(0)
    return F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("PARTIAL"), F.lit("FAIL")), F.max(rank) + 1)


def forbidden_terms(text: Column, terms: list[str]) -> Column:
    """Those terms, in their order, that the text holds in any case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x.lower())), x) for x in terms]))
