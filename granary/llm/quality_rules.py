"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule is one row of `RULES`: it rejects a document when `100 * numerator > percent * denominator` (or, for
at_least rules, when it is below). The metrics and the verdict are columns of a single `select`, so a table of any
size is judged in one scan without a shuffle, without Python on the executors and without moving text.

Defined results: null and empty texts have no words and fail the base rule; lines count as repeated when their whole
text equals an earlier line; extra columns are ignored by `judge` and kept by `keep_good`; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table, words_of

SYMBOLS = "[#*$%&|<>]+"

#: Very frequent words of the four languages, as a text quality signal.
STOP_WORDS = (
    "the of and to in is that it for on with as be by this was are at or an a from "
    "der die das und ist ein eine mit auf den von zu im für nicht des dem "
    "le la les et de un une des que est pour dans en du au ce pas sur il "
    "el los las y un una que es por con para del se lo al no su"
).split()
#: As they stand in a text: lower case, capitalised, or in capitals.
STOP_FORMS = tuple(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())))


@dataclass(frozen=True)
class Rule:
    """Rejects where 100 * numerator is over (or, with at_least, under) percent * denominator."""

    name: str
    numerator: str
    denominator: str
    percent: int
    at_least: bool = False


RULES = (
    Rule("short_words", "word_chars", "n_words", 200, at_least=True),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("many_symbols", "n_symbols", "n_words", 25),
    Rule("few_stop_words", "n_stop_words", "n_words", 4, at_least=True),
    Rule("shouting", "n_shouts", "n_words", 25),
    Rule("capitals", "n_upper", "word_chars", 50),
    Rule("few_letters", "n_letters", "word_chars", 60, at_least=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 40),
    Rule("dotted_lines", "n_ellipsis_lines", "n_lines", 40),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _count(text: Column, pattern: str) -> Column:
    """Characters of a text in runs that match the pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of three words, in order."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeated_hashes(hashes: Column) -> Column:
    """The distinct hashes that an ascending array holds more than once."""
    return F.array_distinct(F.filter(hashes, lambda h, j: (j > 0) & (F.get(hashes, j - 1) == h)))


def repeated_words(hashes: Column, twice: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text (windows count as equal by their hashes).

    Texts without such windows stop at once; with a few, their places are looked up; with many, they are sorted out.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def named(x: Column, then) -> Column:
        """A local name for an array that is used several times."""
        return total(F.transform(F.array(x), then))

    def covered(starts: Column) -> Column:
        return named(starts, lambda s: total(F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3))))))

    def sorted_out(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, j: F.get(ordered, j + 1)["h"].eqNullSafe(x["h"]) | F.get(ordered, j - 1)["h"].eqNullSafe(x["h"]))
        return covered(F.sort_array(F.transform(same, lambda x: x["i"])))

    looked_up = F.array_compact(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)))
    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 16, covered(looked_up)).otherwise(named(places, sorted_out))


def metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` with the counts that the rules read, as longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, words_of(text).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    base = base.select("*", F.array_join("_words", "").alias("_bare"), window_hashes(F.col("_words")).alias("_windows"))
    base = base.select("*", F.sort_array("_windows").alias("_sorted")).select("*", repeated_hashes(F.col("_sorted")).alias("_twice"))
    words, bare, lines = F.col("_words"), F.col("_bare"), F.col("_lines")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(bare),
        "n_symbols": _count(bare, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(F.col("_windows"), F.col("_twice")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))),
        "n_shouts": _count(bare, "[!?]+"),
        "n_upper": _count(bare, "[A-Z]+"),
        "n_letters": F.length(F.regexp_replace(bare, r"\P{L}+", "")),
        "n_lines": F.size(lines),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    return base.select(*keep, *[c.cast("long").alias(k) for k, c in counts.items()])


def failed(rule: Rule) -> Column:
    left, right = F.col(rule.numerator) * 100, F.col(rule.denominator) * rule.percent
    return left < right if rule.at_least else left > right


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Per document: its counts, base_failed, the first rule it fails (null if none) and kept."""
    counted = metrics(docs, keep or ["doc_id"])
    reason = F.coalesce(*[F.when(failed(r), F.lit(r.name)) for r in rules])
    return counted.withColumn("base_failed", base_failed()).withColumn("failed_rule", reason).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns; names of the counts may clash with theirs."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("text"))
    # the place isn't deterministic, so that the filter stays above the projections and nothing is worked out twice
    judged = judge(packed, rules, keep=["_row"]).select("_row", "kept", F.monotonically_increasing_id().alias("_place"))
    return judged.filter(F.col("kept") & (F.col("_place") >= 0)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    bad = " OR ".join(f"100 * {r.numerator} {'<' if r.at_least else '>'} {r.percent} * {r.denominator}" for r in RULES)
    cls = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{cls}+') AS ws,
        regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g') AS bare,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{cls}')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
        (length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
        (length(bare) - length(regexp_replace(bare, '[!?]', '', 'g')))::BIGINT AS n_shouts,
        (length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        (length(bare) - length(regexp_replace(bare, '\\pL+', '', 'g')))::BIGINT AS n_letters,
        len(ls)::BIGINT AS n_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov ON w.doc_id IS NOT DISTINCT FROM cov.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({bad}) AS kept
FROM v"""
