"""Benchmark decontamination by template canonicalisation.

Texts are lower-cased into tokens in which numbers, units and names become typed placeholders (<num>, <unit>, <name>).
Windows of `WINDOW` placeholder tokens are hash-joined with the windows of the benchmark. For a hit, the words behind
the placeholders are compared slot by slot: the same benchmark word must always stand for the same document word, and
the other way round, first inside the window and then over all windows that the document shares with the item: of the
document words that stand for a benchmark word the one in most windows counts (ties: the one that comes first), and the
other way round, and windows with any other pair don't count. A consistent hit is `verbatim` when all slots are equal,
`reparameterised` otherwise, so that a question with other numbers or names is caught too. A document is contaminated by
an item if

- it has a share of the item's windows (`MIN_SHARE` percent, one window at least), or
- it holds any `RUN` consecutive tokens of the item word for word, however long the item is, or
- the item has fewer than WINDOW tokens and the document holds them all in a row, word for word. Items of fewer than
  `LEAST` tokens are too common as passages: they only match documents that say nothing else.

Everything is DataFrame functions. Canonical tokens are made by regular expressions over whole texts, window hashes by
pairings of an array with itself (1, 2 and up to 4 tokens apart), and only the windows' hashes meet the benchmark's. That
side is broadcast when the benchmark's texts stay below `BROADCAST_CHARS` characters; beyond, the join is a shuffle.

Defined results: null and empty texts have no windows and are clean, as are items without a token; repeated items are
one; rows without a doc_id and rows that share one are judged each by itself; of items that a document holds equally much of, the one with the smallest id is named;
empty tables give clean or empty results; extra columns are kept by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import KEY, stored, table, with_key

WINDOW, LEAST, RUN = 8, 4, 13
MIN_SHARE = 30
BROADCAST_CHARS = 4_000_000
UNITS = "km|m|cm|mm|mi|miles?|kg|g|mg|lbs?|pounds?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|%|km/h|mph|litres?|liters?|ml|l|°c|°f"


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits; separators inside numbers go, and units are split from their numbers."""
    plain = F.coalesce(text, F.lit(""))
    spaced = F.regexp_replace(F.regexp_replace(plain, r"(?<=[0-9])[.,](?=[0-9])", ""), r"(?<=[0-9])(?=[\p{L}%°])", " ")
    return F.array_remove(F.split(F.when(plain.rlike("[0-9]"), spaced).otherwise(plain), r"[^\p{L}\p{N}%°]+"), "")


def is_number(token: Column) -> Column:
    """Whether a token begins with a digit, by comparison alone."""
    return (token >= "0") & (token < ":")


def placeholder(token: Column, before: Column) -> Column:
    """A token's canonical form. Names are capitalised words that follow a lower-case word, so that sentence starts and titles aren't."""
    return (F.when(is_number(token), F.lit("<num>"))
            .when(is_number(before) & token.rlike(rf"^(?i:{UNITS})$"), F.lit("<unit>"))
            .when(token.rlike(r"^\p{Lu}\p{Ll}+$") & before.rlike(r"^\p{Ll}"), F.lit("<name>"))
            .otherwise(F.lower(token)))


def paired(hashes: str, gap: int) -> Column:
    """The array with each element hashed together with the one so many places on."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - gap, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + gap)))


def forms(rows: DataFrame, key: str) -> DataFrame:
    """key, raw (the tokens as they stand) and h4 (hashes of the canonical form of every four tokens, by place)."""
    plain = rows.select(key, tokens_of(F.col("text")).alias("raw"))
    # most tokens are themselves: only capitals, numbers and what follows a number go through the rules
    before = lambda i: F.coalesce(F.get("raw", i - 1), F.lit(""))
    form = F.transform("raw", lambda t, i: F.when((t != F.lower(t)) | is_number(t) | is_number(before(i)), placeholder(t, before(i))).otherwise(t))
    step = plain.select(key, "raw", F.transform(form, lambda t: F.xxhash64(t)).alias("h"))
    for gap in (1, 2):
        step = step.select(key, "raw", paired("h", gap).alias("h"))
    return step.withColumnRenamed("h", "h4")


def places_of(canon: DataFrame, key: str, size: int, column: str = "h4") -> DataFrame:
    """key, size, place, hash of every window of so many tokens (LEAST or more)."""
    hashes = canon.select(key, (paired(column, size - LEAST) if size > LEAST else F.col(column)).alias("hashes"))
    # (outer: a plain explode would have its input repeated in a filter that is pushed into the lambdas above)
    return hashes.select(key, F.lit(size).alias("size"), F.posexplode_outer("hashes").alias("place", "hash"))


def whole_of(canon: DataFrame, key: str) -> DataFrame:
    """key, size, place, hash of texts of fewer than LEAST tokens; the size is negative, as only whole texts count."""
    few = canon.where(F.size("raw").between(1, LEAST - 1))
    return few.select(key, (-F.size("raw")).alias("size"), F.lit(0).alias("place"), F.xxhash64(F.lower(F.array_join("raw", " "))).alias("hash"))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.lower(x))


def consistent(a: Column, b: Column) -> Column:
    """Whether the same token on one side always meets the same token on the other, in both directions; both in lower case."""
    pairs = F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b")))
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs))


def agreeing(met: DataFrame, key: str) -> DataFrame:
    """The rows of met (key, item_id, iplace, at, itoks, dtoks, same) whose pairs of tokens all agree with those in most windows.

    Only where some window isn't verbatim there is anything to settle; all other rows stay as they are.
    """
    pair = [key, "item_id"]
    changed = met.where(~F.col("same")).select(*pair).distinct()
    window = [*pair, "iplace", "at", "dtoks"]
    slots = met.join(changed, pair, "left_semi").select(*window, F.explode(F.array_distinct(F.arrays_zip(F.col("itoks").alias("i"), F.col("dtoks").alias("d")))).alias("p")).select(*window, "p.i", "p.d")
    counted = slots.groupBy(*pair, "i", "d").agg(F.struct(-F.count_distinct("iplace"), F.min("at"), F.min("iplace")).alias("order"))
    word = counted.groupBy(*pair, "i").agg(F.min_by("d", F.struct("order", "d")).alias("word"))
    slot = counted.groupBy(*pair, "d").agg(F.min_by("i", F.struct("order", "i")).alias("slot"))
    bound = counted.join(word, [*pair, "i"]).join(slot, [*pair, "d"]).where((F.col("d") == F.col("word")) & (F.col("i") == F.col("slot"))).select(*pair, "i", "d", F.lit(True).alias("bound"))
    split = slots.join(bound, [*pair, "i", "d"], "left").groupBy(*window).agg(F.count("bound").alias("agree"), F.count("*").alias("all")).where("agree < all").select(*window)
    return met.join(split, window, "left_anti")


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_chars: int = BROADCAST_CHARS, key: str = "doc_id") -> DataFrame:
    """key, item_id, n_windows (matched places of the item), n_verbatim of them, item_windows, n_runs (verbatim runs of RUN tokens).

    Rows that share an item_id are one item; key identifies a document. item_windows is 1 for items shorter than a window,
    and n_windows then 1 if the document holds them word for word.
    """
    given = benchmark.select("item_id", "text")
    few = (given.agg(F.sum(F.length("text"))).first()[0] or 0) <= broadcast_chars
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    items = stored(forms(given, "item_id").withColumn("n", F.size("raw")).withColumn("_item", F.monotonically_increasing_id()), "items")
    sizes = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect() if r.n)
    short, tiny = [n for n in sizes if n >= LEAST], any(n < LEAST for n in sizes)

    def windows(canon: DataFrame, key: str, own: bool) -> DataFrame:
        """The windows of the benchmark's sizes; an item's own ones are of WINDOW tokens, or else of all it has."""
        found = places_of(canon, key, WINDOW)
        for n in short:
            found = found.unionByName(places_of(canon.where(F.col("n") == n) if own else canon, key, n))
        return (found.unionByName(whole_of(canon, key)) if tiny else found).where("hash IS NOT NULL")

    words = lambda place, n: lowered(F.slice("raw", place + 1, n))
    item_windows = stored(windows(items, "_item", True).join(items.select("_item", "item_id", "raw"), "_item").select("item_id", "size", "hash", F.col("place").alias("iplace"), words(F.col("place"), F.abs("size")).alias("itoks")).distinct(), "item-windows")
    totals = item_windows.groupBy("item_id").agg(F.count_distinct("iplace").alias("item_windows"))
    item_runs = items.where(F.col("n") >= RUN).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - RUN), lambda i: words(i, F.lit(RUN)))).alias("run")).distinct()
    texts = docs.select(key, "text")
    # hashes meet the benchmark alone; the words of the few places that match are fetched in a second pass
    wanted = item_windows.select("size", "hash").distinct()
    matched = windows(forms(texts, key), key, False).join(small(wanted), ["size", "hash"], "left_semi").groupBy(key).agg(F.collect_set(F.struct("size", "place", "hash")).alias("at"))
    own = texts.join(matched, key).select(key, "at", tokens_of(F.col("text")).alias("raw"))
    found = own.select(key, F.explode(F.transform("at", lambda x: F.struct(x["size"].alias("size"), x["hash"].alias("hash"), x["place"].alias("at"), words(x["place"], F.abs(x["size"])).alias("dtoks"), words(x["place"], F.lit(RUN)).alias("run")))).alias("x")).select(key, "x.*")
    found = stored(found, "found-windows")
    same = F.col("dtoks") == F.col("itoks")
    fits = F.when(F.col("size") == WINDOW, consistent(F.col("dtoks"), F.col("itoks"))).otherwise(same)
    once = found.groupBy(key, "size", "hash", "dtoks").agg(F.min("at").alias("at"))
    met = once.join(small(item_windows), ["size", "hash"]).where(fits).select(key, "item_id", "iplace", "at", "itoks", "dtoks", same.alias("same"))
    per_place = agreeing(met, key).groupBy(key, "item_id", "iplace").agg(F.max(F.col("same").cast("int")).alias("v"))
    counted = per_place.groupBy(key, "item_id").agg(F.count("*").alias("n_windows"), F.sum("v").alias("n_verbatim"))
    runs = found.where(F.size("run") == RUN).select(key, "run").distinct().join(small(item_runs), "run").groupBy(key, "item_id").agg(F.count("*").alias("n_runs"))
    return counted.join(small(totals), "item_id").join(runs, [key, "item_id"], "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))


def contaminated(keyed: DataFrame, benchmark: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """KEY, n_items, best_item, best_share (percent of its windows), verbatim of contaminated rows."""
    share = F.col("n_windows") * 100 / F.col("item_windows")
    bad = hits(keyed, benchmark, key=KEY).where((F.col("n_windows") * 100 >= F.col("item_windows") * min_share) | (F.col("n_runs") > 0))
    best = F.min(F.struct((-share).alias("less"), F.col("item_id"), (F.col("n_verbatim") == F.col("n_windows")).alias("verbatim")))
    return bad.groupBy(KEY).agg(F.count("*").alias("n_items"), best.alias("best")).select(KEY, "n_items", F.col("best.item_id").alias("best_item"), (-F.col("best.less")).alias("best_share"), F.col("best.verbatim").alias("verbatim"))


def judged(docs: DataFrame, benchmark: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """doc_id, n_items, best_item, best_share, verbatim of contaminated rows."""
    keyed = with_key(docs.select("doc_id", "text"))
    return contaminated(keyed, benchmark, min_share).join(keyed.select(KEY, "doc_id"), KEY).drop(KEY)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item."""
    keyed = with_key(docs)
    return keyed.join(contaminated(keyed, benchmark), KEY, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contaminated document: how many items it holds and the one it holds most of."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
