"""Line classes and scores of scraped text, and quote verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X

# Patterns of line classes.
COOKIE = r"(?i)\b(cookies?|consent|privacy\s+policy|gdpr|ccpa|opting\s+out|personal\s+data|data\s+protection)\b"
BOILERPLATE = r"(?i)(all\s+rights\s+reserved|copyright\s+©?\s*\d{4}|terms\s+(of\s+)?(service|use)|\bsitemap\b|powered\s+by|back\s+to\s+top|skip\s+to\s+(main\s+)?content|toggle\s+navigation|\bclose\b.*\bmenu\b|search\s+\.\.\.?$|loading\.\.\.)"
NAVIGATION = r"(?i)^(home|about|contact|careers|news|blog|products?|services?|solutions?|resources?|support|login|sign\s*in|sign\s*up|get\s+started|learn\s+more|read\s+more|view\s+all|see\s+all|click\s+here)$"
SEPARATOR = r"^\s*(>|\||-|·|•|◦)\s*\w+\s*$"
OPERATIONAL = r"(?i)(manufactur|produc[ti]|assembly|plant|facilit|automat|digital|transform|strateg|invest|employ|expan[sd]|acqui|partner|supply|customer|revenue|market|launch|deploy|implement|operat|engineer|technolog|innovat|software|platform|solution|service|capabilit|quality|maintenance|schedul|forecast|analytic)"


def content_quality(docs: DataFrame, key: str, operational: str = OPERATIONAL) -> DataFrame:
    """Per document: line ratios, score 0 to 100, flags and a recommendation. Lines take the first class that fits."""
    lines = docs.select(key, F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.strip), lambda x: x != "").alias("lines"))

    def kind(line: Column) -> Column:
        words = F.size(F.split(line, r"\s+"))
        return (F.when(line.rlike(COOKIE), "c").when(line.rlike(BOILERPLATE), "b").when((words <= 4) & (line.rlike(NAVIGATION) | line.rlike(SEPARATOR)), "v")
                .when(words >= 8, F.when(line.rlike(operational), "o").otherwise("s")).otherwise("x"))

    # counted inside each row: no line leaves its document, so nothing is shuffled
    kinds = lines.select(key, F.transform("lines", kind).alias("k"))
    n = lambda *names: F.size(F.filter("k", lambda x: x.isin(*names))).cast("long")
    c = kinds.select(key, F.size("k").cast("long").alias("total"), n("c").alias("c"), n("v").alias("v"), n("b").alias("b"), n("s", "o").alias("s"), n("o").alias("o"))
    ratio = lambda x: F.when(F.col("total") > 0, F.col(x) / F.col("total")).otherwise(F.lit(0.0))
    r = c.select(key, "total", "s", "o", *[ratio(x).alias(f"r{x}") for x in "cvbso"])
    raw = (F.lit(100.0) - F.when(F.col("rc") > 0.10, F.least(F.lit(40.0), F.col("rc") * 200)).otherwise(0) - F.when(F.col("rv") > 0.20, F.least(F.lit(20.0), F.col("rv") * 60)).otherwise(0)
           - F.when(F.col("rb") > 0.20, F.least(F.lit(20.0), F.col("rb") * 60)).otherwise(0) + F.when(F.col("ro") > 0.30, 10).when(F.col("ro") < 0.10, -20).otherwise(0))
    score = F.when(F.col("total") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(F.array(flag(F.col("rc") > 0.15, "cookie_heavy"), flag((F.col("rv") > 0.40) & (F.col("rs") < 0.20), "navigation_only"), flag((F.col("rb") > 0.30) & (F.col("rs") < 0.20), "marketing_boilerplate"),
                                    flag((F.col("ro") < 0.05) & (F.col("rs") > 0.15), "customer_stories_only"), flag((F.col("rs") < 0.10) & (F.col("o") == 0), "no_operational_content")))
    out = r.withColumn("score", score.cast("int")).withColumn("flags", flags)
    advice = F.when((F.col("score") >= 60) & (F.size("flags") == 0), "proceed").when((F.col("total") > 0) & ((F.col("score") >= 35) | ((F.size("flags") <= 1) & ~F.array_contains("flags", "no_operational_content"))), "proceed_with_caution").otherwise("low_confidence")
    return out.select(key, F.col("total").alias("n_lines"), "score", F.array_join("flags", ",").alias("flags"), advice.alias("recommendation"), F.col("ro").alias("operational_ratio"), F.col("rc").alias("cookie_ratio"))


def verify_quote(quote: Column, content: Column) -> Column:
    """exact, close or none: verbatim after squeezing, or most significant words and one run of four words."""
    q, c = X.squeeze(F.lower(quote)), X.squeeze(F.lower(content))
    words = X.significant_words(F.regexp_replace(q, r"[^a-z0-9\s]", ""), 4)
    plain = F.split(q, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(plain) - 3, F.lit(1))), lambda i: F.array_join(F.slice(plain, i, 4), " "))
    share = F.size(F.filter(words, lambda w: F.contains(c, w))) / F.greatest(F.size(words), F.lit(1))
    close = (F.size(words) >= 8) & (share >= 0.75) & F.exists(runs, lambda g: F.contains(c, g))
    return F.when(F.length(F.trim(quote)) < 30, "none").when(F.contains(c, q), "exact").when(close, "close").otherwise("none")


# Patterns of market statements, in order of precedence.
MARKET_PATTERNS = (
    ("growth_indicator", r"(?i)\b(?:CAGR|compound\s+annual\s+growth|market\s+size|growing\s+at\s+\d|grow(?:th)?\s+(?:of|to|by)\s+\d|projected\s+to\s+(?:reach|grow)|expected\s+to\s+(?:reach|grow)|forecast\s+to\s+(?:reach|grow)|valued\s+at\s+\$|reach(?:ing)?\s+\$[\d,.]+\s*(?:billion|million|trillion|bn|mn))\b"),
    ("challenge", r"(?i)\b(?:challenge|headwind|under\s+pressure|shortage|disrupt(?:ion|ed|ing)?|declin(?:e|ing|ed)|slowdown|volatil|rising\s+costs?|supply\s+chain\s+(?:issue|disruption|constraint)|labor\s+shortage|talent\s+shortage|margin\s+pressure|regulatory\s+(?:pressure|burden|challenge)|inflation(?:ary)?\s+pressure)\b"),
    ("shift", r"(?i)\b(?:shift(?:ing)?\s+(?:toward|towards|from|to|in)|transition(?:ing)?\s+(?:to|toward|towards)|mov(?:e|ing)\s+(?:away\s+from|from|to|toward|towards)|pivot(?:ing)?\s+to|increasingly\s+(?:adopting|moving|turning)|migrat(?:e|ing|ion)\s+(?:to|toward))\b"),
    ("trend", r"(?i)\b(?:trend|emerging|key\s+trend|latest\s+trend|industry\s+trend|growing\s+demand|rising\s+demand|gaining\s+(?:traction|momentum))\b"),
)


def market_statement(text: Column) -> Column:
    """The category of a market statement by the fixed patterns, or null."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in MARKET_PATTERNS])


def market_category(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(low.rlike("cagr|growth|grow(s|ing)?\\b|increase"), "growth_indicator").when(low.rlike("shortage|challenge|pressure|constraint|risk"), "challenge")
            .when(low.rlike("shift(ing)? (toward|to|from)|transition"), "shift").otherwise("trend"))


def is_grounded(tier: Column, least: str = "close") -> Column:
    """Whether a quote's verdict reaches the tier asked for."""
    return {"exact": tier == "exact", "close": tier.isin("exact", "close")}.get(least, F.lit(True))


#: Words of a quote below which a text's words around it may reach beyond every run of four.
FEW_WORDS, RUN, CHARS = 6, 4, 12


def quote_tiers(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, tier (exact or close) of every quote of 30 characters or more and every text that holds it.

    A close verdict needs four words of the quote in a row in the text, and so does an exact one of FEW_WORDS words or
    more, whose first and last word may stand inside longer ones. So pairs come from an equi-join of the hashes of all
    runs of four words; shorter quotes go by `short_quote_pairs`. The quotes' hashes meet the texts' first; texts that
    hold none go no further.
    """
    def grams(rows: DataFrame, key: str, text: str) -> DataFrame:
        words = rows.select(key, F.split(X.squeeze(F.lower(F.col(text))), " ").alias("w"))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - RUN, F.lit(0))), lambda i: F.xxhash64(*[F.coalesce(F.get("w", i + k), F.lit("")) for k in range(RUN)]))
        return words.select(key, F.explode(F.array_distinct(runs)).alias("g"))

    some = quotes.where(F.length(X.strip(F.col("quote"))) >= 30)
    own = grams(some, "item_id", "quote")
    pairs = grams(docs, "doc_id", "text").join(own, "g").select("item_id", "doc_id").unionByName(short_quote_pairs(some, docs)).distinct()
    judged = pairs.join(some, "item_id").join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", verify_quote(F.col("quote"), F.col("text")).alias("tier"))
    return judged.where("tier <> 'none'")


def short_quote_pairs(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id of quotes of fewer than FEW_WORDS words and texts that may hold them.

    All words but the first and the last stand whole in a text that holds the quote, so these are the key; quotes of one
    or two words, which have none, go by their first CHARS characters. Each kind costs a pass only if there are such quotes.
    """
    lowered = quotes.select("item_id", X.squeeze(F.lower(F.col("quote"))).alias("q")).withColumn("w", F.split("q", " ")).where(F.size("w") < FEW_WORDS)
    texts = docs.select("doc_id", X.squeeze(F.lower(F.col("text"))).alias("c"))
    kinds = lowered.select(F.size("w").alias("n"), F.when(F.size("w") < 3, F.least(F.length("q"), F.lit(CHARS))).otherwise(0).alias("chars")).distinct().collect()
    out = lowered.select("item_id", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")).limit(0)
    for n in sorted({r.n for r in kinds if r.n >= 3}):
        inner = lowered.where(F.size("w") == n).select("item_id", F.array_join(F.slice("w", F.lit(2), F.lit(n - 2)), " ").alias("k"))
        words = F.split("c", " ")
        runs = texts.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 3), F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n - 2)), " ")))).alias("k"))
        found = runs.join(inner, "k").select("item_id", "doc_id")
        out = out.unionByName(found)
    for chars in sorted({r.chars for r in kinds if r.n < 3}):
        head = lowered.where((F.size("w") < 3) & (F.least(F.length("q"), F.lit(CHARS)) == chars)).select("item_id", F.substring("q", 1, chars).alias("k"))
        windows = texts.where(F.length("c") >= chars).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c") - (chars - 1)), lambda i: F.substr("c", i, F.lit(chars))))).alias("k"))
        found = windows.join(head, "k").select("item_id", "doc_id")
        out = out.unionByName(found)
    return out


def market_groups(results: DataFrame, key: str) -> DataFrame:
    """key, statement_key, statement, category, mention_count, n_sources, strong of the market statements in search results.

    results has key, place, url, title and content. Sentences of the title come before those of the content. One
    statement is what begins alike (60 characters of its key); it is told as it stands first, and shortened to 240.
    """
    both = F.concat(F.transform(X.bare_sentences(F.coalesce("title", F.lit(""))), lambda s: F.struct(F.lit(0).alias("part"), s.alias("s"))), F.transform(X.bare_sentences(F.coalesce("content", F.lit(""))), lambda s: F.struct(F.lit(1).alias("part"), s.alias("s"))))
    rows = results.select(key, "place", "url", F.posexplode(both).alias("nth", "x")).select(key, "place", "url", "nth", "x.s")
    kept = rows.select("*", market_statement(F.col("s")).alias("category"), F.substring(X.statement_words(F.col("s")), 1, 60).alias("statement_key")).where(F.col("category").isNotNull() & X.statement_rejection_full(F.col("s")).isNull() & (F.col("statement_key") != ""))
    first = F.min(F.struct("place", "nth", "s", "category")).alias("f")
    shown = F.when(F.length("f.s") > 240, F.concat(F.substring("f.s", 1, 237), F.lit("..."))).otherwise(F.col("f.s"))
    return kept.groupBy(key, "statement_key").agg(first, F.count("*").alias("mention_count"), F.count_distinct("url").alias("n_sources"), F.bool_or(X.has_strong_indicator(F.col("s"))).alias("strong")).select(key, "statement_key", shown.alias("statement"), "f.category", "mention_count", "n_sources", "strong")
