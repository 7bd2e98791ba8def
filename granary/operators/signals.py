"""Business signals from page texts: the whole rule pack, what each quote is about, signals, factors and profile flags.

Rules are tried where a text holds a literal that they need; the literals of all rules are looked for in one pass over
batches of texts. All that follows is grouping by company.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import signal_rules as R
from granary.functions import url as U
from granary.functions.literals import finder, patterns_met

AROUND, LONGEST, CAP = 90, 250, 3
TO_INDUSTRY, TO_CONSUMERS = r"\b(?:b2b|enterprise\s+(?:client|customer|sale))\b", r"\b(?:b2c|consumer|end\s+user)\b"
#: All patterns that tell what a quote is about.
SUBJECT_PATTERNS = (*[p for _, p in R.OUTSIDE], R.ADDRESSED, R.OWN_PEOPLE, *[p for _, p, _ in R.FIRST_PERSON], *[p for _, _, p in R.FIRST_PERSON if p], R.MODERN, R.SOLD, R.TO_CUSTOMERS, R.THE_COMPANY, *R.SLOGANS, R.TREND)
PLACES = "array<struct<rule:int,nth:int,pos:int,quote:string>>"


def places(text: Column, patterns=R.PATTERNS) -> Column:
    """Per rule the first CAP matches that nothing around takes back: rule, nth (from 1), pos (from 0), quote on one line."""

    @F.pandas_udf(PLACES)
    def find(texts: pd.Series) -> pd.Series:
        quick, compiled = finder(tuple(p for _, p, _ in patterns))
        against = [regex.compile(anti, regex.I | regex.A) if anti else None for _, _, anti in patterns]
        blank = regex.compile(r"\s+", regex.A)

        def one(text, met):
            out = []
            for number in met:
                anti = against[number]
                nth = 0
                for m in compiled[number].finditer(text):
                    quote = blank.sub(" ", text[max(0, m.start() - AROUND) : m.end() + AROUND]).strip(" ")[:LONGEST]
                    if anti is None or not anti.search(quote):
                        nth += 1
                        out.append((number, nth, m.start(), quote))
                        if nth == CAP:
                            break
            return out

        listed = texts.tolist()
        return pd.Series([one(t, n) for t, n in zip(listed, quick.met(listed))])

    return find(text)


def evidence(segments: DataFrame, key: str, patterns=R.PATTERNS) -> DataFrame:
    """key, seg_no, url, page_type, tier, name, is_vendor, rule, nth, pos, quote, signal.

    segments has key, seg_no, url, path, text, name (of the company, or null) and is_vendor; page_type and tier follow
    from the path unless segments has them too. Of one signal and url at most CAP quotes stay, but the first of every
    pattern and segment does. Null and empty texts give no rows; repeated segments count as they stand; other columns
    are left out.
    """
    known = {"page_type", "tier"} <= set(segments.columns)
    typed = segments if known else segments.withColumn("page_type", U.page_type(F.col("path"))).withColumn("tier", U.tier(F.col("page_type")))
    found = typed.select(key, "seg_no", "url", "page_type", "name", "is_vendor", F.col("tier").alias("_tier"), places(F.col("text"), patterns).alias("m"))
    # outer, as a plain explode would have the optimizer filter by the array's size, which finds all places once more
    rows = found.withColumn("m", F.explode_outer("m")).where("m IS NOT NULL").select("*", "m.*").drop("m")
    signal = F.element_at(F.array(*[F.lit(s) for s, _, _ in patterns]), F.col("rule") + 1)
    tier = F.col("_tier")
    w = Window.partitionBy(key, "signal", "url").orderBy("seg_no", "rule", "pos")
    return rows.select("*", signal.alias("signal"), tier.alias("tier")).withColumn("_n", F.row_number().over(w)).where(f"nth = 1 OR _n <= {CAP}").drop("_n", "_tier")


def short_name(name: Column) -> Column:
    """First word of a name of several words without its legal form, if it has four letters and isn't common; else null."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "(?i)" + R.LEGAL_FORMS, " "), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))
    words = F.split(clean, " ")
    first = F.element_at(words, 1)
    return F.when((F.size(words) > 1) & (F.length(first) >= 4) & ~F.lower(first).isin(*R.COMMON_FIRST), first)


def says(text: Column, name: Column) -> Column:
    """Whether a name occurs as whole words of any script, in any case."""
    plain = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.coalesce(F.rlike(text, F.concat(F.lit(r"(?iu)(?:^|[^\p{L}\p{N}])"), plain, F.lit(r"(?:$|[^\p{L}\p{N}])"))), F.lit(False))


def subject(quote: Column, page: Column, name: Column, is_vendor: Column) -> Column:
    """What a quote is about; rules in their order, the first that holds decides."""
    met = F.when(quote.isNotNull(), patterns_met(quote, SUBJECT_PATTERNS))
    said = lambda p: F.array_contains(met, SUBJECT_PATTERNS.index(p))
    rules = [(said(p), s) for s, p in R.OUTSIDE]
    rules += [(page == p, s) for p, s in R.OWN_PAGES]
    rules.append((F.coalesce(is_vendor, F.lit(False)) & page.isin("about", "other") & ~(said(R.ADDRESSED) & ~said(R.OWN_PEOPLE)), "company_strategy"))
    rules += [(said(p) & ~said(absent) if absent else said(p), s) for s, p, absent in R.FIRST_PERSON]
    rules.append((page.isin("about", "other") & said(R.MODERN) & ~said(R.SOLD), "company_strategy"))
    named = (F.length(F.trim(name)) >= 4) & (says(quote, F.trim(name)) | says(quote, short_name(name)))
    rules.append((page.isin(*R.NAMED_PAGES) & ~said(R.TO_CUSTOMERS) & (F.coalesce(named, F.lit(False)) | said(R.THE_COMPANY)), "company_strategy"))
    rules.append(((page == "homepage") | said(R.SLOGANS[0]) | said(R.SLOGANS[1]), "generic_marketing"))
    rules.append((said(R.TREND), "industry_trend"))
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for holds, value in rules[1:]:
        out = out.when(holds, F.lit(value))
    return out.otherwise("generic_marketing")


def with_subject(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject", subject(F.col("quote"), F.col("page_type"), F.col("name"), F.col("is_vendor")))


def distinct_quotes(rows: DataFrame, key: str) -> DataFrame:
    """Of each signal and first 60 characters of a quote the first row."""
    w = Window.partitionBy(key, "signal", F.substring("quote", 1, 60)).orderBy("seg_no", "rule", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def signals(rows: DataFrame, key: str) -> DataFrame:
    """key, signal, strength, n, validated, is_own, best_tier, best_quote of distinct quotes with subjects.

    Quotes about the company count. A company without any gets a weak signal from up to two quotes about its industry
    or products instead. Ties of tier go to the earlier quote.
    """
    w = Window.partitionBy(key)
    of = rows.select("*", F.max(F.col("subject").isin(*R.OWN_SUBJECTS)).over(w).alias("_any"))
    own, order = F.col("is_own"), Window.partitionBy(key, "signal").orderBy("seg_no", "rule", "pos")
    # a company has either own quotes or a floor, so that one pass takes both
    told = of.withColumn("is_own", F.col("subject").isin(*R.OWN_SUBJECTS)).where(own | (~F.col("_any") & F.col("subject").isin(*R.FLOOR_SUBJECTS)))
    kept = told.withColumn("_n", F.row_number().over(order)).where(own | (F.col("_n") <= 2))
    grouped = kept.groupBy(key, "signal", "is_own").agg(F.count("*").alias("n"), F.min("tier").alias("best"), F.min_by("quote", F.struct("tier", "seg_no", "rule", "pos")).alias("best_quote"))
    strength = F.when(~F.col("is_own"), "weak").when(F.col("best") == 1, "strong").when(F.col("best") == 2, "moderate").otherwise("weak")
    return grouped.select(key, "signal", strength.alias("strength"), "n", (F.col("is_own") & ((F.col("n") >= 2) | (F.col("best") == 1))).alias("validated"), "is_own", F.col("best").alias("best_tier"), "best_quote")


def factors(spark: SparkSession, signal_rows: DataFrame, key: str) -> DataFrame:
    """key, factor, signals (sorted): the factors that a company's signals stand for."""
    mapping = spark.createDataFrame(list(R.SIGNAL_FACTORS), "signal string, factor string")
    return signal_rows.join(F.broadcast(mapping), "signal").groupBy(key, "factor").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def profile(text: Column) -> Column:
    """A company's flags, primary type and selling model from its whole text; a null text has none."""
    every = [p for _, patterns in R.PROFILE for p in patterns] + [R.CONSUMER_GOODS, R.INDUSTRIAL_CONTEXT, TO_INDUSTRY, TO_CONSUMERS, R.RESEARCH_CENTER, R.ROBOTICS, R.SOFTWARE_PLATFORM]
    met = patterns_met(text, every)
    has = lambda p: F.array_contains(met, every.index(p))
    flags = {}
    for name, patterns in R.PROFILE:
        flags[name] = has(patterns[0])
        for p in patterns[1:]:
            flags[name] = flags[name] | has(p)
    flags["retailer"] = flags["retailer"] | (has(R.CONSUMER_GOODS) & ~has(R.INDUSTRIAL_CONTEXT))
    primary = F.when(~flags["software_saas"] & flags["industrial_vendor"] & flags["manufacturer"], "industrial_vendor_manufacturer")
    for name in R.PRIMARY:
        primary = primary.when(flags[name], name)
    selling = {
        "sells_to_industry": flags["industrial_vendor"] | flags["services_provider"] | flags["software_saas"] | has(TO_INDUSTRY),
        "sells_to_consumers": flags["retailer"] | has(TO_CONSUMERS),
        "sells_physical_product": flags["manufacturer"] | flags["industrial_vendor"] | flags["retailer"],
    }
    more = {"has_rd_center": has(R.RESEARCH_CENTER), "has_robotics_or_automation": has(R.ROBOTICS), "has_software_platform": has(R.SOFTWARE_PLATFORM)}
    return F.struct(*[c.alias(n) for n, c in (flags | selling | more).items()], primary.otherwise("unknown").alias("primary_type"))
