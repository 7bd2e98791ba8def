"""What signals add up to: clusters of factors, signals confirmed by several sources, and themes with their evidence.

Cluster and theme rules are data of a fixed size: rows of (rule, place, signal). A company's signals meet them by an
equi-join on the signal, and what a rule needs is then counted per company and rule, so that no company meets a rule
that it has no signal of.

Defined results: null signals, factors and sources are left out; repeated rows count once; ties keep the order in which
rules, signals and quotes stand; companies without a match have no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.evidence import validation_score

# Cluster, tier, required factors (one at least), further factors, business models (none for all).
_MAKERS = ("Manufacturing", "Automotive OEM", "Automotive Supplier")
CLUSTERS = (
    ("manufacturing_intelligence", 1, ("industry_40_initiative", "digital_transformation"), ("technology_investment", "multi_location_operations", "ai_mention"), _MAKERS),
    ("industrial_ai", 1, ("ai_mention", "automation_keywords"), ("industry_40_initiative", "digital_transformation", "technology_investment"), _MAKERS),
    ("saas_customer_operations", 1, ("growth_signal", "hiring_signal"), ("ai_mention", "recent_news_or_event"), ("Software/SaaS",)),
    ("conglomerate_enterprise_intelligence", 1, ("multi_location_operations",), ("growth_signal", "recent_news_or_event", "digital_transformation"), ("Conglomerate",)),
    ("engineering_delivery_intelligence", 1, ("hiring_signal", "growth_signal"), ("ai_mention", "recent_news_or_event"), ("Engineering Services",)),
    ("multi_site_coordination", 2, ("multi_location_operations",), ("growth_signal", "capacity_expansion", "digital_transformation"), (*_MAKERS, "Conglomerate")),
    ("scale_and_capacity", 2, ("capacity_expansion", "growth_signal"), ("hiring_signal", "recent_news_or_event"), _MAKERS),
    ("technology_integration", 2, ("technology_investment", "digital_transformation"), ("industry_40_initiative", "ai_mention"), _MAKERS),
    ("workforce_intelligence", 2, ("hiring_signal",), ("growth_signal", "capacity_expansion"), (*_MAKERS, "Conglomerate")),
    ("dealer_distribution_network", 2, ("growth_signal", "multi_location_operations"), ("recent_news_or_event",), ("Automotive OEM", "Conglomerate")),
    ("automotive_after_sales", 2, ("growth_signal", "recent_news_or_event"), ("multi_location_operations",), ("Automotive OEM", "Automotive Supplier")),
    ("saas_product_intelligence", 2, ("ai_mention", "technology_investment"), ("growth_signal",), ("Software/SaaS",)),
    ("supply_chain_growth", 3, ("growth_signal",), ("capacity_expansion", "recent_news_or_event"), (*_MAKERS, "Distribution/Logistics")),
    ("business_event_momentum", 3, ("recent_news_or_event",), ("growth_signal", "multi_location_operations"), ()),
)
# The profile flag by which a business model is recognised.
MODEL_FLAGS = (("Manufacturing", "manufacturer"), ("Automotive OEM", "manufacturer"), ("Automotive Supplier", "manufacturer"), ("Industrial Technology Vendor", "industrial_vendor"), ("Software/SaaS", "software_saas"), ("Engineering Services", "services_provider"), ("Conglomerate", "conglomerate"), ("Distribution/Logistics", "logistics_operator"))
FLAGS = tuple(dict.fromkeys(flag for _, flag in MODEL_FLAGS))
MANY_PLANTS, MANY_COUNTRIES, SITES = 5, 10, "multi_location_operations"
# Themes with the signals that lead to them, of which two must be there.
THEMES = (
    ("manufacturing_transformation", ("capacity_expansion", "automation_keywords", "industry40_initiative", "hiring_signal", "digital_transformation")),
    ("ai_digital_strategy", ("ai_mention", "digital_transformation", "hiring_signal", "industry40_initiative")),
    ("enterprise_scaling", ("capacity_expansion", "multi_location_operations", "recent_news_or_event", "financial_indicator")),
    ("supply_chain_intelligence", ("supply_chain_signal", "multi_location_operations", "automation_keywords", "digital_transformation")),
    ("talent_technology_buildout", ("hiring_signal", "ai_mention", "digital_transformation")),
    ("strategic_event_response", ("recent_news_or_event", "hiring_signal", "capacity_expansion")),
)
LEAST_SIGNALS, QUOTES, QUOTE_CHARS, SOURCES_SHOWN = 2, 6, 200, 4


def clusters(spark: SparkSession, factors: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """key, cluster, tier, confidence, signals (required ones first), place (by tier, confidence, rule).

    factors has key and factor; profiles has key, the FLAGS, n_plants and n_countries. A cluster needs one required
    factor and a model that fits the profile; confidence is high from 0.66 of all its factors, medium from 0.33. Many
    sites make it high where several locations are among its factors.
    """
    rules = [(i, tier, len(need) + len(more), place, factor, place < len(need)) for i, (_, tier, need, more, _) in enumerate(CLUSTERS) for place, factor in enumerate(need + more)]
    table = spark.createDataFrame(rules, "rule int, tier int, possible int, place int, factor string, required boolean")
    met = factors.select(key, "factor").distinct().join(F.broadcast(table), "factor").groupBy(key, "rule", "tier", "possible").agg(F.bool_or("required").alias("any"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "factor"))), lambda x: x["factor"]).alias("signals")).where("any")
    flag_of = dict(MODEL_FLAGS)
    fits = F.lit(False)
    for i, (_, _, _, _, models) in enumerate(CLUSTERS):
        of = F.lit(not models)
        for flag in dict.fromkeys(flag_of[m] for m in models):
            of = of | F.coalesce(F.col(flag), F.lit(False))
        fits = F.when(F.col("rule") == i, of).otherwise(fits)
    many = (F.coalesce("n_plants", F.lit(0)) >= MANY_PLANTS) | (F.coalesce("n_countries", F.lit(0)) >= MANY_COUNTRIES)
    share = F.col("n") / F.col("possible")
    sure = F.when((share >= 0.66) | (many & F.array_contains("signals", SITES)), "high").when(share >= 0.33, "medium").otherwise("low")
    found = met.join(profiles.select(key, *FLAGS, "n_plants", "n_countries"), key).where(fits).withColumn("confidence", sure)
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    name = F.element_at(F.array(*[F.lit(c[0]) for c in CLUSTERS]), F.col("rule") + 1)
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("tier", order, "rule"))).select(key, name.alias("cluster"), "tier", "confidence", "signals", "place")


def level(score: Column) -> Column:
    return F.when(score >= 80, "very_high").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")


def first_quotes(evidence: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, signal, source, nth (of the signal's sources, by first sight), quote: each source's first quote of a signal."""
    given = evidence.where("signal IS NOT NULL AND source IS NOT NULL")
    first = given.groupBy(key, "signal", "source").agg(F.min(F.struct(*order, F.substring("quote", 1, QUOTE_CHARS).alias("quote"))).alias("x"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(key, "signal").orderBy("x", "source"))).select(key, "signal", "source", "nth", F.coalesce("x.quote", F.lit("")).alias("quote"))


def validated(quotes: DataFrame, key: str) -> DataFrame:
    """key, signal, n_sources, score, level, sources: a signal is the surer the more kinds of source tell of it."""
    sources = F.transform(F.array_sort(F.collect_list(F.struct("nth", "source"))), lambda x: x["source"])
    return quotes.groupBy(key, "signal").agg(F.count("*").alias("n_sources"), sources.alias("sources")).withColumn("score", validation_score(F.col("n_sources"))).select(key, "signal", "n_sources", "score", level(F.col("score")).alias("level"), "sources")


def themes(spark: SparkSession, quotes: DataFrame, key: str) -> DataFrame:
    """key, theme, signals (best score first), confidence, priority, score, place, quotes (QUOTES distinct ones, of the surest signals first).

    quotes are those of first_quotes; of a signal the first SOURCES_SHOWN count as its evidence.
    """
    rules = [(i, place, signal) for i, (_, signals) in enumerate(THEMES) for place, signal in enumerate(signals)]
    table = F.broadcast(spark.createDataFrame(rules, "rule int, place int, signal string"))
    ranked = validated(quotes, key).join(table, "signal").select(key, "rule", "signal", "score", "level", (-F.col("score")).alias("less"), "place")
    listed = F.array_sort(F.collect_list(F.struct("less", "place", "signal")))
    met = ranked.groupBy(key, "rule").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.transform(listed, lambda x: x["signal"]).alias("signals")).where(F.col("n") >= LEAST_SIGNALS)
    bonus = F.when(level(F.col("top")) == "very_high", 20).when(level(F.col("top")) == "high", 10).otherwise(0)
    score = F.least(F.lit(100), F.least(F.lit(40), 10 * F.col("n")) + F.floor(F.col("top") * 0.4 + 0.5) + bonus)
    told = quotes.where(F.col("nth") <= SOURCES_SHOWN).join(ranked.join(met.select(key, "rule"), [key, "rule"]), [key, "signal"])
    once = told.groupBy(key, "rule", "quote").agg(F.min(F.struct("less", "place", "nth")).alias("at"))
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy(key, "rule").orderBy("at"))).where(F.col("n") <= QUOTES)
    evidence = kept.groupBy(key, "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "quote"))), lambda x: x["quote"]).alias("quotes"))
    name = F.element_at(F.array(*[F.lit(x) for x, _ in THEMES]), F.col("rule") + 1)
    out = met.join(evidence, [key, "rule"]).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "rule"))
    return out.select(key, name.alias("theme"), "signals", level(F.col("top")).alias("confidence"), F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 45, "important").otherwise("secondary").alias("priority"), F.col("score").cast("long").alias("score"), place.alias("place"), "quotes")
