"""Weighted factor scores, clusters and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.signal_rules import spark_pattern

# Points of the factors, caps by confidence.
FIT = (("digital_transformation", 20), ("growth_signal", 15), ("capacity_expansion", 15), ("technology_investment", 15), ("industry_40_initiative", 10), ("multi_location_operations", 10), ("hiring_signal", 10), ("recent_news_or_event", 5))
AUTOMATION = (("ai_mention", 25), ("digital_transformation", 20), ("automation_keywords", 20), ("industry_40_initiative", 15), ("technology_investment", 15), ("hiring_signal", 5))
CAPS = (("high", 100), ("medium", 82), ("low", 50))


def capped(value: Column, confidence: Column) -> Column:
    limit = F.lit(100)
    for name, cap in CAPS:
        limit = F.when(confidence == name, cap).otherwise(limit)
    return F.least(value, limit)


def points(weights, flag) -> Column:
    """The sum of the points whose factor is present; flag maps a factor's name to a boolean column."""
    total = F.lit(0)
    for name, n in weights:
        total = total + F.when(F.coalesce(flag(name), F.lit(False)), n).otherwise(0)
    return F.least(total, F.lit(100))


def why_now(score: Column, confidence: Column) -> Column:
    """0 to 10; low confidence has an upper bound of 5 and no lower one."""
    return F.when(confidence == "low", F.least(score, F.lit(5.0))).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(10.0))))


def priority(fit: Column, automation: Column, urgency: Column, confidence: Column) -> Column:
    return capped(F.floor(fit * 0.35 + automation * 0.30 + urgency * 10 * 0.35 + 0.5), confidence)


def score_label(value: Column) -> Column:
    return F.when(value >= 80, "Strong").when(value >= 60, "Good").when(value >= 40, "Moderate").otherwise("Weak")


def urgency_label(value: Column) -> Column:
    return F.when(value >= 8, "Contact immediately").when(value >= 5, "Contact this week").when(value >= 2, "Watch list").otherwise("Deprioritize")


def cluster_confidence(present: Column, wanted: Column) -> Column:
    """high, medium or low by the share of a cluster's signals that are present; null without any."""
    share = F.size(F.array_intersect(present, wanted)) / F.size(wanted)
    return F.when(share >= 0.66, "high").when(share >= 0.33, "medium").when(share > 0, "low")


def evidence_confidence(tier1_share: Column, relevant_share: Column, n_types: Column, n_themes: Column) -> Column:
    """0 to 100: 30 for tier, 25 for relevance, 25 for source types (of 8), 20 for themes (of 4)."""
    return F.floor(tier1_share * 30 + relevant_share * 25 + F.least(F.lit(1.0), n_types / 8) * 25 + F.least(F.lit(1.0), n_themes / 4) * 20 + 0.5)


def theme_priority(n_signals: Column, top: Column, tier1: Column) -> Column:
    """min(40, 10 n) + round(0.4 top) + 20 with first-tier evidence, else 10."""
    return F.least(F.lit(40), n_signals * 10) + F.floor(top * 0.4 + 0.5) + F.when(tier1, 20).otherwise(10)


# Floors of clusters, weights of urgency, urgency of triggers.
CLUSTER_FLOORS = (("manufacturing_intelligence", 30), ("industrial_ai", 30), ("saas_customer_operations", 35), ("conglomerate_enterprise_intelligence", 35), ("engineering_delivery_intelligence", 25), ("multi_site_coordination", 20), ("scale_and_capacity", 15), ("technology_integration", 15), ("dealer_distribution_network", 20), ("automotive_after_sales", 20), ("saas_product_intelligence", 25), ("workforce_intelligence", 10), ("supply_chain_growth", 10), ("business_event_momentum", 5))
FLOOR_CAP = 88
SIGNAL_URGENCY = (("capacity_expansion", 35), ("acquisition", 30), ("new_facility", 25), ("ai_ml_hiring", 20), ("ai_mention", 15), ("industry40_initiative", 15), ("digital_transformation", 15), ("automation_engineering_hiring", 10), ("automation_investment", 10), ("digital_transformation_hiring", 10), ("new_market_entry", 10), ("erp_implementation", 8), ("mes_adoption", 8), ("iot_investment", 8), ("multi_location_operations", 5), ("operations_hiring_surge", 5), ("leadership_hiring", 3), ("sustainability_initiative", 3), ("quality_certification_pursuit", 3), ("named_erp_crm_tool", 8), ("external_training_engagement", 5))
TRIGGER_URGENCY = (("capacity_expansion", 35), ("recent_news_or_event", 30), ("financial_indicator", 25), ("hiring_signal", 20), ("ai_mention", 15), ("industry40_initiative", 15), ("automation_keywords", 10), ("digital_transformation", 10), ("supply_chain_signal", 8), ("multi_location_operations", 5))


def looked_up(name: Column, table, default: int = 0) -> Column:
    """The number of a name in a fixed table."""
    found = F.lit(default)
    for key, value in table:
        found = F.when(name == key, value).otherwise(found)
    return found


def rounded(value: Column) -> Column:
    """Halves go up, also negative ones."""
    return F.floor(value + 0.5)


def cluster_floor(clusters: DataFrame, key: str) -> DataFrame:
    """key, floor: what a company's clusters (id, confidence) guarantee its automation score, 88 at most."""
    share = F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.75).otherwise(0.5)
    return clusters.groupBy(key).agg(F.least(rounded(F.sum(looked_up(F.col("id"), CLUSTER_FLOORS) * share)), F.lit(FLOOR_CAP)).cast("long").alias("floor"))


def why_now_scores(signals: DataFrame, key: str) -> DataFrame:
    """key, score (0 to 10): urgency weights of the company's own signals, an eighth of their sum."""
    own = signals.where("is_company_subject")
    return own.groupBy(key).agg(F.least(F.lit(10), rounded(F.sum(looked_up(F.col("type"), SIGNAL_URGENCY)) / 8)).cast("long").alias("score"))


# The least score that a narrative guarantees, and what it says, the highest first.
NARRATIVE_FLOORS = (
    (6, r"\b(?:capacity\s+expan|new\s+(?:plant|facilit)|greenfield|acqui(?:red|sition))\b"),
    (5, r"\b(?:expan(?:sion|ding)\s+into|ai[\s-]powered\s+digitali)\b"),
    (4, r"\b(?:industry\s*4\.0|digital\s+transformation\s+(?:initiative|journey|program|roadmap)|investing\s+in\s+(?:digital|ai|automation))\b"),
)


def effective_why_now(score: Column, summary: Column, why_now: Column) -> Column:
    """The score by signals, or the floor of what a summary and its reasons tell, if that is higher."""
    said = F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.coalesce(why_now, F.lit(""))))
    floor = F.coalesce(*[F.when(said.rlike(spark_pattern(p)), n) for n, p in NARRATIVE_FLOORS], F.lit(0))
    return F.greatest(score, floor)


def urgency(triggers: DataFrame, key: str) -> DataFrame:
    """key, n_triggers, urgency_score, urgency: a type counts once, with 10 more for first-tier evidence; the four best count."""
    weight = looked_up(F.col("type"), TRIGGER_URGENCY)
    each = triggers.withColumn("w", weight).where("w > 0").groupBy(key, "type").agg((F.max("w") + F.when(F.max((F.col("tier") == "tier1").cast("int")) == 1, 10).otherwise(0)).alias("c"))
    best = each.groupBy(key).agg(F.count("*").alias("n_triggers"), F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 4).alias("top"))
    score = F.least(F.lit(100), F.aggregate("top", F.lit(0), lambda a, x: a + x))
    return best.select(key, "n_triggers", score.cast("long").alias("urgency_score"), F.when(score >= 60, "immediate").when(score >= 35, "near_term").otherwise("emerging").alias("urgency"))


def scrape_quality(n_pages: Column, n_chars: Column, method: Column) -> Column:
    """0 to 100: a step by pages, then volume and the way of discovery."""
    base = F.when(n_pages == 0, 0).when(n_pages == 1, 30).when(n_pages <= 3, 55).when(n_pages <= 6, 70).when(n_pages <= 10, 80).otherwise(90)
    volume = F.when(n_chars >= 15_000, 10).when(n_chars >= 8_000, 5).otherwise(0)
    return F.least(F.lit(100), F.least(F.lit(100), base + volume) + F.when(method.isin("map_url", "sitemap"), 5).otherwise(0))


def bounded(value: Column) -> Column:
    return rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def intelligence_quality(items: Column, enriched: Column, fetched: Column, tiers: tuple[Column, Column, Column], multi_source: Column, very_high: Column, mean_validation: Column, critical: Column, important: Column) -> dict[str, Column]:
    """Five dimensions of 0 to 100 and their weighted total with its label."""
    at_most = lambda most, x: F.least(F.lit(most), x)
    dims = {
        "data_coverage": bounded(at_most(40, items * 4) + at_most(30, enriched * 6) + at_most(30, fetched * 10)),
        "evidence_strength": bounded(tiers[0] * 25 + tiers[1] * 10 + tiers[2] * 3),
        "validation_strength": bounded(at_most(50, multi_source * 15) + at_most(50, very_high * 25)),
        "signal_confidence": bounded(F.coalesce(mean_validation, F.lit(0.0))),
        "opportunity_confidence": bounded(critical * 40 + important * 20),
    }
    overall = rounded(sum((dims[name] * w for name, w in (("evidence_strength", 0.25), ("validation_strength", 0.25), ("signal_confidence", 0.15), ("opportunity_confidence", 0.15))), dims["data_coverage"] * 0.20))
    return dims | {"overall": overall}


def quality_label(overall: Column) -> Column:
    return F.when(overall >= 80, "Excellent").when(overall >= 65, "Good").when(overall >= 45, "Fair").otherwise("Limited")


def is_sufficient(subject_items: Column, signals: Column, leaders: Column, plants: Column, countries: Column) -> Column:
    """Whether there is any evidence at all: signals, people, or facilities."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    return ~(zero(subject_items) & zero(signals) & zero(leaders) & ~(F.coalesce(plants, F.lit(0)) > 0) & ~(F.coalesce(countries, F.lit(0)) > 0))


def evaluation_score(c: dict[str, Column]) -> Column:
    """0 to 100 over seven dimensions (20, 20, 15, 10, 10, 15, 10); nothing for a failed run.

    c has success, validation, sufficient, opportunities, with_evidence, signals, min_signals, pain_points, backed,
    competitors_ok, segments_ok, audited, flagged, contaminated.
    """
    ratio = lambda a, b: a / b
    reliability = F.when(c["validation"] == "PASS", 20).when(c["validation"] == "WARN", 14).when(c["validation"] == "PARTIAL", 8).otherwise(0)
    none = lambda most: F.when(c["sufficient"], most / 2).otherwise(float(most))
    opportunities = F.when(c["opportunities"] == 0, none(20)).otherwise(ratio(c["with_evidence"], F.greatest(c["opportunities"], F.lit(1))) * 20)
    depth = F.when(c["sufficient"], 7.5).otherwise(0.0) + F.when(c["min_signals"] > 0, F.least(F.lit(1.0), ratio(c["signals"], F.greatest(c["min_signals"], F.lit(1))))).otherwise(F.when(c["signals"] > 0, 1.0).otherwise(0.0)) * 7.5
    pains = F.when(c["pain_points"] == 0, none(10)).otherwise(ratio(c["backed"], F.greatest(c["pain_points"], F.lit(1))) * 10)
    discovered = F.when(c["competitors_ok"], 5).otherwise(0) + F.when(c["segments_ok"], 5).otherwise(0)
    audit = F.when(c["audited"] == 0, 15.0).otherwise((1 - ratio(c["flagged"], F.greatest(c["audited"], F.lit(1)))) * 15)
    safe = F.when(c["contaminated"], 0).otherwise(10)
    total = reliability + opportunities + depth + pains + discovered + audit + safe
    return F.when(c["success"], rounded(total * 100) / 100).otherwise(0.0)
