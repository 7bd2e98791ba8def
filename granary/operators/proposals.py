"""Proposals of a language model against what is known: opportunities by three paths, and factors by three passes.

Both are settled in order of trust: what an earlier path or pass decides isn't up to a later one, and every row says
which one decided.

Defined results: null texts match nothing; companies with thin evidence have no opportunities; of several proposals for
one catalogue entry the first counts, and one proposal may serve several entries; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import service_rules as V
from granary.functions import signal_rules as R
from granary.functions import text as X
from granary.operators import content

#: Letters of a word that two titles must share, and of a stated basis.
WORD, BASIS = 5, 15
SERVICES = tuple(s for s, *_ in V.BY_TEXT) + tuple(x[0] for x in (V.INTERNAL, V.ANALYTICS, V.INTEGRATION))
# Factors by kind of signal (none for any type) and pattern of its type.
BY_TYPE = (
    ("growth", None, ("growth_signal",)), ("growth", r"capacity", ("capacity_expansion",)), ("hiring", None, ("hiring_signal",)), ("digital", None, ("digital_transformation",)),
    ("digital", r"industry.?40|industry_40|smart_factory|iot_investment|mes", ("industry_40_initiative",)), ("digital", r"automation_investment|automation", ("automation_keywords", "technology_investment")),
    ("digital", r"erp|mes|iot|technology", ("technology_investment",)), ("business", r"acquisition|funding|partnership|sustainability", ("recent_news_or_event",)),
)
# Factors by category of evidence.
BY_CATEGORY = (
    (("growth", "expansion"), ("growth_signal",)), (("capacity_expansion",), ("growth_signal", "capacity_expansion")), (("hiring",), ("hiring_signal",)), (("digital_transformation", "digital"), ("digital_transformation",)),
    (("automation",), ("automation_keywords",)), (("ai", "ai_mention"), ("ai_mention",)), (("multi_location",), ("multi_location_operations",)), (("technology", "technology_investment"), ("technology_investment",)), (("news", "recent_news"), ("recent_news_or_event",)),
)
# Factors by what a quote says, and by what all signals together say.
BY_QUOTE = (
    (r"industry[\s-]*4\.0|smart[\s-]*factory|iiot|digital[\s-]*twin", ("digital_transformation", "industry_40_initiative")), (r"artificial\s+intelligence|ai[\s-]powered|machine\s+learning", ("ai_mention",)),
    (r"automat(?:ion|ed|ing)|robot(?:ics)?|autonomous", ("automation_keywords",)), (r"digit(?:al\s+transform|ali[sz])", ("digital_transformation",)),
    (r"(?:multiple|new|additional|expand\w*)\s+(?:plant|facilit|locat|campus|site)", ("multi_location_operations",)), (r"technolog\w+\s+(?:invest|capex|deploy|rollout)|erp\s|scada|plc[\s,]", ("technology_investment",)),
)
BY_ALL = (
    (r"industry[\s-]*4\.0|smart[\s-]*factory|iiot|digital[\s-]*twin", ("digital_transformation", "industry_40_initiative")), (r"artificial\s+intelligence|ai[\s-]powered|machine\s+learning", ("ai_mention",)),
    (r"automat(?:ion|ed|ing)|robot(?:ics)?", ("automation_keywords",)), (r"digit(?:al\s+transform|ali[sz])", ("digital_transformation",)),
    (r"erp|scada|mes|technolog\w+\s+(?:invest|capex|deploy)", ("technology_investment",)), (r"(?:multiple|several|additional|new)\s+(?:plant|facilit|locat|campus|site)", ("multi_location_operations",)),
)
KINDS = ("growth", "hiring", "digital", "business")


def _named(rules) -> Column:
    """The factors of all rules (condition, names) that hold, as one array."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, names in rules for name in names]))


def derived_factors(signals: DataFrame, evidence: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, factor, by_pass: 0 for factors that were given, 1 by types of signals, 2 by the company's own evidence, 3 by all signals' words.

    signals has key, kind (of KINDS), place, type, evidence; evidence has key, category, quote, subject (null counts as
    own); given has key and factor.
    """
    kind, plain = F.col("kind"), F.coalesce("type", F.lit(""))
    # types of digital signals are compared in lower case, those of other kinds as they stand
    typed = F.when(kind == "digital", F.lower(plain)).otherwise(plain)
    first = signals.where(kind.isin(*KINDS)).select(key, F.explode(_named([((kind == k) & (typed.rlike(p) if p else F.lit(True)), names) for k, p, names in BY_TYPE])).alias("factor"), F.lit(1).alias("by_pass"))
    category, quote = F.lower(F.coalesce("category", F.lit(""))), F.lower(F.coalesce("quote", F.lit("")))
    own = evidence.where(F.col("subject").isNull() | (F.col("subject") == "") | F.col("subject").isin(*R.OWN_SUBJECTS))
    second = own.select(key, F.explode(_named([(category.isin(*c), names) for c, names in BY_CATEGORY] + [(quote.rlike(p), names) for p, names in BY_QUOTE])).alias("factor"), F.lit(2).alias("by_pass"))
    # what one signal ends with and the next begins with may be read together, so the words are joined in order
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    words = F.concat(F.coalesce("evidence", F.lit("")), F.lit(" "), plain)
    joined = signals.where(kind.isin(*KINDS)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "place", words.alias("w")))).alias("l"))
    said = F.lower(F.array_join(F.transform("l", lambda x: x["w"]), " "))
    third = joined.select(key, said.alias("said")).select(key, F.explode(_named([(F.col("said").rlike(p), names) for p, names in BY_ALL])).alias("factor"), F.lit(3).alias("by_pass"))
    every = given.select(key, "factor", F.lit(0).alias("by_pass")).unionByName(first).unionByName(second).unionByName(third)
    return every.where("factor IS NOT NULL").groupBy(key, "factor").agg(F.min("by_pass").alias("by_pass"))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) >= WORD))


def opportunities(catalogue: DataFrame, proposals: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """key, path (catalogue, verified, inferred), place, title, description, category, relevance, evidence, proposal.

    catalogue has key, place, title, challenge, category, relevance; proposals has key, place, title, description,
    service_line, claim_type, evidence, inferred_from; companies has key, content (what the model was shown) and is_thin.
    Path one: every catalogue entry, told by the first proposal that shares a word of WORD letters with its title. Of the
    proposals that no entry shares a word with first, and that name a confirmed service: path two, what is observed and
    whose quote is found in the content; path three, what is inferred from a basis of BASIS characters or more.
    """
    enough = companies.where(~F.coalesce("is_thin", F.lit(False))).select(key, "content")
    entries, offered = catalogue.join(enough.select(key), key), proposals.join(enough.select(key), key)
    words = lambda df, place: df.select(key, F.col("place").alias(place), F.explode(title_words(F.col("title"))).alias("word"))
    told = words(entries, "place").join(words(offered, "proposal"), [key, "word"]).groupBy(key, "place").agg(F.min("proposal").alias("proposal"))
    detail = offered.select(key, F.col("place").alias("proposal"), "description", "evidence")
    first = entries.join(told, [key, "place"], "left").join(detail, [key, "proposal"], "left").select(
        key, F.lit("catalogue").alias("path"), "place", "title", F.coalesce(F.nullif("description", F.lit("")), "challenge").alias("description"), "category", "relevance", "evidence", "proposal")
    taken = told.select(key, F.col("proposal").alias("place")).distinct()
    rest = offered.join(taken, [key, "place"], "left_anti").where(F.col("service_line").isin(*SERVICES))
    shaped = lambda rows, path, relevance: rows.select(key, F.lit(path).alias("path"), "place", "title", "description", F.col("service_line").alias("category"), relevance.alias("relevance"), "evidence", F.col("place").alias("proposal"))
    seen = rest.where("claim_type = 'observed'").join(enough, key).withColumn("tier", content.verify_quote(F.coalesce("evidence", F.lit("")), F.col("content"))).where("tier <> 'none'")
    second = shaped(seen, "verified", F.when(F.col("tier") == "exact", "Medium").otherwise("Low"))
    third = shaped(rest.where((F.col("claim_type") == "inferred") & (F.length(X.strip(F.coalesce("inferred_from", F.lit("")))) >= BASIS)), "inferred", F.lit("Low"))
    return first.unionByName(second).unionByName(third)
