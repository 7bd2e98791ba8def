"""Search results and pages as sources: type, strength, priority, tier, business model, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source types in order of precedence; where the pattern is looked for (u: url, t: title, b: both joined).
EXECUTIVE_CHANGE = r"appoints?\s+new\s+(ceo|cfo|coo|cto|md|president|managing director|chairman)|appointed\s+as\s+(ceo|cfo|coo|cto|president|md|managing director|chairman)|new\s+(ceo|cfo|coo|cto|md|president|managing director)\s+(announced|named|appointed)|steps?\s+down\s+as\s+(ceo|cfo|coo|cto|president|chairman)|resigns?\s+as\s+(ceo|cfo|coo|cto|president|chairman)|leadership\s+transition|management\s+change|names?\s+new\s+(ceo|cfo|coo|cto|president)|succeeds?\s+.{0,20}\s+as\s+(ceo|cfo|coo|cto|president)"
SOURCE_TYPES = (
    ("annual_report", "b", r"annual.?report|annual-report|annualreport"),
    ("investor_presentation", "b", r"investor.?presentation|investor-presentation|ir\.pdf"),
    ("earnings_release", "b", r"earnings.?release|earnings-release|quarterly.?results|q[1-4].{0,5}results"),
    ("earnings_call_transcript", "b", r"earnings.?call.?transcripts?|concall.?transcripts?|investor.?call.?transcripts?"),
    ("earnings_call_transcript", "tb", (r"\btranscripts?\b", r"earnings.?call|investor.?call|concall|conference.?call|quarterly")),
    ("executive_change_announcement", "b", EXECUTIVE_CHANGE),
    ("press_release", "b", r"press.?release|press-release|newsroom|news-release"),
    ("careers_page", "b", r"careers|jobs|hiring|vacancies|work-with-us|join-us"),
    ("official_blog", "b", r"blog|insights|perspectives|thought-leadership"),
    ("ceo_interview", "b", r"interview|ceo.?speak|md.?speak|chairman.?speak"),
    ("sustainability_report", "b", r"sustainability|esg|csr|environment-report"),
    ("investor_presentation", "u", r"investor|ir\.|shareholders|bse|nse|sec\.gov|bseindia|nseindia|moneycontrol"),
    ("careers_page", "u", r"linkedin\.com|glassdoor|naukri|indeed"),
    ("news_article", "u", r"reuters|bloomberg|economictimes|livemint|businessline|businesswire|prnewswire"),
)
# Strength and priority by source type.
SOURCE_VALUES = (
    ("annual_report", "very_high", 100), ("investor_presentation", "very_high", 95), ("earnings_release", "very_high", 90), ("earnings_call_transcript", "very_high", 88),
    ("executive_change_announcement", "high", 82), ("press_release", "high", 75), ("careers_page", "high", 70), ("ceo_interview", "high", 65), ("official_blog", "medium", 50),
    ("news_article", "medium", 45), ("sustainability_report", "medium", 40), ("corporate_website", "low", 20), ("regulatory_filing", "very_high", 98), ("other", "low", 10),
)
# Business models by what their descriptions hold, in order.
BUSINESS_MODELS = (
    ("Automotive OEM", r"automotive\s+oem|oem\s+manufacturer"),
    ("Automotive Supplier", r"automotive\s+supplier|tier\s*[12]|auto\s+component"),
    ("Conglomerate", r"conglomerate|diversified|multi.?business|holding"),
    ("Software/SaaS", r"software|saas|cloud\s+platform|technology\s+platform|platform\s+company"),
    ("Engineering Services", r"engineering\s+service|r&d\s+service|design\s+service|product\s+engineering|consulting"),
    ("Distribution/Logistics", r"distribution|logistics|supply\s+chain\s+company|3pl|freight"),
    ("Industrial Technology Vendor", r"industrial\s+tech|equipment\s+vendor|machine\s+builder|automation\s+vendor|robotics\s+company"),
    ("Manufacturing", r"manufactur|foundry|casting|stamping|forging|machining|fabricat"),
    ("Automotive Supplier", r"automotive"),
)
# Industry tags by content, and those that a company's type adds.
INDUSTRY_TAGS = (
    ("automotive", r"\b(?:dealership|dealer network|automotive|OEM|car manufactur\w+|vehicle)\b"),
    ("trading", r"\b(?:trading platform|brokerage|stock exchange|algorithmic trading|forex)\b"),
    ("fintech", r"\b(?:fintech|payment gateway|digital wallet|lending platform|\bnbfc\b)\b"),
    ("ecommerce", r"\b(?:e-?commerce|online marketplace|d2c brand|online store)\b"),
    ("media", r"\b(?:film production|storyboard|content production|media house|advertising agency)\b"),
    ("distribution", r"\b(?:distribut\w+\s+network|distributor|secondary sales)\b"),
)
TYPE_TAGS = (("manufacturer", ("manufacturing", "industrial")), ("industrial_vendor", ("manufacturing", "industrial")), ("financial_institution", ("fintech", "financial_institution")), ("logistics_operator", ("distribution", "supply-chain")), ("retailer", ("ecommerce", "retail")))
TIER1_PAGES = r"investor|annual.?report|earnings|press.?release|ir/|careers?|jobs?|leadership|board|executive"
TIER2_PAGES = r"blog|news|about|history|case.?stud|product|solution|documentation|docs/"


def source_type(url: Column, title: Column) -> Column:
    u, t = F.lower(url), F.lower(title)
    both, out = F.concat(u, t), F.lit(None).cast("string")
    for name, where, pattern in reversed(SOURCE_TYPES):
        fits = t.rlike(pattern[0]) & both.rlike(pattern[1]) if where == "tb" else (both if where == "b" else u).rlike(pattern)
        out = F.when(fits, name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def source_strength(kind: Column) -> Column:
    out = F.lit("low")
    for name, strength, _ in SOURCE_VALUES:
        out = F.when(kind == name, strength).otherwise(out)
    return out


def source_priority(kind: Column) -> Column:
    out = F.lit(10)
    for name, _, priority in SOURCE_VALUES:
        out = F.when(kind == name, priority).otherwise(out)
    return out


def page_tier(source_page: Column) -> Column:
    p = F.lower(F.coalesce(source_page, F.lit("")))
    return F.when(p.rlike(TIER1_PAGES), "tier1").when(p.rlike(TIER2_PAGES), "tier2").otherwise("tier3")


def is_fetchable(url: Column) -> Column:
    """Not behind a sign-in."""
    return ~F.contains(F.lower(url), F.lit("linkedin.com")) & ~F.contains(F.lower(url), F.lit("glassdoor.com"))


def business_model(text: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in BUSINESS_MODELS], F.lit("Other"))


def industry_tags(text: Column, company_types: Column) -> Column:
    """Tags by content and by company type (an array of type names), distinct, in fixed order."""
    found = [F.when(text.rlike("(?i)" + pattern), tag) for tag, pattern in INDUSTRY_TAGS]
    added = [F.when(F.array_contains(company_types, kind), tag) for kind, tags in TYPE_TAGS for tag in tags]
    return F.array_distinct(F.array_compact(F.array(*found, *added)))


def is_rate_limit(message: Column) -> Column:
    return message.rlike(r"\b429\b") | message.rlike("(?i)rate.?limit")


def is_json_like(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (F.length(t) >= 10) & F.contains(t, F.lit("{")) & F.contains(t, F.lit("}"))
