"""What a reader gets of a company: a summary of its signals, the bullets of a brief, and the brief as a page.

Each part is grouped by company first and then put together by expressions, so that a brief is one row and no company's
rows are gathered beyond the few that it shows.

Defined results: a company without signals, factors or themes has a brief without these lines; null quotes are empty;
ties keep the order of place; repeated places are ordered by name; HTML signs in texts are escaped on pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X

SHOWN, QUOTE, BULLET_QUOTE, THEMES_SHOWN, QUOTES_SHOWN = 12, 120, 110, 3, 2
# What a theme's name says, the offer that goes with it, and its value.
ENTRIES = (
    (r"industry.?4|smart.?factory|iiot|digital.?twin", "AI-Powered Smart Factory & IIoT", "real-time production intelligence across lines and plants"),
    (r"digital.?transform|erp|sap|oracle|mes", "Digital Operations Platform", "accelerating ERP/MES data into actionable decisions"),
    (r"automat|robot", "Intelligent Automation & Robotics Integration", "end-to-end process automation with AI quality gates"),
    (r"ai|machine.?learn|ml", "AI Strategy & Deployment", "production-grade AI from pilot to scale"),
    (r"capac|expan|new.?plant|greenfield|facilit", "Scalable Operations Intelligence", "unified intelligence platform ready for multi-site rollout"),
    (r"hir|talent|workforce", "AI Workforce Enablement", "reducing hiring pressure with intelligent process automation"),
    (r"supply.?chain|procure|logistic", "Supply Chain Intelligence", "AI-driven procurement and vendor risk management"),
    (r"quality|compliance|certif", "AI Quality Management", "defect detection and compliance automation at line speed"),
    (r"sustain|esg|environment", "Sustainability Intelligence Platform", "AI-powered ESG tracking and carbon footprint optimization"),
)


def shortened(quote: Column, most: int, kept: int) -> Column:
    """Quotes of more than `most` characters end after `kept` of them."""
    plain = F.coalesce(quote, F.lit(""))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, kept), F.lit("…"))).otherwise(plain)


def _lines(rows: DataFrame, key: str, order: list[str], line: Column, most: int | None = None) -> DataFrame:
    """key, lines (in order, the first `most`), n of all."""
    ranked = rows.select(key, line.alias("line"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("nth"))
    kept = F.lit(True) if most is None else F.col("nth") <= most
    ordered = F.array_sort(F.collect_list(F.when(kept, F.struct("nth", "line"))))
    return ranked.groupBy(key).agg(F.transform(ordered, lambda x: x["line"]).alias("lines"), F.count("*").alias("n"))


def summaries(profiles: DataFrame, signals: DataFrame, factors: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """key, summary: profile, signals (SHOWN), factors and offers as lines of text.

    profiles has key, types (array) and primary_type; signals key, place, signal, strength, best_quote; factors key and
    factor; drafts key, place, service, fit, confidence.
    """
    said = _lines(signals, key, ["place", "signal"], F.concat(F.lit("  ["), "strength", F.lit("] "), "signal", F.lit(' — "'), shortened(F.col("best_quote"), QUOTE, QUOTE), F.lit('"')), SHOWN)
    named = factors.select(key, "factor").distinct().groupBy(key).agg(F.array_sort(F.collect_list("factor")).alias("factors"))
    offers = _lines(drafts, key, ["place", "service"], F.concat(F.lit("  "), "service", F.lit(" [fit:"), "fit", F.lit(" | confidence:"), "confidence", F.lit("]")))
    rows = profiles.select(key, "types", "primary_type").join(said.withColumnsRenamed({"lines": "said", "n": "n_signals"}), key, "left").join(named, key, "left").join(offers.select(key, F.col("lines").alias("offers")), key, "left")
    types = F.when(F.size("types") > 0, F.array_join("types", ", ")).otherwise("unknown")
    part = lambda holds, text: F.when(holds.isNotNull(), text)
    return rows.select(key, F.concat_ws("\n", F.concat(F.lit("COMPANY PROFILE: "), types, F.lit(" | primary: "), "primary_type"), part(F.col("said"), F.concat(F.lit("\nSIGNALS ("), F.col("n_signals").cast("string"), F.lit("):"))), F.array_join("said", "\n"),
                                        part(F.col("factors"), F.concat(F.lit("\nFACTORS: "), F.array_join("factors", ", "))), part(F.col("offers"), F.lit("\nOPPORTUNITY CANDIDATES:")), F.array_join("offers", "\n")).alias("summary"))


def theme_bullet(name: Column, theme: Column, first_signal: Column, vendor: str) -> Column:
    """The sentence on a theme: the offer of the first entry whose pattern its name meets, or one on its first signal."""
    told = [F.when(theme.rlike("(?i)" + p), F.concat(name, F.lit(" shows active "), theme, F.lit(f" — {vendor} delivers {offer}: {angle}."))) for p, offer, angle in ENTRIES]
    return F.coalesce(*told, F.concat(name, F.lit(" has confirmed "), F.coalesce(first_signal, theme), F.lit(f" activity — {vendor} can accelerate with targeted AI/automation solutions.")))


def bullets(companies: DataFrame, themes: DataFrame, signals: DataFrame, key: str, vendor: str = "our team") -> DataFrame:
    """key, observed (array): THEMES_SHOWN themes, the surest first, then QUOTES_SHOWN quotes of the company's own signals.

    companies has key and name; themes key, place, theme, confidence, signals (array); signals key, place, best_quote, is_own.
    """
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(3)
    told = _lines(themes.join(companies.select(key, "name"), key).withColumn("rank", rank), key, ["rank", "place"], theme_bullet(F.col("name"), F.col("theme"), F.get("signals", F.lit(0)), vendor), THEMES_SHOWN)
    quoted = _lines(signals.where("is_own"), key, ["place", "signal"], F.concat(F.lit('Evidence: "'), shortened(F.col("best_quote"), BULLET_QUOTE, BULLET_QUOTE - 3), F.lit('"')), QUOTES_SHOWN)
    none = F.array().cast("array<string>")
    both = companies.select(key).join(told.select(key, F.col("lines").alias("a")), key, "left").join(quoted.select(key, F.col("lines").alias("b")), key, "left")
    return both.select(key, F.concat(F.coalesce("a", none), F.coalesce("b", none)).alias("observed"))


def page(name: Column, observed: Column, offer: Column) -> Column:
    """A brief as an HTML page."""
    items = F.array_join(F.transform(observed, lambda x: F.concat(F.lit("<li>"), X.html_escape(x), F.lit("</li>"))), "")
    return F.concat(F.lit("<!doctype html><html><head><meta charset=\"utf-8\"><title>"), X.html_escape(name), F.lit("</title></head><body><h1>"), X.html_escape(name), F.lit("</h1><h2>What we observed</h2><ul>"), items, F.lit("</ul><h2>What to offer</h2><p>"), X.html_escape(offer), F.lit("</p></body></html>"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (name, html) below a path, one JSON line each under the slug of the name that a file would have."""
    pages.select(F.concat(X.slug(F.col("name")), F.lit(".html")).alias("file"), "html").write.mode("overwrite").json(path)
