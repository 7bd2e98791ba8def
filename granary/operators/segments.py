"""Page and source segments of text blobs, and the leaders of a company that such segments name.

A blob marks pages by `--- PAGE: path (url) ---` lines and other sources by `[SOURCE: type | tier | url]` lines. A page
reaches to the next page mark, so the last page also holds the sources after it, which then come again as segments of
their own. Everything is built-in expressions over one row's text; claims of names are settled by grouping.

Defined results: null and blank blobs have no segment; a blob without any usable mark is one segment, its homepage;
segments without text are left out; repeated blobs count as they stand; columns beside the key and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import guards as G
from granary.functions import text as X
from granary.functions import url as U
from granary.functions.signal_rules import spark_pattern

# The marks of pages and sources, source types by label, leaders' titles and what leads to a portfolio.
PAGE_MARK = r"---\s*PAGE:"
PAGE_HEAD = r"\s*([^\n]+?)\s*---\n"
SOURCE_MARK = r"\[SOURCE:"
SOURCE_HEAD = r"\s*([^\n|]+)\|\s*(tier\d)\s*\|\s*([^\]]+)\]\s*\n"
SOURCE_PAGES = (("investor", r"annual.?report|investor|earnings"), ("careers", r"careers|jobs"), ("press", r"press.?release|newsroom|news.?article|ceo.?interview|blog"))
TITLES = (
    r"Chairman|Vice\s+Chairman|Managing\s+Director|Administrative\s+Director|Director|CEO|COO|CTO|CFO|President|Vice\s+President|VP|Head\s+of\s+[A-Za-z][A-Za-z &]{1,39}|Chief\s+[A-Za-z]+\s+Officer"
    r"|Geschäftsführer(?:in)?|Vorstandsvorsitzende(?:r)?|Vorstand|Direktor(?:in)?"
    r"|Directeur(?:\s+Général)?|Directrice(?:\s+Générale)?|Président(?:e)?|PDG"
    r"|Directora(?:\s+General)?|Presidente|Presidenta|Consejero\s+Delegado|Consejera\s+Delegada"
    r"|Amministratore\s+Delegato|Direttore\s+Generale|Direttrice\s+Generale"
    r"|Diretor(?:a)?(?:\s+Geral)?"
    r"|Algemeen\s+Directeur|Voorzitter|Bestuursvoorzitter"
)
HEADED = rf"#{{1,3}}\s*(\p{{Lu}}[^\n]{{2,50}})\n+\s*#{{0,4}}\s*({TITLES})\b"
PORTFOLIO = r"\b(?:heads?|headed|leads?|led|oversees?|oversaw|chairs?|chaired|manages?|managed)\s+(?:the\s+)?([A-Z][^.]{5,150}?)(?:\.|for\s+the\s+entire|$)"
BESIDE = rf"^[ \t]*[*#>\-]{{0,3}}[ \t]*(\p{{Lu}}[\p{{L}}'.-]+(?:\s+\p{{Lu}}[\p{{L}}'.-]+){{1,3}})[ \t]*[*_]{{0,2}}[ \t]*(?:\n+[ \t]*[*#>\-]{{0,3}}[ \t]*|[ \t]*[,|–—-][ \t]*)({TITLES})\b"
#: Characters after a title in which its holder's portfolio is looked for.
WITHIN = 700


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def source_page(label: Column) -> Column:
    """The page type that a source's label stands for."""
    out = F.lit("other")
    for name, pattern in reversed(SOURCE_PAGES):
        out = F.when(label.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def parsed(content: Column) -> Column:
    """Segments as an array of structs: url, path, text, page_type, tier."""
    bracket = r"\(([^)]+)\)"

    def whole_marks(mark, head):
        """Each mark with its head, and the stripped text up to the next mark, with a head or not; one cut each, no walk over every place."""
        heads = _all(content, mark + head, 0)
        rest = F.filter(F.split(content, mark + head), lambda _, i: i > 0)
        after = F.transform(rest, lambda x: X.strip(F.get(F.split(x, mark, 2), F.lit(0))))
        return F.arrays_zip(heads.alias("head"), after.alias("text"))

    page, source = "(?i)" + PAGE_MARK, "(?i)" + SOURCE_MARK

    def of_page(x):
        head = X.strip(F.regexp_extract(x["head"], f"^{page}{PAGE_HEAD}", 1))
        has = head.rlike(bracket)
        url = F.when(has, F.regexp_extract(head, bracket, 1)).otherwise(head)
        path = F.when(has, X.strip(F.regexp_extract(head, r"^([\s\S]*?)\([^)]+\)", 1))).otherwise(head)
        return F.struct(url.alias("url"), path.alias("path"), x["text"].alias("text"), U.page_type(path).alias("page_type"))

    def of_source(x):
        part = lambda k: F.regexp_extract(x["head"], f"^{source}{SOURCE_HEAD}", k)
        return F.struct(X.strip(part(3)).alias("url"), F.lit(None).cast("string").alias("path"), x["text"].alias("text"), source_page(X.strip(part(1))).alias("page_type"), F.right(part(2), F.lit(1)).cast("int").alias("tier"))

    pages = F.transform(F.transform(whole_marks(page, PAGE_HEAD), of_page), lambda s: F.struct(s["url"].alias("url"), s["path"].alias("path"), s["text"].alias("text"), s["page_type"].alias("page_type"), U.tier(s["page_type"]).alias("tier")))
    sources = F.transform(whole_marks(source, SOURCE_HEAD), of_source)
    found = F.filter(F.concat(pages, sources), lambda s: s["text"] != "")
    whole = F.array(F.struct(F.lit("").alias("url"), F.lit(None).cast("string").alias("path"), content.alias("text"), F.lit("homepage").alias("page_type"), F.lit(3).alias("tier")))
    return X.let(found, lambda f: F.when(F.size(f) > 0, f).when(X.strip(content) != "", whole))


def segments(blobs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, seg_no (from 0), url, path, text, page_type, tier of every blob's segments: pages first, then sources."""
    return blobs.select(key, F.posexplode(parsed(F.col(content))).alias("seg_no", "s")).select(key, "seg_no", "s.*")


def _first_claims(found: DataFrame, key: str, *fields: str) -> DataFrame:
    """Of each name's finds the first one."""
    return found.groupBy(key, "name").agg(F.min(F.struct("seg_no", "nth", *fields)).alias("x")).select(key, "name", *[f"x.{f}" for f in fields])


def _told(text: Column) -> Column:
    """Names with a title below them and what stands within WITHIN characters after it."""
    pattern = spark_pattern(HEADED).replace("(?i)", "", 1) + rf"(?=([\s\S]{{0,{WITHIN}}}))"
    return F.arrays_zip(*[_all(text, pattern, k).alias(n) for k, n in enumerate(("name", "title", "after"), 1)])


def _portfolio(after: Column) -> Column:
    return X.strip(F.regexp_extract(after, spark_pattern(PORTFOLIO).replace("|$)", r"|\z)"), 1))


def _beside(text: Column) -> Column:
    """Names right beside or above a title."""
    pattern = "(?m)" + spark_pattern(BESIDE).replace("(?i)", "", 1)
    return F.arrays_zip(*[_all(text, pattern, k).alias(n) for k, n in enumerate(("name", "title"), 1)])


def narrated_leaders(parts: DataFrame, key: str) -> DataFrame:
    """key, name, title, portfolio, url: a heading, a title below it and what its holder leads within WITHIN characters.

    A name counts once for each key: where it first stands with a portfolio.
    """
    rows = parts.where(F.col("text").rlike(r"#\s*\p{Lu}")).select(key, "seg_no", "url", F.posexplode(_told(F.col("text"))).alias("nth", "m"))
    found = rows.select(key, "seg_no", "nth", X.strip(F.col("m.name")).alias("name"), X.strip(F.col("m.title")).alias("title"), _portfolio(F.col("m.after")).alias("portfolio"), "url").where("portfolio <> ''")
    return _first_claims(found, key, "title", "portfolio", "url")


def placed_leaders(parts: DataFrame, key: str, taken: DataFrame | None = None) -> DataFrame:
    """key, name, title, url: a person's name right beside or above a title; names in taken (key, name) are left out."""
    rows = parts.select(key, "seg_no", "url", F.posexplode(_beside(F.col("text"))).alias("nth", "m"))
    found = rows.select(key, "seg_no", "nth", X.strip(F.col("m.name")).alias("name"), X.strip(F.col("m.title")).alias("title"), "url").where(G.is_person_name(F.col("name")))
    free = found if taken is None else found.join(taken.select(key, "name"), [key, "name"], "left_anti")
    return _first_claims(free, key, "title", "url")


def leaders(parts: DataFrame, key: str) -> DataFrame:
    """key, name, title, portfolio, url, confidence: narrated leaders are sure, those by their place alone are medium.

    Texts are read once: a name's first claim is the first narrated one, else the first by its place.
    """
    claim = lambda place: lambda m: F.struct(F.lit(place).alias("place"), m["name"].alias("name"), m["title"].alias("title"), (m["after"] if place == 0 else F.lit("")).alias("after"))
    each = F.concat(F.transform(_told(F.col("text")), claim(0)), F.transform(_beside(F.col("text")), claim(1)))
    rows = parts.select(key, "seg_no", "url", F.posexplode(each).alias("nth", "m"))
    found = rows.select(key, "seg_no", "nth", "url", "m.place", X.strip(F.col("m.name")).alias("name"), X.strip(F.col("m.title")).alias("title"), F.when(F.col("m.place") == 0, _portfolio(F.col("m.after"))).otherwise("").alias("portfolio"))
    kept = found.where(F.when(F.col("place") == 0, F.col("portfolio") != "").otherwise(G.is_person_name(F.col("name"))))
    first = kept.groupBy(key, "name").agg(F.min(F.struct("place", "seg_no", "nth", "title", "portfolio", "url")).alias("x"))
    return first.select(key, "name", "x.title", "x.portfolio", "x.url", F.when(F.col("x.place") == 0, "high").otherwise("medium").alias("confidence"))
