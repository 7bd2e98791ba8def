"""URL columns: parts, keyword classes and tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.signal_rules import PAGE_TYPES

# URL categories in order of precedence, with score and keywords.
CATEGORIES = (
    ("investor", 100, ("investor", "investors", "investor-relations", "ir", "annual-report", "annual_report", "annualreport", "earnings", "quarterly-results", "financial-results", "shareholder", "bse", "nse", "sec", "sebi")),
    ("leadership", 95, ("leadership", "leadership-team", "management-team", "senior-management", "executive-team", "our-team", "meet-the-team", "meet-our-team", "core-team", "board-of-directors", "board-members", "management", "board", "governance", "executive", "executives", "chairman", "md-speak", "directors", "founders", "ceo")),
    ("corporate", 90, ("about", "about-us", "aboutus", "who-we-are", "our-story", "company", "corporate", "overview", "history", "values", "mission")),
    ("manufacturing", 85, ("manufactur", "operations", "facilities", "plant", "factory", "production", "assembly", "capacity", "supply-chain", "quality", "engineering", "r-and-d", "r&d", "research")),
    ("sustainability", 80, ("sustainability", "esg", "csr", "environment", "climate", "green", "carbon", "net-zero", "social-responsibility")),
    ("careers", 75, ("career", "careers", "jobs", "hiring", "join-us", "join", "vacancies", "work-with-us", "life-at", "people", "team", "talent")),
    ("technology", 70, ("technology", "technolog", "innovation", "digital", "automat", "software", "platform", "industry-4", "iiot", "smart-manufactur", "ai", "data")),
    ("media", 65, ("news", "newsroom", "press", "press-release", "media", "blog", "insights", "announcement", "update", "event", "resource")),
    ("b2b_services", 75, ("solutions", "services", "industries", "industry", "application", "capabilities", "expertise", "sectors", "portfolio", "warranty", "partner")),
    ("product", 20, ("product", "model", "vehicle", "car", "truck", "suv", "sedan", "hatchback", "brezza", "alto", "swift", "baleno", "arena", "arenaworld", "nexa", "nexaworld", "configure", "compare-cars")),
    ("dealer", 10, ("dealer", "showroom", "dealership", "locate-dealer", "book-test-drive", "test-drive", "service-center", "book-service", "service-appointment", "exchange", "emi", "finance", "insurance", "accessories")),
)
ARTICLE_SCORE, OTHER_SCORE = 15, 30
ARTICLE_FOLDERS = "blog|news|press|media|event|insight|update|announcement|resource"
SUB_INDEXES = ("press-releases", "press_releases", "videos", "video", "photos", "photo", "gallery", "archive", "archives", "categories", "category", "tags", "tag", "all", "latest", "page", "en", "hi", "mr")
LOCALE_PENALTY, LOCALE_REPEAT = 40, 3
SHORT_KEYWORDS = tuple(k for _, _, words in CATEGORIES for k in words if len(k) <= 3)


def scheme_rest(url: Column) -> Column:
    return F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def host(url: Column) -> Column:
    """Host in lower case without `www.`."""
    return F.regexp_replace(F.lower(F.regexp_extract(scheme_rest(url), r"^([^/?#:]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(scheme_rest(url), r"^[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def segments(path_: Column) -> Column:
    return F.filter(F.split(F.lower(path_), "/"), lambda s: s != "")


def keyword_pattern(words: tuple[str, ...]) -> str:
    """One alternation for a category: short words between separators, long ones anywhere."""
    short = [w for w in words if len(w) <= 3]
    parts = [w.replace("&", "[&]") for w in words if len(w) > 3]
    if short:
        parts.append(r"(^|[-_/.])(" + "|".join(w.replace("&", "[&]") for w in short) + r")([-_/.]|$)")
    return "|".join(parts)


def is_article(path_: Column) -> Column:
    """A page below a content folder that is neither an index nor a year."""
    s = segments(path_)
    second = F.element_at(s, 2)
    return F.when(F.size(s) < 2, False).otherwise(F.element_at(s, 1).rlike(ARTICLE_FOLDERS) & ~second.isin(*SUB_INDEXES) & ~second.rlike(r"^\d{4}$"))


def category(path_: Column) -> Column:
    out, low = F.lit("other"), F.lower(path_)
    for name, _, words in reversed(CATEGORIES):
        said = F.when(is_article(path_), "article").otherwise(name) if name == "media" else F.lit(name)
        out = F.when(low.rlike(keyword_pattern(words)), said).otherwise(out)
    return out


def category_score(name: Column) -> Column:
    out = F.when(name == "article", ARTICLE_SCORE)
    for category_name, score, _ in CATEGORIES:
        out = out.when(name == category_name, score)
    return out.otherwise(OTHER_SCORE)


def is_english_locale(segment: Column) -> Column:
    return (segment == "en") | segment.endswith("-en")


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_domain_like(text: Column) -> Column:
    t = F.trim(text)
    return ~t.rlike(r"\s") & F.lower(t).rlike(r"^(https?://)?([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(/.*)?$")


def join_url(base: Column, tail: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(tail, "^/+", ""))


def page_type(path_: Column) -> Column:
    """Type of a page by its path, first rule first; an empty or missing path is the homepage."""
    low = F.lower(F.coalesce(path_, F.lit("")))
    out = F.when(low == "", "homepage")
    for name, pattern in PAGE_TYPES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def tier(page_type_: Column) -> Column:
    return F.when(page_type_.isin("careers", "investor", "annual_report", "press"), 1).when(page_type_.isin("about", "blog"), 2).otherwise(3)


# Platforms whose path names the site, consumer-site patterns, file types, probe paths, other hosts.
HOSTED_PLATFORMS = ("sites.google.com", "github.io", "webflow.io", "wixsite.com", "squarespace.com", "cargo.site", "weebly.com", "wordpress.com", "blogspot.com")
B2C_CONTENT = (r"test\s+drive", r"find\s+a\s+dealer", r"build\s+your\s+(car|vehicle|truck)", r"schedule\s+service", r"book\s+a?\s*(test\s+drive|showroom|service)", r"compare\s+(cars|models|vehicles)", r"certified\s+pre-?owned", r"financing\s+options", r"monthly\s+payment", r"msrp", r"starting\s+at\s+\$[\d,]+", r"locate\s+a?\s*dealer")
B2C_LINKS = ("/arena/", "/nexa/", "/arenaworld/", "test-drive", "book-showroom", "book-a-test", "locate-dealer", "find-dealer", "/configure", "compare-cars", "book-service", "service-appointment")
B2C_CATEGORIES = ("investor", "leadership", "corporate", "manufacturing", "sustainability", "careers", "technology", "media")
ASSETS = r"(?i)\.(pdf|docx|xlsx|zip|jpg|jpeg|png|gif|svg|mp4|webp)$"
UNIVERSAL_PATHS = ("/about/", "/about-us/", "/company/", "/who-we-are/", "/leadership/", "/management/", "/team/", "/industries/", "/solutions/", "/services/", "/products/", "/capabilities/", "/operations/", "/manufacturing/", "/technology/", "/innovation/", "/careers/", "/sustainability/", "/newsroom/", "/csr/")
NON_CORPORATE = (r"\.gov$", r"\.gov\.[a-z]{2,3}$", r"\.mil$", r"\.edu$", r"(?:^|\.)wikipedia\.org$", r"(?:^|\.)wikimedia\.org$", r"(?:^|\.)miraheze\.org$", r"(?:^|\.)fandom\.com$", r"(?:^|\.)wikia\.org$", r"(?:^|\.)crunchbase\.com$", r"(?:^|\.)linkedin\.com$", r"(?:^|\.)glassdoor\.com$", r"(?:^|\.)indeed\.com$", r"(?:^|\.)g2\.com$", r"(?:^|\.)capterra\.com$")


def normalised(raw: Column) -> Column:
    """The URL's origin (with its path on hosted platforms), or null if it names no public web site."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    url = F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t))
    authority = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    name = F.regexp_replace(authority, r":\d+$", "")
    refused = (t == "") | t.rlike(r"\s") | (t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & ~t.rlike("^https?://")) | name.isin("localhost", "127.0.0.1", "::1") | name.endswith(".local") | name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | ~F.contains(name, F.lit("."))
    origin = F.concat(F.regexp_extract(url, "^(https?://)", 1), authority)
    hosted = F.lit(False)
    for platform in HOSTED_PLATFORMS:
        hosted = hosted | F.contains(name, F.lit(platform))
    whole = F.regexp_replace(F.concat(origin, F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)), "/$", "")
    return F.when(~F.coalesce(refused, F.lit(True)), F.when(hosted, whole).otherwise(origin))


def domain_by_split(text: Column) -> Column:
    """The string variant: what stands before the first slash, ports and queries included."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), "^https?://", ""), r"^www\.", "")
    return F.element_at(F.split(bare, "/"), 1)


def links_of_site(url: Column, site: Column) -> Column:
    """The canonical form of a link to a page of the same site, or null for other sites, roots, assets, deep and dated paths."""
    p = path(url)
    other = (host(url) != site) | (p == "/") | p.rlike(ASSETS) | (F.size(F.filter(F.split(p, "/"), lambda x: x != "")) > 5) | p.rlike(r"/\d{4}/\d{2}")
    return F.when(~other, F.regexp_replace(F.concat(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1), p), "/$", ""))


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text holds, in any case."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike("(?i)" + pattern).cast("int")
    return total


def is_non_corporate(domain: Column) -> Column:
    return domain.rlike("(?i)" + "|".join(NON_CORPORATE))


def discovery_method(mapped: Column, in_sitemap: Column, links: Column) -> Column:
    """How a site's pages were found: its map, a sitemap of more than three pages, its links, or the homepage alone."""
    return F.when(mapped > 0, "map_url").when(in_sitemap > 3, "sitemap").when(links > 0, "links").otherwise("homepage")


def needs_probe(high_value: Column, categories: Column) -> Column:
    """Whether paths are probed: fewer than four pages of value, or fewer than three categories."""
    return (high_value < 4) | (categories < 3)

# Paths at which companies keep what their sitemaps leave out.
CORPORATE_PATHS = ("/corporate", "/about", "/about-us", "/company", "/who-we-are", "/corporate/investors", "/corporate/investor-relations", "/investor-relations", "/investors", "/ir", "/annual-report", "/corporate/annual-report", "/corporate/financials", "/corporate/about-us", "/corporate/history", "/corporate/leadership", "/corporate/management", "/leadership", "/sustainability", "/corporate/sustainability", "/esg", "/csr", "/manufacturing", "/corporate/manufacturing", "/operations", "/facilities", "/technology", "/corporate/technology", "/innovation", "/digital", "/careers", "/corporate/careers", "/jobs", "/newsroom", "/corporate/newsroom", "/press-releases", "/media")
