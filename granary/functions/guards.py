"""Guards on extracted names and statements: why a candidate isn't kept, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as X

# Words that begin a fragment, words that are no name by themselves, and names of directories.
FRAGMENT_STARTERS = ("as", "at", "in", "on", "for", "with", "from", "to", "by", "of", "some", "into", "about", "under", "over", "through", "while", "when", "if", "because", "that", "which", "who", "whom", "than", "and", "but", "or")
COMPETITOR_STOPWORDS = ("the", "a", "an", "and", "or", "for", "vs", "top", "best", "list", "guide", "review", "comparison", "how", "what", "why", "in", "of", "to", "with", "by", "is", "are", "this", "that", "these", "those", "you", "your", "alternative", "alternatives", "competitor", "competitors", "rival", "rivals")
COMPANY_STOPWORDS = ("the", "a", "an", "and", "or", "for", "top", "best", "list", "guide", "review", "in", "of", "to", "with", "by", "is", "are", "this", "that", "these", "those", "you", "your", "other", "others", "companies", "company", "businesses", "firms", "players", "vendors")
NON_COMPETITOR_NAMES = ("G2", "Capterra", "TrustRadius", "Crunchbase", "SimilarWeb", "Gartner", "Wikipedia", "LinkedIn", "Glassdoor", "Indeed", "YouTube", "Facebook", "Twitter", "Instagram", "Reuters", "Bloomberg", "Forbes", "BusinessWire", "PRNewswire", "ISO", "BSI", "UL", "SGS", "TUV", "Moneycontrol")
NON_COMPANY_NAMES = ("G2", "Capterra", "TrustRadius", "Crunchbase", "SimilarWeb", "Gartner", "Wikipedia", "LinkedIn", "Glassdoor", "Indeed", "YouTube", "Facebook", "Twitter", "Instagram", "Reuters", "Bloomberg", "Forbes", "BusinessWire", "PRNewswire", "Clutch", "Google", "Yelp", "Medium", "Quora", "Reddit")
COMMON_NON_COMPANY_WORDS = ("launched", "featured", "related", "included", "available", "located", "based", "certified", "approved", "listed", "updated", "released", "established", "rated", "ranked", "reviewed", "compared", "recommended", "trusted", "verified", "sponsored", "presented", "provided", "offered", "designed", "manufactured", "supplied", "delivered", "required", "shown")
GENERIC_SEGMENT_TERMS = ("clients", "customers", "companies", "businesses", "organizations", "industries", "sectors", "verticals", "markets", "partners", "users", "them", "us", "you", "various", "multiple", "several", "many", "others", "products", "services", "solutions", "the world", "the globe", "worldwide", "our", "their", "its", "your", "my", "his", "her")
NON_NAME_WORDS = ("quality", "control", "sales", "marketing", "human", "resources", "customer", "service", "product", "business", "development", "technical", "information", "data", "global", "regional", "national", "corporate", "group", "team", "department", "division", "project", "client", "account", "accounts", "operations", "finance", "legal", "supply", "chain", "brand", "digital", "strategy", "strategic", "research", "engineering", "design", "creative", "general", "senior", "junior", "assistant", "associate", "deputy", "area", "field", "plant", "facility", "site", "unit")
RELATIONSHIPS = (
    ("customer", r"\bcustomers?\s+(include|of|are)\b"),
    ("supplier", r"\bsuppliers?\s+(to|of|for)\b"),
    ("certifier", r"\bcertified\s+by\b|\bcertification\s+(body|authority)\b"),
    ("association", r"\bmember\s+of\b|\bindustry\s+association\b|\bindustry\s+body\b"),
    ("partner", r"\bpartner(ed|ship)?\s+with\b"),
)
REVENUE = r"(?i)(?:US\$|USD|\$)\s?(\d+(?:\.\d+)?)\s*(?:billion|bn)\b"
MILLION_EMPLOYEES = r"(?i)(\d+(?:\.\d+)?)\s*million\s+employees\b"
EMPLOYEES = r"(?i)([\d,]{5,})\+?\s*employees\b"
MEGA_PHRASE = r"(?i)\bFortune\s?(?:50|100|500|1000)\b|\bGlobal\s?(?:500|2000)\b|\bone of the world'?s largest\b|\bmultinational conglomerate\b"
REVENUE_BILLIONS, MANY_EMPLOYEES = 10, 50_000
QUOTA_SIGNATURES = ("insufficient credit", "exceeds your plan", "quota exceeded", "rate limit", r"\b429\b", r"\b432\b")
CLAUSE_BREAK = r"(?i)\b(that|which|for|to)\b"


def named_pattern(names: tuple[str, ...]) -> str:
    return r"(?i)\b(" + "|".join(names) + r")\b"


def words_of(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def all_in(words: Column, stop: tuple[str, ...]) -> Column:
    return F.forall(words, lambda w: w.isin(*stop))


def segment_key(name: Column) -> Column:
    """Letters, digits, `&` and hyphens in lower case."""
    return X.squeeze(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s&-]", " "))


def is_fragment(name: Column) -> Column:
    """Empty, an asset name with dimensions, or a phrase that begins with a function word."""
    trimmed = X.strip(name)
    first = F.regexp_replace(F.lower(F.element_at(F.split(trimmed, r"\s+"), 1)), r"[^\p{L}\p{N}]", "")
    return (trimmed == "") | trimmed.rlike(r"(?i)\b\d{1,4}x\d{1,4}\b") | first.isin(*FRAGMENT_STARTERS)


def competitor_rejection(name: Column, key: Column, is_self: Column, snippets: Column) -> Column:
    """self, directory, fragment, short, stopwords, or the relationship that the snippets state; key is the name's key."""
    out = (F.when(is_self, "self").when(name.rlike(named_pattern(NON_COMPETITOR_NAMES)), "directory").when(is_fragment(name), "fragment")
           .when(F.length(key) < 3, "short").when(all_in(words_of(key), COMPETITOR_STOPWORDS), "stopwords"))
    for reason, pattern in RELATIONSHIPS:
        out = out.when(snippets.rlike("(?i)" + pattern), reason)
    return out


def segment_rejection(name: Column, is_self: Column) -> Column:
    key = segment_key(name)
    return (F.when(is_self, "self").when(is_fragment(name), "fragment").when(F.length(key) < 3, "short")
            .when(key.isin(*GENERIC_SEGMENT_TERMS), "generic").when(all_in(words_of(key), GENERIC_SEGMENT_TERMS), "generic phrase"))


def company_rejection(name: Column, key: Column, is_self: Column) -> Column:
    words = words_of(key)
    return (F.when(is_self, "self").when(name.rlike(named_pattern(NON_COMPANY_NAMES)), "directory").when(F.length(key) < 3, "short")
            .when(all_in(words, COMPANY_STOPWORDS), "stopwords").when((F.size(words) == 1) & F.element_at(words, 1).isin(*COMMON_NON_COMPANY_WORDS), "common word"))


def is_person_name(phrase: Column) -> Column:
    """Two to four words, none of them a role or department."""
    words = F.split(X.strip(phrase), r"\s+")
    return F.size(words).between(2, 4) & ~F.exists(words, lambda w: F.lower(w).isin(*NON_NAME_WORDS))


def size_mismatch(text: Column) -> Column:
    """What shows a company to be too large: revenue, employees, or a phrase; null otherwise."""
    number = lambda pattern: F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    return (F.when(number(REVENUE) >= REVENUE_BILLIONS, "revenue").when(text.rlike(MILLION_EMPLOYEES), "million employees")
            .when(number(EMPLOYEES) >= MANY_EMPLOYEES, "employees").when(text.rlike(MEGA_PHRASE), "phrase"))


def quota_signature(haystacks: Column) -> Column:
    """The first text in an array that holds a quota or rate-limit message."""
    pattern = "(?i)" + "|".join(QUOTA_SIGNATURES)
    return F.try_element_at(F.filter(haystacks, lambda x: x.rlike(pattern)), F.lit(1))


def query_phrase(offering: Column, most: int = 6) -> Column:
    """The words before the first that/which/for/to (after the ninth character), at most so many."""
    at = F.regexp_instr(offering, F.lit(CLAUSE_BREAK))
    clipped = F.when(at > 9, F.substr(offering, F.lit(1), at - 1)).otherwise(offering)
    return F.regexp_replace(F.array_join(F.slice(F.split(X.strip(clipped), r"\s+"), 1, most), " "), "[,;:]+$", "")
