"""Names, counts and blocks out of running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import guards as G
from granary.functions import text as X
from granary.functions.signal_rules import spark_pattern

# What begins a list of competitors, proper nouns, title prefixes, number words.
LIST_TRIGGER = r"\b(?:top\s+)?competitors?(?:\s+(?:of|to|include|including|are))?\b|\balternatives?(?:\s+(?:to|include|including|are))?\b|\brivals?(?:\s+(?:include|including|are))?\b|\bcompetes?\s+with\b"
PROPER_NOUN = r"\b[A-Z][a-zA-Z0-9&.'-]*(?:\s+[A-Z][a-zA-Z0-9&.'-]*){0,3}\b"
TITLE_PREFIX = r"^([A-Z][A-Za-z0-9_&.,']*(?:\s+[A-Z&][A-Za-z0-9_&.,']*){0,4})\s*[:|]\s+\S"
LISTICLE = r"(?i)\b(?:top|best|leading|competitors?|alternatives?|rivals?)\b|\bmarket\s+(?:size|share|growth|report|outlook|forecast)\b|\bindustry\s+report\b"
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
PLANTS = r"\s+manufacturing\s+(?:facilit|plant|unit)"
RESPONSIBILITIES = r"(?i)\b(?:key\s+)?respons\w*\s*:?"
AFTER_TRIGGER, JOB_BLOCK, LEAST_BLOCK = 200, 400, 60
# What begins a list of customer segments, words left over after it, names whose `and` is no separator, boilerplate.
SEGMENT_TRIGGER = r"\b(?:industries|sectors|verticals)\s+(?:we\s+serve|served|include[sd]?|including|are|across|spanning)\b|\b(?:clients?|customers?)\s+(?:include[sd]?|including|across|are|range\s+from)\b|\bserving\s+(?:the\s+)?"
LEFTOVER = r"^\s*(?:include[sd]?|including|are|range\s+from|across|spanning|of|[:\-])\s*"
IDIOMS = ("oil and gas", "food and beverage", "textile and apparel", "iron and steel", "pulp and paper", "health and wellness", "travel and tourism", "media and entertainment", "sales and marketing", "research and development", "arts and crafts", "hotels and resorts")
ADDRESS = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
BOILERPLATE = r"©|all rights reserved"
ITEM_WORDS, ITEMS = 6, 8
# What begins a company's own offerings, and words left over after it.
OFFERING_TRIGGER = r"\bwe\s+are\s+a\s+(?:leading\s+)?(?:provider|manufacturer|developer|designer|supplier)\s+of\b|\bwe\s+(?:offer|provide|specialize\s+in|deliver|design|manufacture)\b|\bour\s+(?:core\s+)?(?:services?|solutions?|products?|offerings?)\s+include\b"
OFFERING_LEFTOVER = r"^\s*(?:of|for|include[sd]?|including|are|is|:|-)\s*"
OFFERING_CHARS, OFFERING_SIZES, OFFERINGS = 160, (4, 140), 8


def _begins(letters: str) -> str:
    """A cheap test before a pattern whose alternatives all begin a word with one of these letters."""
    return rf"(?i)(?=[{letters}])(?<!\w)"


def listed_names(text: Column) -> Column:
    """Proper nouns of 3 to 60 characters between a list trigger and the end of its sentence."""
    after = F.regexp_extract(text, rf"(?i:{LIST_TRIGGER})(?s:(.{{0,{AFTER_TRIGGER}}}))", 1)
    window = F.regexp_extract(after, r"^[^.!?]*", 0)
    return F.filter(F.regexp_extract_all(window, F.lit(f"({PROPER_NOUN})"), F.lit(1)), lambda n: F.length(n).between(3, 60))


def title_name(title: Column) -> Column:
    """The name before a colon or bar, unless it belongs to a list or a report."""
    name = F.regexp_extract(X.strip(title), TITLE_PREFIX, 1)
    return F.when(F.length(name).between(3, 60) & ~name.rlike(LISTICLE), name)


def plant_count(text: Column) -> Column:
    """Manufacturing plants by the first number in digits, else by the first number word."""
    digits = F.regexp_extract(text, rf"(?i)(\d+){PLANTS}", 1).try_cast("int")
    word = F.lower(F.regexp_extract(text, rf"(?i)\b({'|'.join(NUMBER_WORDS)}){PLANTS}", 1))
    return F.coalesce(digits, F.nullif(F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), word).cast("int"), F.lit(0)))


def country_count(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)(\d+)\+?\s+countr", 1).try_cast("int")


def job_block(text: Column) -> Column:
    """The 400 characters after the first heading on responsibilities, on one line; null below 60."""
    block = X.squeeze(F.regexp_extract(text, rf"{RESPONSIBILITIES}(?s:(.{{0,{JOB_BLOCK}}}))", 1))
    return F.when(F.length(block) >= LEAST_BLOCK, block)


def split_list(window: Column) -> Column:
    """The parts of an inline list, between commas, semicolons, `&` and `and`; the `and` of an idiom parts nothing.

    It is masked by a sign in its middle until the list is split.
    """
    masked = window
    for idiom in IDIOMS:
        first, last = idiom.split(" and ")
        masked = F.regexp_replace(masked, spark_pattern(rf"\b({first}\s+a)(nd\s+{last})\b"), "$1\u0001$2")
    parts = F.transform(F.split(masked, spark_pattern(r",|;|\band\b|&")), lambda s: X.strip(F.regexp_replace(s, r"(?i)^(?:the|a|an)\s+", "")))
    return F.transform(parts, lambda s: F.replace(s, F.lit("\u0001")))


def heading_list(text: Column) -> Column:
    """The short sentences after a heading, up to the first one of many words or of boilerplate, ITEMS at most."""
    items = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: X.strip(s)), lambda s: s != "")

    def first(items):
        ends = F.array_position(F.transform(items, lambda s: s.rlike("(?i)" + BOILERPLATE) | (F.size(F.split(s, r"\s+")) > ITEM_WORDS)), True)
        return F.slice(items, F.lit(1), F.when(ends > 0, F.least(ends.cast("int") - 1, F.lit(ITEMS))).otherwise(ITEMS))

    return X.let(items, first)


def segment_list(text: Column) -> Column:
    """Customer segments named after the first trigger, of 3 to 50 characters; null texts name none.

    Where a full stop follows the trigger at once it was a heading, and each item is a sentence of its own; else the list
    stands inside the trigger's sentence. Mail addresses, whose dots end no sentence, go first.
    """
    raw = F.regexp_extract(F.coalesce(text, F.lit("")), _begins("ivsc") + spark_pattern(f"(?:{SEGMENT_TRIGGER})") + rf"([\s\S]{{0,{AFTER_TRIGGER}}})", 1)
    after = F.regexp_replace(raw, spark_pattern(ADDRESS), " ")
    lead = r"^\s*[.!?]+\s*"
    inline = lambda a: F.regexp_replace(F.regexp_extract(a, r"^[^.!?]*", 0), "(?i)" + LEFTOVER, "")
    found = X.let(after, lambda a: F.when(a.rlike(lead), heading_list(F.regexp_replace(a, lead, ""))).otherwise(split_list(inline(a))))
    return F.filter(found, lambda s: F.length(s).between(3, 50))


def offerings(text: Column) -> Column:
    """What a company says it sells: the rest of the sentence after each trigger, of 4 to 140 characters, fragments left out.

    Of the first 16 the first of each kind stays, 8 at most. Windows may overlap: what follows a trigger is only looked at.
    """
    pattern = _begins("wo") + spark_pattern(f"(?:{OFFERING_TRIGGER})") + rf"(?=([\s\S]{{0,{OFFERING_CHARS}}}))"
    windows = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda a: X.strip(F.regexp_replace(F.regexp_extract(a, r"^[^.!?\n]*", 0), "(?i)" + OFFERING_LEFTOVER, "")))
    raw = F.slice(F.filter(windows, lambda w: F.length(w).between(*OFFERING_SIZES) & ~G.is_fragment(w)), 1, 2 * OFFERINGS)
    keyed = F.filter(F.transform(raw, lambda w: F.struct(X.strip(F.regexp_replace(F.regexp_replace(F.lower(w), r"[^A-Za-z0-9_\s-]", " "), r"\s+", " ")).alias("k"), w.alias("w"))), lambda x: x["k"] != "")
    once = X.let(keyed, lambda all_: X.let(F.transform(all_, lambda x: x["k"]), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, x["k"]) == i + 1)))
    return F.slice(F.transform(once, lambda x: x["w"]), 1, OFFERINGS)
