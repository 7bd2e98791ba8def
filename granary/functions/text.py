"""Text columns: normalisers, windows, extraction and coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.signal_rules import spark_pattern

# Legal suffixes that names lose.
LEGAL = "inc|llc|ltd|limited|corp|corporation|co|company|pvt|plc|gmbh"


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, of) -> Column:
    """of(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def name_key(name: Column) -> Column:
    """Unicode letters and digits, lower case, without legal suffixes."""
    bare = F.regexp_replace(F.lower(name), rf"(^|[^\p{{L}}\p{{N}}])({LEGAL})(?=[^\p{{L}}\p{{N}}]|$)", "$1")
    return squeeze(F.regexp_replace(bare, r"[^\p{L}\p{N}\s-]", ""))


def ascii_name_key(name: Column) -> Column:
    """As name_key, but what isn't an ASCII word character becomes a space."""
    bare = F.regexp_replace(F.lower(name), rf"(^|[^A-Za-z0-9_])({LEGAL})(?=[^A-Za-z0-9_]|$)", "$1")
    return squeeze(F.regexp_replace(bare, r"[^A-Za-z0-9_\s-]", " "))


def squash(key: Column) -> Column:
    return F.regexp_replace(key, r"[\s-]", "")


def significant_words(key: Column, least: int = 3, stop: tuple[str, ...] = ("the", "and", "for", "of")) -> Column:
    return F.filter(F.split(key, r"[\s-]+"), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


# Words of names that mean nothing by themselves.
GENERIC_NAME_WORDS = ("the", "a", "an", "and", "of", "for", "inc", "incorporated", "llc", "corp", "corporation", "co", "company", "group", "ltd", "limited", "pvt", "private")


def guard_words(name: Column) -> Column:
    """Words of two characters or more that aren't generic; of what isn't a letter, digit or hyphen becomes a space."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*GENERIC_NAME_WORDS))


def filing_words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin("and", "the", "of", "a", "an"))


def plain_words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def has_word(text: Column, word: Column) -> Column:
    """Whether a text holds a word between characters that are neither letters nor digits, in any case."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(word), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.regexp_like(F.lower(text), pattern)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a's words (repeats count) that b holds."""
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.size(a)).otherwise(0.0)


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(text, r"([.!?]+)(\s+|$)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: strip(s)), lambda s: s != "")


def bare_sentences(text: Column) -> Column:
    """What full stops, exclamation and question marks before white space or the end divide, without these marks."""
    return F.filter(F.transform(F.split(text, r"[.!?]+(?:\s+|\z)"), lambda s: strip(s)), lambda s: s != "")


def statement_key(text: Column) -> Column:
    return F.substring(squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")), 1, 60)


def statement_words(text: Column) -> Column:
    """A market statement in lower case; what is no word character, percent or dollar sign becomes a space."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s%$]", " "))


def stat_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([+-]?[0-9]+(?:[.][0-9]+)?(?:%|x| ?days?| ?hours?| ?cr))"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"^[+-]", ""))


def reply_subject(subject: Column) -> Column:
    return F.when(F.lower(subject).startswith("re:"), subject).otherwise(F.concat(F.lit("Re: "), subject))


def local_part(name: Column) -> Column:
    words = F.split(squeeze(F.regexp_replace(F.lower(name), r"[^a-z\s]", "")), " ")
    return F.when(F.size(words) > 1, F.concat_ws(".", F.element_at(words, 1), F.element_at(words, -1))).otherwise(F.element_at(words, 1))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def json_object(text: Column) -> Column:
    """From the first `{` to the last `}`."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substr(text, first, last - first + 1))


def cut_blocks(text: Column, limit: int = 20_000) -> Column:
    """At most `limit` characters, cut at the last blank line if that keeps over half of them."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    cut = F.when((F.instr(head, "\n\n") > 0) & (at > limit // 2), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def mentions_name(words: Column, text: Column) -> Column:
    """Whether a text mentions a name by its significant words: all of one or two, else six in ten."""
    low = F.lower(text)
    found = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) == 0, False).when(F.size(words) <= 2, found == F.size(words)).otherwise(found >= F.size(words) * 0.6)


def mentions_topic(words: Column, text: Column) -> Column:
    """As mentions_name for a topic: any of up to three words, else 34 in 100."""
    low = F.lower(text)
    found = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(found == 0, False).when(F.size(words) <= 3, True).otherwise(found >= F.size(words) * 0.34)


def quoted_topic(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r'"([^"]+)"', 1), F.lit(""))


def versus_pair(text: Column) -> Column:
    """The two capitalised names around `vs`, or null."""
    pattern = r"([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*) (?:vs[.]?|versus) ([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*)"
    return F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def numbered_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*[0-9]+[.)] +([^\n]+)$"), F.lit(1))


def statement_rejection(text: Column) -> Column:
    """Why a statement isn't kept, or null: length 30 to 280, five words or more, not all capitals (of more than 8 letters A-Z)."""
    t = strip(text)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return F.when(~F.length(t).between(30, 280), "length").when(F.size(F.split(t, r"\s+")) < 5, "words").when((F.length(letters) > 8) & ~letters.rlike("[a-z]"), "capitals")


# What marks a report title, and the verbs and prepositions of prose.
BARE_YEAR_END = r"\b\d{4}(?:-\d{2,4})?\s*$"
PROSE_CONNECTOR = r"(?i)\b(?:is|are|was|were|will|has|have|had|can|could|would|projected|expected|forecast|valued|grow|growing|grew|reach|reaching|reached|exhibit|exhibiting|during|between|from)\b"
STRONG_INDICATOR = r"(?i)[\d](?:[.,]\d+)?\s*%|\$[\d,.]+\s*(?:billion|million|trillion|bn|mn)?|\bCAGR\b"


def statement_rejection_full(text: Column) -> Column:
    """As statement_rejection, then `title`: a statement that ends with a year and has no word of prose."""
    t = strip(text)
    return F.coalesce(statement_rejection(text), F.when(t.rlike(BARE_YEAR_END) & ~t.rlike(PROSE_CONNECTOR), "title"))


def has_strong_indicator(text: Column) -> Column:
    """A percentage, an amount of money or CAGR."""
    return text.rlike(STRONG_INDICATOR)


# Filler phrases and what replaces them, in order.
FILLERS = (
    (r"(?i)\bI hope this (?:email|message|note) finds you well[.,]?\s*", ""),
    (r"(?i)\bIt(?:'|’)s worth noting that\b", ""),
    (r"(?i)\bIt is worth noting that\b", ""),
    (r"(?i)\bIn today(?:'|’)s (?:fast-paced|ever-changing|competitive) (?:world|landscape|market)[,.]?\s*", ""),
    (r"(?i)\bAs an? (?:AI|language model)[^.]*\.\s*", ""),
    (r"(?i)\bIn conclusion,\s*", ""),
    (r"(?i)\bFurthermore,\s*", "Also, "),
    (r"(?i)\bMoreover,\s*", "And "),
    (r"(?i)\bleverage\b", "use"),
    (r"(?i)\bleveraging\b", "using"),
    (r"(?i)\butilize\b", "use"),
    (r"(?i)\butilizing\b", "using"),
)
DASHES = ((r"\s+--\s+", ", "), (r"\s+[—–]\s+", ", "), (r",\s*,", ", "), (r",\s*\.", "."))
TIDY = ((r"\s{2,}", " "), (r"^\s*[,;:]\s*", ""), (r"\s+([.,;:!?])", "$1"))


def replaced(text: Column, rules) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def humanised(text: Column) -> Column:
    """Connector dashes become commas, fillers go, and sentences begin with a capital again."""
    plain = strip(replaced(F.coalesce(text, F.lit("")), DASHES + FILLERS + TIDY))
    parts = F.split(F.regexp_replace(plain, r"([.!?]\s+)", "$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)), "")


# What goes from scraped Markdown, in order.
MARKDOWN_NOISE = (
    (r"!\[.*?\]\(.*?\)", ""),
    (r"(?m)^https?://\S+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^[-=*]{3,}\s*$", ""),
    (r"(?im)^(Home|Menu|Navigation|Skip to content|Back to top)\s*$", ""),
    (r"(?m)^[|+]+[-|+]*\s*$", ""),
)


def clean_markdown(text: Column) -> Column:
    return strip(replaced(text, MARKDOWN_NOISE))


def sec_name_key(name: Column) -> Column:
    """As name_key with `&` as `and` and the filing registry's suffixes."""
    bare = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"\b(?:pvt\.?|private|ltd\.?|limited|inc\.?|incorporated|llc|corp\.?|corporation|co\.?|plc)\b", " ")
    return squeeze(F.regexp_replace(bare, r"[^\p{L}\p{N}\s-]", " "))


def context_window(text: Column, pattern: str, before: int = 45, after: int = 55) -> Column:
    """The text around a pattern's first match, on one line; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_extract(text, f"({pattern})", 1))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, squeeze(F.substr(text, start, at + size + after - start)))


def base64url(text: Column) -> Column:
    """URL-safe Base64 without padding, on one line."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")
    return F.regexp_replace(F.translate(plain, "+/", "-_"), "=+$", "")


def mime_message(to: Column, subject: Column, body: Column) -> Column:
    """A plain-text message as it is sent: headers, an empty line, the body."""
    return F.concat_ws("\r\n", F.concat(F.lit("To: "), to), F.concat(F.lit("Subject: "), subject), F.lit("MIME-Version: 1.0"), F.lit('Content-Type: text/plain; charset="UTF-8"'), F.lit(""), body)


# Seniority by title.
SENIORITY = (("ceo", "C-Suite"), ("cto", "C-Suite"), ("coo", "C-Suite"), ("cfo", "C-Suite"), ("vp operations", "VP"), ("vp sales", "VP"), ("plant head", "Director"))


def seniority(title: Column) -> Column:
    out, low = F.lit("Manager"), F.lower(strip(title))
    for name, level in SENIORITY:
        out = F.when(low == name, level).otherwise(out)
    return out


# Senders and subjects of messages that couldn't be delivered.
BOUNCE_SENDERS = r"\b(mailer-daemon|postmaster)@"
BOUNCE_SUBJECTS = r"\b(delivery status notification|undelivered mail returned to sender|mail delivery failed|failure notice)\b"


def is_bounce(sender: Column, subject: Column) -> Column:
    """Whether a message says that another couldn't be delivered, by its sender or its subject."""
    return F.coalesce(sender.rlike(spark_pattern(BOUNCE_SENDERS)), F.lit(False)) | F.coalesce(subject.rlike(spark_pattern(BOUNCE_SUBJECTS)), F.lit(False))


def name_from_domain(domain: Column) -> Column:
    """A company's name as its domain suggests it: no ending, `_` and `-` as spaces, words parted at capitals, a capital first."""
    bare = F.regexp_replace(domain, r"\.(com|co\.in|in|net|org|io|biz|co|ltd)\z", "")
    words = strip(F.regexp_replace(F.regexp_replace(bare, r"[_\-]", " "), r"([a-z])([A-Z])", "$1 $2"))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def json_from_answer(raw: Column) -> Column:
    """The JSON in a model's answer: without a fence around it, from the first `{` to the last `}` where there are both; else all that is left."""
    plain = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*\z", ""))
    return F.coalesce(json_object(plain), plain)


def text_or(value: Column, fallback: str = "") -> Column:
    """A value as a stripped text, or the fallback for null and blank ones."""
    plain = strip(value.cast("string"))
    return F.when(plain.isNull() | (plain == ""), F.lit(fallback)).otherwise(plain)


def number_or(value: Column, fallback: float = 0.0) -> Column:
    """The number that a text begins with, or the fallback where there is none or it is zero."""
    head = F.regexp_extract(strip(value.cast("string")), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    found = F.when(head != "", head.cast("double"))
    return F.when(found.isNull() | (found == 0), F.lit(fallback)).otherwise(found)


def mail_local(name: Column) -> Column:
    """first.last of a name in letters, apostrophes and hyphens; the only word of shorter ones; null without any."""
    words = F.filter(F.split(F.regexp_replace(F.lower(strip(name)), r"[^a-z\s'-]", ""), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.concat_ws(".", F.element_at(words, 1), F.element_at(words, -1))).when(F.size(words) == 1, F.element_at(words, 1))


def seeded_ratio(seed: Column) -> Column:
    """A number from 0 to 1 that depends on the seed alone."""
    return fnv1a(seed) / F.lit(float(0xFFFFFFFF))


def seeded_pick(seed: Column, options: Column) -> Column:
    """One of an array, by the seed."""
    return F.get(options, (F.floor(seeded_ratio(seed) * F.size(options)) % F.size(options)).cast("int"))
