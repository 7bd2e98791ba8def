"""Claims against what stands in the sources: people, titles, tickers, statistics, ids, and the audit of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.signal_rules import FLOOR_SUBJECTS, OWN_SUBJECTS
from granary.operators import content

# Words of titles and names that don't count, and thresholds.
TITLE_STOPWORDS = ("of", "the", "and", "for", "a", "an", "&")
NAME_STOPWORDS = ("and", "the", "of", "a", "an")
NAME_OVERLAP, TITLE_OVERLAP, EXTRA_WORDS = 0.6, 0.4, 2
HIGH_SOURCES = 2
FLOOR_ITEMS = 2


def title_words(title: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*TITLE_STOPWORDS))


def name_words(name: Column) -> Column:
    return F.filter(F.split(X.name_key(name), " "), lambda w: F.length(w) > 1)


def either_overlap(a: Column, b: Column) -> Column:
    """The greater share of one's words that the other holds."""
    return F.greatest(X.overlap_ratio(a, b), X.overlap_ratio(b, a))


def acronym(title: Column) -> Column:
    return F.array_join(F.transform(F.split(title, r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "")


def ground_people(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """id, status, listed_title: confirmed, conflict, not_found, or null where the company has no contacts.

    candidates has id, company, name, title; contacts has company, pos, name, title. The first contact whose name
    matches decides. Matching names share a word, so pairs come from an equi-join on company and word, once for each name.
    """
    # equal names of a company match the same contacts, and of contacts with one name the first alone can decide
    names = candidates.select("company", F.col("name").alias("a")).distinct()
    listed = contacts.groupBy("company", F.col("name").alias("b")).agg(F.min(F.struct("pos", F.col("title").alias("listed"))).alias("first"))
    words = lambda rows, name: rows.select("*", F.explode(F.array_distinct(name_words(F.col(name)))).alias("word"))
    both = words(names, "a").join(words(listed, "b"), ["company", "word"]).select("company", "a", "b", "first").distinct()
    same = (X.name_key(F.col("a")) == X.name_key(F.col("b"))) | (either_overlap(name_words(F.col("a")), name_words(F.col("b"))) >= NAME_OVERLAP)
    first = both.where(same).groupBy("company", F.col("a").alias("name")).agg(F.min("first").alias("first")).select("company", "name", F.col("first.listed").alias("listed_title"))
    own = X.strip(F.col("title"))
    fits = (own.rlike("^[A-Za-z]{2,5}$") & (acronym(F.col("listed_title")) == F.upper(own))) | (either_overlap(title_words(F.col("title")), title_words(F.col("listed_title"))) >= TITLE_OVERLAP)
    known = contacts.select("company").distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), None).when(F.col("listed_title").isNull(), "not_found").when(fits, "confirmed").otherwise("conflict")
    return candidates.select("id", "company", "name", "title").join(first, ["company", "name"], "left").join(known, "company", "left").select("id", status.alias("status"), "listed_title")


def best_titles(jobs: DataFrame, targets: list[str]) -> DataFrame:
    """person, target, ratio, confidence: a person's job that holds most of a target's words; current jobs win ties, then the earlier target.

    jobs has person, title and is_current; the targets are a short list.
    """
    rows = jobs.select("person", "is_current", title_words(F.col("title")).alias("own"), F.posexplode(F.array(*[F.lit(x) for x in targets])).alias("place", "target"))
    ratio = X.overlap_ratio(title_words(F.col("target")), F.col("own"))
    best = rows.withColumn("ratio", ratio).where("ratio > 0").groupBy("person").agg(F.max_by(F.struct("target", "ratio", "is_current"), F.struct("ratio", F.col("is_current").cast("int"), -F.col("place"))).alias("b")).select("person", "b.*")
    return best.select("person", "target", "ratio", F.when((F.col("ratio") >= 1) & F.col("is_current"), "high").when(F.col("ratio") >= 0.5, "medium").otherwise("low").alias("confidence"))


def match_tickers(names: DataFrame, tickers: DataFrame) -> DataFrame:
    """id, ticker: the entry with an equal key, else the only one that holds all words and at most two more; else none.

    names has id and name; tickers has pos, ticker and title.
    """
    keyed = names.select("id", X.sec_name_key(F.col("name")).alias("key")).where("key <> ''")
    listed = tickers.select("pos", "ticker", X.sec_name_key(F.col("title")).alias("key"))
    split = lambda key: F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin(*NAME_STOPWORDS))
    exact = keyed.join(listed.groupBy("key").agg(F.min_by("ticker", "pos").alias("ticker")), "key").select("id", "ticker")
    open_ = keyed.join(exact, "id", "left_anti").withColumn("words", F.array_distinct(split(F.col("key")))).withColumn("n", F.size(split(F.col("key")))).where("n > 1")
    # an entry that holds all words holds the one that fewest entries have: names meet entries by that word alone
    entries = listed.select("pos", "ticker", F.array_distinct(split(F.col("key"))).alias("held"), F.size(split(F.col("key"))).alias("m"))
    index = entries.select("pos", "ticker", "held", "m", F.explode("held").alias("word"))
    frequency = index.groupBy("word").agg(F.count("*").alias("f"))
    rarest = open_.select("id", F.explode("words").alias("word")).join(frequency, "word").groupBy("id").agg(F.min_by("word", F.struct("f", "word")).alias("word"))
    tried = open_.join(rarest, "id").join(index, "word")
    whole = tried.where((F.size(F.array_except("words", "held")) == 0) & (F.col("m") <= F.col("n") + EXTRA_WORDS)).select("id", "ticker")
    only = whole.groupBy("id").agg(F.count("*").alias("c"), F.min("ticker").alias("ticker")).where("c = 1").select("id", "ticker")
    return names.select("id").join(exact.unionByName(only), "id", "left")


def first_shared_word(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """id, pos: the first title that shares a word of more than four characters with a row's; rows have key, id, text, titles key, pos, text."""
    long = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 4))).alias("word"))
    # of the titles with a word the first alone can be the first that shares it
    first = long(titles, "key", "pos").groupBy("key", "word").agg(F.min("pos").alias("pos"))
    return long(rows, "key", "id").join(first, ["key", "word"]).groupBy("id").agg(F.min("pos").alias("pos"))


def has_ungrounded_stat(draft: Column, outcomes: Column) -> Column:
    """Whether a draft cites statistics and none is, or holds, or is held by one of the outcomes'."""
    cited, real = X.stat_tokens(draft), X.stat_tokens(outcomes)
    return (F.size(cited) > 0) & ~F.exists(cited, lambda a: F.exists(real, lambda b: F.contains(a, b) | F.contains(b, a)))


def whitelisted(claimed: Column, candidates: Column) -> Column:
    """The claimed id if it is among the candidates, else an empty one."""
    return F.when(F.array_contains(candidates, claimed), claimed).otherwise(F.lit(""))


def subject_floor(evidence: DataFrame, key: str) -> DataFrame:
    """key, type, n, best_quote of companies without evidence about themselves: two items of each type, weak by definition.

    evidence has key, seq, type, subject, tier (1 to 3) and quote.
    """
    own = evidence.where(F.col("subject").isin(*OWN_SUBJECTS)).select(key).distinct()
    some = evidence.where(F.col("subject").isin(*FLOOR_SUBJECTS) & F.col("type").isNotNull()).join(own, key, "left_anti")
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy(key, "type").orderBy("seq"))).where(F.col("_n") <= FLOOR_ITEMS)
    return first.groupBy(key, "type").agg(F.count("*").alias("n"), F.min_by("quote", F.struct("tier", "seq")).alias("best_quote"))


def audit(claims: DataFrame, names: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags (company, kind, ref, flag), and per company how many items were audited and flagged.

    claims has company, kind, ref, evidence_id, confidence, and relevance if opportunities are to be judged by it too;
    names has company, kind, ref, confidence, n_urls, is_self; evidence has evidence_id and subject.
    """
    linked = claims.where("evidence_id IS NOT NULL")
    high = F.col("confidence") == "high"
    claimed = F.col("confidence").isin("high", "High")
    if "relevance" in claims.columns:
        claimed = F.coalesce(claimed, F.lit(False)) | ((F.col("kind") == "opportunity") & (F.col("relevance") == "High"))
    subject = linked.join(evidence.select("evidence_id", "subject"), "evidence_id", "left").where(claimed & (F.col("subject") == "product_capability")).select("company", "kind", "ref", F.lit("evidence_subject_mismatch").alias("flag"))
    single = names.where(high & (F.coalesce("n_urls", F.lit(0)) < HIGH_SOURCES)).select("company", "kind", "ref", F.lit("single_mention_high_confidence").alias("flag"))
    self_ = names.where("is_self").select("company", "kind", "ref", F.lit("self_name_collision").alias("flag"))
    flags = subject.unionByName(single).unionByName(self_)
    audited = linked.select("company").unionByName(names.select("company")).groupBy("company").agg(F.count("*").alias("audited"))
    flagged = flags.groupBy("company").agg(F.count_distinct("kind", "ref").alias("flagged"))
    return flags, audited.join(flagged, "company", "left").select("company", "audited", F.coalesce("flagged", F.lit(0)).alias("flagged"))


def grounded_claims(claims: DataFrame) -> DataFrame:
    """Claims that may stay: observed ones only if their evidence is in the content, none of thin evidence or without title.

    claims has title, claim_type, confidence, evidence, content and is_thin. Unknown types become null and unknown
    confidences low; other columns stay.
    """
    kind, sure = F.col("claim_type"), F.col("confidence")
    observed = F.coalesce(kind == "observed", F.lit(False))
    found = content.is_grounded(F.coalesce(content.verify_quote(F.col("evidence"), F.col("content")), F.lit("none")))
    kept = claims.where(~F.coalesce("is_thin", F.lit(False)) & (F.coalesce("title", F.lit("")) != "") & (~observed | found))
    return kept.withColumn("claim_type", F.when(kind.isin("observed", "inferred"), kind)).withColumn("confidence", F.when(sure.isin("high", "medium", "low"), sure).otherwise("low"))


BESIDE = 120


def _whole_word(word: Column) -> Column:
    plain = F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), plain, F.lit(r"(?![\p{L}\p{N}])"))


def word_share(words: Column, text: Column) -> Column:
    """Share of words that occur as whole words; 0 without words or text."""
    found = F.size(F.filter(words, lambda w: F.coalesce(F.rlike(text, _whole_word(w)), F.lit(False))))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)


def together(words: Column, text: Column) -> Column:
    """Whether all words occur within BESIDE characters of one place of the first; true for a single word."""
    first = F.try_element_at(words, F.lit(1))
    parts, size = F.split(text, _whole_word(first)), F.length(first)

    def near(i):
        start = F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * size
        begin = F.greatest(F.lit(0), start - BESIDE)
        return word_share(words, F.substr(text, begin + 1, start + size + BESIDE - begin)) == 1

    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return (F.size(words) <= 1) | F.coalesce(F.exists(places, near), F.lit(False))


def site_identity(words: Column, title: Column, description: Column, body: Column) -> Column:
    """high, medium or none: how surely a site is that of the company whose significant words are given.

    All words in the title are high. One word alone asks for that. Half of them in the title, or all of them together in
    the description or the body, are medium. Nulls say nothing.
    """
    in_title, in_description, in_body = word_share(words, title), word_share(words, description), word_share(words, body)
    beside = together(words, F.when(in_description == 1, description).otherwise(body))
    return F.when(in_title == 1, "high").when(F.size(words) <= 1, "none").when(in_title >= 0.5, "medium").when(((in_description == 1) | (in_body == 1)) & beside, "medium").otherwise("none")
