"""Registered queries on lists in texts and in files, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import extraction as E
from granary.functions import guards as G
from granary.functions import text as X
from granary.operators import content
from granary.plans.more import STRIP, chosen, listed, picked, q
from granary.plans.registry import query, t
from granary.session import scratch_path
from granary.sources import leads

_SEGMENTS = [
    "Industries we serve. Healthcare. Telemedicine Platforms! Electronic Health Records (EHR). Contact sales@x.example.com today. Demand. All rights reserved. Late",
    "Our customers include hospitals, Oil  AND Gas firms and the airlines; food and beverage & a textile and apparel maker, Iron and steel and research and development.",
    "Sectors we serve include automotive, the rail and aerospace", "serving the maritime and offshore wind industry", "Clients range from banks to bakers. Others follow", "industries served: steel, tin, xy and a very long name of a segment that no list would hold in it",
    "verticals spanning...", "Customers are: mail a.b+c@d-e.example.org and plants, mines. no", "We serve nobody", "Industries including health and wellness & travel and tourism, sales and marketing; pulp and  paper",
    "Verticals across? One. Two words. Three more words here. Seven words are too many for an item. Never",
]
_MASKED = "inline"
for _idiom in E.IDIOMS:
    _a, _b = _idiom.split(" and ")
    _MASKED = f"regexp_replace({_MASKED}, '(?i)\\b({_a}\\s+a)(nd\\s+{_b})\\b', '\\1' || chr(1) || '\\2', 'g')"


@query("EXT_16_segment_lists", f"""WITH x AS (SELECT doc_id, regexp_replace(regexp_extract(text || chr(10) || {picked("doc_id", ["'" + q(x) + "'" for x in _SEGMENTS])}, '(?i)(?:{q(E.SEGMENT_TRIGGER)})([\\s\\S]{{0,{E.AFTER_TRIGGER}}})', 1), '{q(E.ADDRESS)}', ' ', 'g') AS after FROM documents),
i AS (SELECT *, regexp_matches(after, '^\\s*[.!?]+') AS heading, regexp_replace(regexp_extract(after, '^[^.!?]*', 0), '(?i){q(E.LEFTOVER)}', '') AS inline,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(after, '^\\s*[.!?]+\\s*', ''), '[.!?]+'), lambda s: {STRIP("s")}), lambda s: s <> '') AS items FROM x),
h AS (SELECT *, coalesce(list_position(list_transform(items, lambda s: regexp_matches(s, '(?i){E.BOILERPLATE}') OR len(regexp_split_to_array(s, '\\s+')) > {E.ITEM_WORDS}), true), 0) AS ends FROM i),
f AS (SELECT doc_id, CASE WHEN heading THEN items[1:CASE WHEN ends > 0 THEN least(ends - 1, {E.ITEMS}) ELSE {E.ITEMS} END] ELSE list_transform(regexp_split_to_array({_MASKED}, '(?i),|;|\\band\\b|&'), lambda s: replace({STRIP("regexp_replace(s, '(?i)^(?:the|a|an)\\s+', '')")}, chr(1), '')) END AS found FROM h)
SELECT doc_id, array_to_string(list_filter(found, lambda s: length(s) BETWEEN 3 AND 50), '|') AS segments FROM f""")
def _(spark, d):
    text = F.concat("text", F.lit("\n"), chosen(F.col("doc_id"), [F.lit(x) for x in _SEGMENTS]))
    return t(spark, d, "documents").select("doc_id", F.array_join(E.segment_list(text), "|").alias("segments"))


_LINES = "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name || ' \"' || c_mktsegment || '\", unit' END"


def _files(spark, d):
    """The customers as CSV files, one for each remainder of their nation by four, read back."""
    path = scratch_path(spark, "leads")
    key = F.col("c_custkey")
    name = F.when(key % 17 > 0, F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('", unit')))
    rows = t(spark, d, "customer").select(name.alias("Company Name"), F.col("c_mktsegment").alias("Industry"), key.cast("string").alias("Contact Name"), (F.col("c_nationkey") % 4).alias("part"))
    rows.repartition(4, "part").sortWithinPartitions("part", F.col("Contact Name").cast("long")).write.partitionBy("part").option("header", True).option("escape", '"').csv(path)
    # the folders' column stands behind the files' own
    return leads.read_csv(spark, path)


@query("SRC_2_numbered_rows", f"SELECT (c_nationkey % 4)::INT AS part, row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey) - 1 AS pos, {_LINES} AS company_name, c_mktsegment AS industry, c_custkey::VARCHAR AS person_name FROM customer")
def _(spark, d):
    return _files(spark, d).select(F.col("part").cast("int").alias("part"), "pos", F.col("Company Name").alias("company_name"), F.col("Industry").alias("industry"), F.col("Contact Name").alias("person_name"))


@query("SRC_2_row_warnings", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT pos, 'Row ' || (pos + 2) || ': no company name' AS warning FROM r WHERE c_custkey % 17 = 0")
def _(spark, d):
    return leads.project(_files(spark, d))[1].select("pos", "warning")


# --- Market statements -----------------------------------------------------------------------------------------------------
_SAID = [
    "The market is growing at 7% in all of its regions. Margin pressure from rising costs hits makers of pumps!", "Buyers are shifting toward leaner lines this year? An emerging trend in valves is seen.", "Pump market size outlook share and trends 2035. Short trend",
    "MARKET SIZE AND GROWTH OF ALL THE REGIONS WE SELL. The market is growing at 7% in all of its regions.", "The pump market was valued at $4.5 billion in 2024 and is projected to reach more.", "Nothing of the kind is said here at all.", "A talent shortage weighs on plants, and " + "so on and on and " * 14 + "it ends. " + "an emerging trend of " + "many words " * 21 + "here",
]
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(s, '{q(p)}') THEN '{n}'" for n, p in content.MARKET_PATTERNS) + " END"
_KEPT = f"length(s) BETWEEN 30 AND 280 AND len(regexp_split_to_array(s, '\\s+')) >= 5 AND NOT (length(regexp_replace(s, '[^A-Za-z]', '', 'g')) > 8 AND NOT regexp_matches(s, '[a-z]')) AND NOT (regexp_matches(s, '{q(X.BARE_YEAR_END)}') AND NOT regexp_matches(s, '{q(X.PROSE_CONNECTOR)}'))"
_SENTENCES = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '[.!?]+(?:\\s+|$)'), lambda s: {STRIP('s')}), lambda s: s <> '')"


@query("EXT_17_market_statements", f"""WITH x AS (SELECT doc_id, unnest({_SENTENCES("text || ' ' || " + picked("doc_id", ["'" + q(x) + "'" for x in _SAID]))}) AS s FROM documents)
SELECT doc_id, {_CATEGORY} AS category, count(*) AS n FROM x WHERE {_CATEGORY} IS NOT NULL AND {_KEPT} GROUP BY ALL""")
def _(spark, d):
    text = F.concat("text", F.lit(" "), chosen(F.col("doc_id"), [F.lit(x) for x in _SAID]))
    rows = t(spark, d, "documents").select("doc_id", F.explode(X.bare_sentences(text)).alias("s")).withColumn("category", content.market_statement(F.col("s")))
    return rows.where(F.col("category").isNotNull() & X.statement_rejection_full(F.col("s")).isNull()).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query("EXT_17_market_groups", f"""WITH r AS (SELECT doc_id // 5 AS company, doc_id AS place, 'u' || doc_id % 3 AS url, {picked("doc_id", ["'" + q(x) + "'" for x in _SAID])} AS title, text || ' ' || {picked("doc_id // 2", ["'" + q(x) + "'" for x in _SAID])} AS content FROM documents),
x AS (SELECT company, place, url, unnest(range(1, len(ss) + 1)) AS nth, unnest(ss) AS s FROM (SELECT *, {_SENTENCES("title")} || {_SENTENCES("content")} AS ss FROM r)),
k AS (SELECT *, {_CATEGORY} AS category, left(trim(regexp_replace(regexp_replace(lower(s), '[^A-Za-z0-9_\\s%$]', ' ', 'g'), '\\s+', ' ', 'g')), 60) AS statement_key FROM x WHERE {_KEPT})
SELECT company, statement_key, CASE WHEN length(arg_min(s, (place, nth))) > 240 THEN left(arg_min(s, (place, nth)), 237) || '...' ELSE arg_min(s, (place, nth)) END AS statement, arg_min(category, (place, nth)) AS category, count(*) AS mention_count, count(DISTINCT url) AS n_sources, bool_or(regexp_matches(s, '{q(X.STRONG_INDICATOR)}')) AS strong FROM k WHERE category IS NOT NULL AND statement_key <> '' GROUP BY company, statement_key""")
def _(spark, d):
    doc = F.col("doc_id")
    said = lambda key: chosen(key, [F.lit(x) for x in _SAID])
    results = t(spark, d, "documents").select(F.floor(doc / 5).cast("long").alias("company"), doc.alias("place"), F.concat(F.lit("u"), (doc % 3).cast("string")).alias("url"), said(doc).alias("title"), F.concat("text", F.lit(" "), said(F.floor(doc / 2).cast("long"))).alias("content"))
    return content.market_groups(results, "company")


# --- Offerings -------------------------------------------------------------------------------------------------------------
_OFFERS = [
    "We offer welding lines, and we provide service for them. Our products include: pumps\nand more", "We are a leading provider of castings. WE PROVIDE castings! We provide Castings? our core services include 640x480 pictures.", "We design a. We deliver which is a fragment.",
    "Nothing offered", " ".join(f"We manufacture part number {k % 10} of a kind." for k in range(18)), "we specialize in " + "very " * 30 + "long things", "We offer",
]
_OFFER_PATTERN, _OFFER_END = f"(?i)(?:{E.OFFERING_TRIGGER})", "(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))))::INT"
_OFFER_FRAGMENT = f"(regexp_matches(w, '(?i)\\b\\d{{1,4}}x\\d{{1,4}}\\b') OR regexp_replace(lower(regexp_split_to_array(w, '\\s+')[1]), '[^\\p{{L}}\\p{{N}}]', '', 'g') IN ({listed(G.FRAGMENT_STARTERS)}))"


@query("EXT_11_offerings", f"""WITH x AS (SELECT doc_id, text || chr(10) || {picked("doc_id", ["'" + q(x) + "'" for x in _OFFERS])} AS t FROM documents),
m AS (SELECT doc_id, t, unnest(range(1, len(found) + 1)) AS i, found, parts FROM (SELECT *, regexp_extract_all(t, '{_OFFER_PATTERN}', 0) AS found, regexp_split_to_array(t, '{_OFFER_PATTERN}') AS parts FROM x)),
w AS (SELECT doc_id, i, {STRIP(f"regexp_replace(regexp_extract(substr(t, 1 + {_OFFER_END}, {E.OFFERING_CHARS}), '^[^.!?\n]*', 0), '(?i){E.OFFERING_LEFTOVER}', '')")} AS w FROM m),
k AS (SELECT doc_id, i, w, trim(regexp_replace(regexp_replace(lower(w), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM (SELECT * FROM w WHERE length(w) BETWEEN {E.OFFERING_SIZES[0]} AND {E.OFFERING_SIZES[1]} AND NOT {_OFFER_FRAGMENT} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {2 * E.OFFERINGS})),
o AS (SELECT doc_id, min(i) AS i, arg_min(w, i) AS w FROM k WHERE k <> '' GROUP BY doc_id, k),
l AS (SELECT doc_id, string_agg(w, '|' ORDER BY i) AS offerings FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= {E.OFFERINGS}) GROUP BY doc_id)
SELECT doc_id, coalesce(offerings, '') AS offerings FROM x LEFT JOIN l USING (doc_id)""")
def _(spark, d):
    text = F.concat("text", F.lit("\n"), chosen(F.col("doc_id"), [F.lit(x) for x in _OFFERS]))
    return t(spark, d, "documents").select("doc_id", F.array_join(E.offerings(text), "|").alias("offerings"))
