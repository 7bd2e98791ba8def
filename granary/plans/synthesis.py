"""Registered queries on clusters, confirmed signals, themes, opportunities and derived factors, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import brief as B
from granary.operators import proposals as P
from granary.operators import signals as S
from granary.operators import synthesis as Y
from granary.plans.more import _WORDS as QUOTE_WORDS
from granary.plans.more import chosen, listed, picked, q
from granary.plans.registry import query, t
from granary.plans.signals import _EVIDENCE, _FLAG, _MAP, _SIGNALS, _segments, _signals
from granary.session import scratch_path

# --- Clusters of factors ---------------------------------------------------------------------------------------------------
_CLUSTER_RULES = ", ".join(f"({i}, '{name}', {tier}, {len(need) + len(more)}, {place}, '{factor}', {str(place < len(need)).lower()})" for i, (name, tier, need, more, _) in enumerate(Y.CLUSTERS) for place, factor in enumerate(need + more))
_FITS = "CASE rule " + " ".join(f"WHEN {i} THEN {' OR '.join(dict.fromkeys(dict(Y.MODEL_FLAGS)[m] for m in models)) or 'true'}" for i, (*_, models) in enumerate(Y.CLUSTERS)) + " END"


@query("AGG_13_cluster_table", _SIGNALS + f""", fa AS (SELECT DISTINCT company, factor FROM z JOIN (VALUES {_MAP}) f(signal, factor) USING (signal)),
pf AS (SELECT company, company % 8 AS n_plants, company % 13 AS n_countries, {", ".join(f"bool_or({_FLAG[x]}) AS {x}" for x in Y.FLAGS)} FROM s GROUP BY company),
cm AS (SELECT company, rule, cluster, tier, possible, count(*) AS n, string_agg(factor, '|' ORDER BY place) AS signals, bool_or(factor = '{Y.SITES}') AS sites FROM fa JOIN (VALUES {_CLUSTER_RULES}) x(rule, cluster, tier, possible, place, factor, required) USING (factor) GROUP BY ALL HAVING bool_or(required)),
cc AS (SELECT *, CASE WHEN n / possible >= 0.66 OR (sites AND (n_plants >= {Y.MANY_PLANTS} OR n_countries >= {Y.MANY_COUNTRIES})) THEN 'high' WHEN n / possible >= 0.33 THEN 'medium' ELSE 'low' END AS confidence FROM cm JOIN pf USING (company) WHERE {_FITS})
SELECT company, cluster, tier, confidence, signals, row_number() OVER (PARTITION BY company ORDER BY tier, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule) AS place FROM cc""")
def _(spark, d):
    flags = _segments(spark, d).select("company", S.profile(F.col("text")).alias("p")).groupBy("company").agg(*[F.bool_or(f"p.{x}").alias(x) for x in Y.FLAGS])
    profiles = flags.withColumn("n_plants", F.col("company") % 8).withColumn("n_countries", F.col("company") % 13)
    found = Y.clusters(spark, S.factors(spark, _signals(spark, d), "company"), profiles, "company")
    return found.withColumn("signals", F.array_join("signals", "|"))


# --- Confirmed signals and themes ------------------------------------------------------------------------------------------
_SCORE = "CASE WHEN n >= 4 THEN 90 WHEN n = 3 THEN 75 WHEN n = 2 THEN 55 ELSE 30 END"
_LEVEL = lambda c: f"CASE WHEN {c} >= 80 THEN 'very_high' WHEN {c} >= 60 THEN 'high' WHEN {c} >= 40 THEN 'medium' ELSE 'low' END"
_CONFIRMED = _EVIDENCE + f""", fq AS (SELECT company, signal, page_type AS source, arg_min(left(quote, {Y.QUOTE_CHARS}), (seg_no, rule, pos)) AS quote, min((seg_no, rule, pos)) AS o FROM e GROUP BY ALL),
nq AS (SELECT *, row_number() OVER (PARTITION BY company, signal ORDER BY o, source) AS nth FROM fq),
va AS (SELECT *, {_SCORE} AS score FROM (SELECT company, signal, count(*) AS n, string_agg(source, '|' ORDER BY nth) AS sources FROM nq GROUP BY ALL)),
vl AS (SELECT *, {_LEVEL("score")} AS level FROM va)"""


def _quotes(spark, d):
    return Y.first_quotes(S.evidence(_segments(spark, d), "company").withColumn("source", F.col("page_type")), "company", ["seg_no", "rule", "pos"])


@query("AGG_17_validated_signals", _CONFIRMED + " SELECT company, signal, n AS n_sources, score, level, sources FROM vl")
def _(spark, d):
    return Y.validated(_quotes(spark, d), "company").withColumn("sources", F.array_join("sources", "|"))


_THEME_RULES = ", ".join(f"({i}, '{name}', {place}, '{signal}')" for i, (name, signals) in enumerate(Y.THEMES) for place, signal in enumerate(signals))


_THEMES = f""", th(rule, theme, place, signal) AS (VALUES {_THEME_RULES}),
rk AS (SELECT * FROM vl JOIN th USING (signal)),
tm AS (SELECT company, rule, theme, count(*) AS k, max(score) AS top, string_agg(signal, '|' ORDER BY score DESC, place) AS signals FROM rk GROUP BY ALL HAVING count(*) >= {Y.LEAST_SIGNALS}),
qt AS (SELECT company, rule, quote, min((-score, place, nth)) AS o FROM nq JOIN rk USING (company, signal) JOIN tm USING (company, rule) WHERE nth <= {Y.SOURCES_SHOWN} GROUP BY ALL),
qs AS (SELECT company, rule, string_agg(quote, '¦' ORDER BY o) AS quotes FROM (SELECT * FROM qt QUALIFY row_number() OVER (PARTITION BY company, rule ORDER BY o) <= {Y.QUOTES}) GROUP BY ALL),
ts AS (SELECT *, least(100, least(40, 10 * k) + floor(top * 0.4 + 0.5) + CASE WHEN top >= 80 THEN 20 WHEN top >= 60 THEN 10 ELSE 0 END)::BIGINT AS points FROM tm JOIN qs USING (company, rule))"""


@query("AGG_18_theme_table", _CONFIRMED + _THEMES + f"""
SELECT company, theme, signals, {_LEVEL("top")} AS confidence, CASE WHEN points >= 70 THEN 'critical' WHEN points >= 45 THEN 'important' ELSE 'secondary' END AS priority, points AS score, row_number() OVER (PARTITION BY company ORDER BY points DESC, rule) AS place, quotes FROM ts""")
def _(spark, d):
    found = Y.themes(spark, _quotes(spark, d), "company")
    return found.withColumn("signals", F.array_join("signals", "|")).withColumn("quotes", F.array_join("quotes", "¦"))


# --- Opportunities ---------------------------------------------------------------------------------------------------------
_TITLES = ["Predictive maintenance for presses", "Unified reporting", "Quality! inspection", "Dealer portal", "ERP link", "Demand planning, forecast", ""]
_OFFERS = ["Predictive quality control", "A portal for dealers", "Better forecasting", "Maintenance planning", "Link the ERP", "reports Unified", "inspection of presses", None]
_LINES = [P.SERVICES[0], P.SERVICES[5], "Consulting", P.SERVICES[7], None]
_TYPES = ["observed", "inferred", "observed", "guess"]
_BASES = ["  from the many plants it runs  ", "too thin", None, "reasoned from its new site"]
_TEXT_LIST = lambda values: ["NULL" if v is None else f"'{q(v)}'" for v in values]
_RUNS = "list_transform(generate_series(1, greatest(len(string_split(q, ' ')) - 3, 1)), lambda i: array_to_string(list_slice(string_split(q, ' '), i, i + 3), ' '))"
_SQUEEZED = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_WORDS_OF = lambda c: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= {P.WORD}))"
_EXACT, _SHARES = "contains(c, q)", f"(len({QUOTE_WORDS}) >= 8 AND len(list_filter({QUOTE_WORDS}, lambda x: contains(c, x))) >= 0.75 * len({QUOTE_WORDS}) AND len(list_filter({_RUNS}, lambda g: contains(c, g))) > 0)"


@query("GRD_4_opportunities", f"""WITH co AS (SELECT doc_id // 4 AS company, arg_min(text, doc_id) AS content, (doc_id // 4) % 7 = 0 AS is_thin FROM documents GROUP BY ALL),
ca AS (SELECT doc_id // 4 AS company, doc_id % 4 AS place, {picked("doc_id * 5", _TEXT_LIST(_TITLES))} AS title, 'challenge ' || doc_id AS challenge, 'c' || doc_id % 3 AS category, {picked("doc_id", ["'High'", "'Medium'", "'Low'"])} AS relevance FROM documents WHERE doc_id % 4 < 2),
pr AS (SELECT doc_id // 4 AS company, doc_id % 4 AS place, {picked("doc_id * 3", _TEXT_LIST(_OFFERS))} AS title, CASE WHEN doc_id % 3 > 0 THEN 'said ' || doc_id ELSE '' END AS description, {picked("doc_id", _TEXT_LIST(_LINES))} AS service_line, {picked("doc_id // 2", _TEXT_LIST(_TYPES))} AS claim_type,
  substr(text, 1 + doc_id % 5, 90 - doc_id % 70) AS evidence, {picked("doc_id // 3", _TEXT_LIST(_BASES))} AS inferred_from FROM documents),
en AS (SELECT company, content FROM co WHERE NOT is_thin), e1 AS (SELECT ca.* FROM ca JOIN en USING (company)), o1 AS (SELECT pr.*, content FROM pr JOIN en USING (company)),
tw AS (SELECT e1.company, e1.place, min(o1.place) AS proposal FROM e1 JOIN o1 USING (company) WHERE len(list_intersect({_WORDS_OF("e1.title")}, {_WORDS_OF("o1.title")})) > 0 GROUP BY ALL),
p1 AS (SELECT e1.company, 'catalogue' AS path, e1.place, e1.title, coalesce(nullif(o1.description, ''), challenge) AS description, e1.category, e1.relevance, o1.evidence, proposal FROM e1 LEFT JOIN tw USING (company, place) LEFT JOIN o1 ON o1.company = e1.company AND o1.place = proposal),
rs AS (SELECT *, {_SQUEEZED("evidence")} AS q, {_SQUEEZED("content")} AS c FROM o1 WHERE service_line IN ({listed(P.SERVICES)}) AND NOT EXISTS (FROM tw WHERE tw.company = o1.company AND tw.proposal = o1.place)),
p2 AS (SELECT company, 'verified', place, title, description, service_line, CASE WHEN {_EXACT} THEN 'Medium' ELSE 'Low' END, evidence, place FROM rs WHERE claim_type = 'observed' AND length(trim(evidence)) >= 30 AND ({_EXACT} OR {_SHARES})),
p3 AS (SELECT company, 'inferred', place, title, description, service_line, 'Low', evidence, place FROM rs WHERE claim_type = 'inferred' AND length(trim(coalesce(inferred_from, ''))) >= {P.BASIS})
FROM p1 UNION ALL FROM p2 UNION ALL FROM p3""")
def _(spark, d):
    doc, docs = F.col("doc_id"), t(spark, d, "documents")
    company, place = F.floor(doc / 4).cast("long").alias("company"), (doc % 4).alias("place")
    one = lambda key, values: chosen(key, [F.lit(v).cast("string") for v in values])
    part = lambda n: F.floor(doc / n).cast("long")
    companies = docs.groupBy(company).agg(F.min_by("text", "doc_id").alias("content")).withColumn("is_thin", F.col("company") % 7 == 0)
    catalogue = docs.where(doc % 4 < 2).select(company, place, one(doc * 5, _TITLES).alias("title"), F.concat(F.lit("challenge "), doc.cast("string")).alias("challenge"), F.concat(F.lit("c"), (doc % 3).cast("string")).alias("category"), one(doc, ["High", "Medium", "Low"]).alias("relevance"))
    offers = docs.select(company, place, one(doc * 3, _OFFERS).alias("title"), F.when(doc % 3 > 0, F.concat(F.lit("said "), doc.cast("string"))).otherwise("").alias("description"), one(doc, _LINES).alias("service_line"), one(part(2), _TYPES).alias("claim_type"), F.substr("text", (doc % 5 + 1).cast("int"), (90 - doc % 70).cast("int")).alias("evidence"), one(part(3), _BASES).alias("inferred_from"))
    return P.opportunities(catalogue, offers, companies, "company")


# --- Derived factors -------------------------------------------------------------------------------------------------------
_KINDS = ["growth", "hiring", "digital", "business", "other"]
_SIGNAL_TYPES = ["capacity", "Capacity_up", "industry 40", "MES", "automation_investment", "erp", "funding", None, "partnership", "iot_investment", "x"]
_SAID = ["the plant runs", "a new", "plant of machine learning", "it has robots and robotics", None, "digitalised lines; SCADA", "several campuses", "an autonomous system", "smart factory and ERP systems", "expanded sites; expanding sites too", "technology capex", "nothing"]
_CATEGORIES = ["Growth", "capacity_expansion", "hiring", "digital", "automation", "ai", "multi_location", "technology", "news", None, "other"]
_ABOUT = ["company_strategy", None, "industry_trend", "company_operations", "", "product_capability"]
_PASS_1 = " UNION ALL ".join(f"SELECT company, '{name}' AS factor, 1 AS by_pass FROM sg WHERE kind = '{k}'" + (f" AND regexp_matches(typed, '{q(p)}')" if p else "") for k, p, names in P.BY_TYPE for name in names)
_PASS_2 = " UNION ALL ".join([f"SELECT company, '{name}', 2 FROM ow WHERE category IN ({listed(c)})" for c, names in P.BY_CATEGORY for name in names] + [f"SELECT company, '{name}', 2 FROM ow WHERE regexp_matches(quote, '{q(p)}')" for p, names in P.BY_QUOTE for name in names])
_PASS_3 = " UNION ALL ".join(f"SELECT company, '{name}', 3 FROM jo WHERE regexp_matches(said, '{q(p)}')" for p, names in P.BY_ALL for name in names)
_KIND_RANK = "list_position(['growth', 'hiring', 'digital', 'business'], kind)"


@query("AGG_9_derived_factors", f"""WITH sg AS (SELECT *, CASE WHEN kind = 'digital' THEN lower(coalesce(type, '')) ELSE coalesce(type, '') END AS typed FROM (SELECT doc_id // 4 AS company, doc_id AS place, {picked("(doc_id // 4 + doc_id % 3)", _TEXT_LIST(_KINDS))} AS kind, {picked("doc_id * 7", _TEXT_LIST(_SIGNAL_TYPES))} AS type, {picked("doc_id // 2", _TEXT_LIST(_SAID))} AS evidence FROM documents) WHERE kind <> 'other'),
ow AS (SELECT company, lower(coalesce(category, '')) AS category, lower(coalesce(quote, '')) AS quote FROM (SELECT doc_id // 4 AS company, {picked("doc_id * 3", _TEXT_LIST(_CATEGORIES))} AS category, {picked("doc_id // 3", _TEXT_LIST(_SAID))} || ' ' || text AS quote, {picked("doc_id", _TEXT_LIST(_ABOUT))} AS subject FROM documents WHERE doc_id % 5 = 0) WHERE subject IS NULL OR subject IN ('', {listed(P.R.OWN_SUBJECTS)})),
jo AS (SELECT company, lower(string_agg(coalesce(evidence, '') || ' ' || coalesce(type, ''), ' ' ORDER BY {_KIND_RANK}, place)) AS said FROM sg GROUP BY company),
al AS (SELECT DISTINCT doc_id // 4 AS company, 'growth_signal' AS factor, 0 AS by_pass FROM documents WHERE doc_id % 9 = 0 UNION ALL {_PASS_1} UNION ALL {_PASS_2} UNION ALL {_PASS_3})
SELECT company, factor, min(by_pass) AS by_pass FROM al GROUP BY ALL""")
def _(spark, d):
    doc, docs = F.col("doc_id"), t(spark, d, "documents")
    company = F.floor(doc / 4).cast("long").alias("company")
    one = lambda key, values: chosen(key, [F.lit(v).cast("string") for v in values])
    part = lambda n: F.floor(doc / n).cast("long")
    signals = docs.select(company, doc.alias("place"), one(part(4) + doc % 3, _KINDS).alias("kind"), one(doc * 7, _SIGNAL_TYPES).alias("type"), one(part(2), _SAID).alias("evidence"))
    evidence = docs.where(doc % 5 == 0).select(company, one(doc * 3, _CATEGORIES).alias("category"), F.concat(one(part(3), _SAID), F.lit(" "), "text").alias("quote"), one(doc, _ABOUT).alias("subject"))
    given = docs.where(doc % 9 == 0).select(company, F.lit("growth_signal").alias("factor"))
    return P.derived_factors(signals, evidence, given, "company")


# --- Briefs ------------------------------------------------------------------------------------------------------------------
_PLACED = ", zp AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE strength WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, signal) AS place FROM z), nm AS (SELECT DISTINCT company, 'Company ' || company || ' & Co' AS name FROM s)"
_SHORTENED = lambda c, most, kept: f"CASE WHEN length({c}) > {most} THEN left({c}, {kept}) || '…' ELSE {c} END"
_PRIMARY_TYPES = ("manufacturer", "software_saas", "services_provider")


def _placed(spark, d):
    rank = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "moderate", 1).otherwise(2)
    return _signals(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy(rank, "signal")))


@query("GRD_11_summaries", _SIGNALS + _PLACED + f""", pf AS (SELECT company, {", ".join(f"bool_or({_FLAG[x]}) AS {x}" for x in _PRIMARY_TYPES)} FROM s GROUP BY company),
ty AS (SELECT company, list_filter([{", ".join(f"CASE WHEN {x} THEN '{x}' END" for x in _PRIMARY_TYPES)}], lambda v: v IS NOT NULL) AS types FROM pf),
sl AS (SELECT company, string_agg('  [' || strength || '] ' || signal || ' — "' || {_SHORTENED("best_quote", B.QUOTE, B.QUOTE)} || '"', chr(10) ORDER BY place) FILTER (place <= {B.SHOWN}) AS lines, count(*) AS n FROM zp GROUP BY company),
fl AS (SELECT company, string_agg(factor, ', ' ORDER BY factor) AS factors FROM (SELECT DISTINCT company, factor FROM z JOIN (VALUES {_MAP}) f(signal, factor) USING (signal)) GROUP BY company),
ol AS (SELECT company, '  s' || company % 3 || ' [fit:High | confidence:low]' AS offers FROM nm WHERE company % 4 > 0)
SELECT company, concat_ws(chr(10), 'COMPANY PROFILE: ' || CASE WHEN len(types) > 0 THEN array_to_string(types, ', ') ELSE 'unknown' END || ' | primary: ' || coalesce(types[1], 'unknown'), chr(10) || 'SIGNALS (' || n || '):', lines, chr(10) || 'FACTORS: ' || factors, CASE WHEN offers IS NOT NULL THEN chr(10) || 'OPPORTUNITY CANDIDATES:' END, offers) AS summary FROM ty LEFT JOIN sl USING (company) LEFT JOIN fl USING (company) LEFT JOIN ol USING (company)""")
def _(spark, d):
    flags = _segments(spark, d).select("company", S.profile(F.col("text")).alias("p")).groupBy("company").agg(*[F.bool_or(f"p.{x}").alias(x) for x in _PRIMARY_TYPES])
    types = F.array_compact(F.array(*[F.when(F.col(x), x) for x in _PRIMARY_TYPES]))
    profiles = flags.select("company", types.alias("types")).withColumn("primary_type", F.coalesce(F.get("types", F.lit(0)), F.lit("unknown")))
    signals = _placed(spark, d)
    drafts = flags.where("company % 4 > 0").select("company", F.lit(1).alias("place"), F.concat(F.lit("s"), (F.col("company") % 3).cast("string")).alias("service"), F.lit("High").alias("fit"), F.lit("low").alias("confidence"))
    return B.summaries(profiles, signals, S.factors(spark, signals, "company"), drafts, "company")


_TOLD = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(theme, '(?i){p}') THEN name || ' shows active ' || theme || ' — our team delivers {offer}: {angle}.' END" for p, offer, angle in B.ENTRIES) + ", name || ' has confirmed ' || split_part(signals, '|', 1) || ' activity — our team can accelerate with targeted AI/automation solutions.')"
_BULLETS = _SIGNALS + _CONFIRMED[len(_EVIDENCE) :] + _THEMES + _PLACED + f""",
tb AS (SELECT company, string_agg(line, '¦' ORDER BY nth) AS lines FROM (SELECT company, {_TOLD} AS line, row_number() OVER (PARTITION BY company ORDER BY CASE {_LEVEL("top")} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, points DESC, rule) AS nth FROM ts JOIN nm USING (company)) WHERE nth <= {B.THEMES_SHOWN} GROUP BY company),
qb AS (SELECT company, string_agg('Evidence: "' || {_SHORTENED("best_quote", B.BULLET_QUOTE, B.BULLET_QUOTE - 3)} || '"', '¦' ORDER BY place, signal) AS lines FROM (SELECT * FROM zp WHERE is_own QUALIFY row_number() OVER (PARTITION BY company ORDER BY place, signal) <= {B.QUOTES_SHOWN}) GROUP BY company),
ob AS (SELECT company, name, concat_ws('¦', tb.lines, qb.lines) AS observed FROM nm LEFT JOIN tb USING (company) LEFT JOIN qb USING (company))"""


def _observed(spark, d):
    companies = _segments(spark, d).select("company", F.concat(F.lit("Company "), F.col("company").cast("string"), F.lit(" & Co")).alias("name")).distinct()
    return companies, B.bullets(companies, Y.themes(spark, _quotes(spark, d), "company"), _placed(spark, d), "company")


@query("GRD_12_brief_bullets", _BULLETS + " SELECT company, observed FROM ob")
def _(spark, d):
    return _observed(spark, d)[1].select("company", F.array_join("observed", "¦").alias("observed"))


_ESCAPED = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query("SNK_3_brief_pages", _BULLETS + f""" SELECT 'company-' || company || '-co.html' AS file, '<!doctype html><html><head><meta charset="utf-8"><title>' || {_ESCAPED("name")} || '</title></head><body><h1>' || {_ESCAPED("name")} || '</h1><h2>What we observed</h2><ul>' || CASE WHEN observed = '' THEN '' ELSE '<li>' || replace({_ESCAPED("observed")}, '¦', '</li><li>') || '</li>' END || '</ul><h2>What to offer</h2><p>AI &amp; operations</p></body></html>' AS html FROM ob""")
def _(spark, d):
    companies, observed = _observed(spark, d)
    path = scratch_path(spark, "briefs")
    B.write_pages(companies.join(observed, "company").select("name", B.page(F.col("name"), F.col("observed"), F.lit("AI & operations")).alias("html")), path)
    return spark.read.schema("file string, html string").json(path)
