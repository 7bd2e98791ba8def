"""Registered queries on the signal rule pack, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import signal_rules as R
from granary.functions import service_rules as V
from granary.operators import grounding
from granary.operators import services as V_OPS
from granary.operators import signals as S
from granary.plans.more import _WORDS as QUOTE_WORDS
from granary.plans.more import chosen, listed, picked, q
from granary.plans.registry import query, t

_PLACES = ["", "/careers/open", "/about-us", "/newsroom/2024", "/products/pumps", "/Investor/ar", "/blog/x", "/xyz", "/annual_report"]
_NAMES = ["Brightforge Works Ltd", "Global Mills", "Ab", "Kestrel (India) Pvt. Ltd."]
_SAID = [
    "We are opening a new plant and expanding our capacity. Our team runs a new plant, a new facility and a new campus, and one new hub.",
    "Our customers can see the digital twin. Our customers use AI-powered tools.",
    "The company is entering the capital market and expanding globally with global operations in 14 countries.",
    "Brightforge acquired two plants; talent acquisition goes on. The market is moving to industry 4.0 and a smart factory.",
    "Help your digital transformation journey. Digital transformation roadmap for all.",
    "Kestrel hires a SAP consultant, a data scientist and a PLC programmer, knowledge of SAP (MM).",
    "You get welding solutions from a leading provider with record revenue and 25% growth of forging operations.",
    "Our strategy is carbon neutral production lines; features include connected machines and a software platform.",
    "No signal here, but a food bank and FMCG shops of a forging company.",
    "Consumer goods, a retail chain, a loan from the bank and R&D centre for robots.",
    "The sector is slow; global  footprint of   our\tplants across 12 sites, multi-plant, presence in more than 30 countries worldwide.",
]


def _segments(spark, d):
    doc, quoted = F.col("doc_id"), F.col("doc_id").cast("long")
    company = F.floor(doc / 4).cast("long")
    path = chosen(doc, [F.lit(x) for x in _PLACES])
    return t(spark, d, "documents").select(
        company.alias("company"), (quoted % 4).alias("seg_no"), F.concat(F.lit("https://x.example"), path).alias("url"), path.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), chosen(doc, [F.lit(x) for x in _SAID])).alias("text"),
        chosen(company, [F.lit(x) for x in _NAMES]).alias("name"), (company % 5 == 0).alias("is_vendor"))


_LIST = lambda values: ["'" + q(v) + "'" for v in values]
_ON = lambda c, p: f"regexp_matches({c}, '(?i){q(p)}')"
_PAGE = "CASE WHEN path = '' THEN 'homepage' " + " ".join(f"WHEN regexp_matches(lower(path), '{q(p)}') THEN '{n}'" for n, p in R.PAGE_TYPES) + " ELSE 'other' END"
_TIER = "CASE WHEN page_type IN ('careers', 'investor', 'annual_report', 'press') THEN 1 WHEN page_type IN ('about', 'blog') THEN 2 ELSE 3 END"
_SEGMENTS = f"""d AS (SELECT doc_id // 4 AS company, doc_id % 4 AS seg_no, {picked("doc_id", _LIST(_PLACES))} AS path, coalesce(text, '') || chr(10) || {picked("doc_id", _LIST(_SAID))} AS text FROM documents),
s AS (SELECT *, 'https://x.example' || path AS url, {_PAGE} AS page_type, {picked("company", _LIST(_NAMES))} AS name, company % 5 = 0 AS is_vendor FROM d)"""
_RULES = ", ".join(f"({i}, '{s}', '(?i){q(p)}', {'NULL' if a is None else chr(39) + '(?i)' + q(a) + chr(39)})" for i, (s, p, a) in enumerate(R.PATTERNS))
_CUT = f"left(trim(regexp_replace(substr(text, greatest(pos - {S.AROUND}, 0) + 1, pos + len(hit) + {S.AROUND} - greatest(pos - {S.AROUND}, 0)), '\\s+', ' ', 'g'), ' '), {S.LONGEST})"

def evidence_sql(segments: str, tier: str = _TIER) -> str:
    """Common table expressions up to e, the rule pack's evidence of segments: company, seg_no, url, page_type, text."""
    return f"""WITH {segments},
r(rule, signal, p, against) AS (VALUES {_RULES}),
h AS (SELECT s.*, r.*, regexp_extract_all(text, p, 0) AS found, regexp_split_to_array(text, p) AS parts FROM s, r WHERE regexp_matches(text, p)),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM h),
o AS (SELECT * EXCLUDE (found, parts), found[i] AS hit, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::INT AS pos FROM i),
k AS (SELECT *, {_CUT} AS quote FROM o),
n AS (SELECT *, {tier} AS tier, row_number() OVER (PARTITION BY company, seg_no, rule ORDER BY pos) AS nth, row_number() OVER (PARTITION BY company, signal, url ORDER BY seg_no, rule, pos) AS total FROM k WHERE against IS NULL OR NOT regexp_matches(quote, against)),
e AS (SELECT * FROM n WHERE nth = 1 OR total <= {S.CAP})"""


_EVIDENCE = evidence_sql(_SEGMENTS)

_SHORT = f"(string_split(trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i){q(R.LEGAL_FORMS)}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '))"
_COMMON = ", ".join(f"'{w}'" for w in R.COMMON_FIRST)
_ESCAPED = lambda c: f"regexp_replace({c}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"
_SAYS = lambda c: f"regexp_matches(quote, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])' || {_ESCAPED(c)} || '(?:$|[^\\p{{L}}\\p{{N}}])')"
_IN = lambda pages: "page_type IN (" + ", ".join(f"'{p}'" for p in pages) + ")"
_SUBJECT = " ".join(
    [f"WHEN {_ON('quote', p)} THEN '{s}'" for s, p in R.OUTSIDE] + [f"WHEN page_type = '{p}' THEN '{s}'" for p, s in R.OWN_PAGES]
    + [f"WHEN is_vendor AND {_IN(('about', 'other'))} AND NOT ({_ON('quote', R.ADDRESSED)} AND NOT {_ON('quote', R.OWN_PEOPLE)}) THEN 'company_strategy'"]
    + [f"WHEN {_ON('quote', p)}" + (f" AND NOT {_ON('quote', a)}" if a else "") + f" THEN '{s}'" for s, p, a in R.FIRST_PERSON]
    + [f"WHEN {_IN(('about', 'other'))} AND {_ON('quote', R.MODERN)} AND NOT {_ON('quote', R.SOLD)} THEN 'company_strategy'",
       f"WHEN {_IN(R.NAMED_PAGES)} AND NOT {_ON('quote', R.TO_CUSTOMERS)} AND ((length(name) >= 4 AND ({_SAYS('name')} OR (len(w) > 1 AND length(w[1]) >= 4 AND lower(w[1]) NOT IN ({_COMMON}) AND {_SAYS('w[1]')}))) OR {_ON('quote', R.THE_COMPANY)}) THEN 'company_strategy'",
       f"WHEN page_type = 'homepage' OR {_ON('quote', R.SLOGANS[0])} OR {_ON('quote', R.SLOGANS[1])} THEN 'generic_marketing' WHEN {_ON('quote', R.TREND)} THEN 'industry_trend'"])
_SUBJECTS = _EVIDENCE + f", w AS (SELECT *, {_SHORT} AS w FROM e), j AS (SELECT * EXCLUDE (w), CASE {_SUBJECT} ELSE 'generic_marketing' END AS subject FROM w)"
_OWN, _FLOOR = "subject IN (" + ", ".join(f"'{x}'" for x in R.OWN_SUBJECTS) + ")", "subject IN (" + ", ".join(f"'{x}'" for x in R.FLOOR_SUBJECTS) + ")"
_SIGNALS = _SUBJECTS + f""", u AS (SELECT *, bool_or({_OWN}) OVER (PARTITION BY company) AS any_own FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY company, signal, left(quote, 60) ORDER BY seg_no, rule, pos) = 1)),
c AS (SELECT *, true AS is_own FROM u WHERE {_OWN} UNION ALL SELECT *, false FROM (SELECT * FROM u WHERE NOT any_own AND {_FLOOR} QUALIFY row_number() OVER (PARTITION BY company, signal ORDER BY seg_no, rule, pos) <= 2)),
g AS (SELECT company, signal, is_own, count(*) AS n, min(tier) AS best, arg_min(quote, (tier, seg_no, rule, pos)) AS best_quote FROM c GROUP BY ALL),
z AS (SELECT company, signal, CASE WHEN NOT is_own THEN 'weak' WHEN best = 1 THEN 'strong' WHEN best = 2 THEN 'moderate' ELSE 'weak' END AS strength, n, is_own AND (n >= 2 OR best = 1) AS validated, is_own, best AS best_tier, best_quote FROM g)"""


def _signals(spark, d):
    return S.signals(S.distinct_quotes(S.with_subject(S.evidence(_segments(spark, d), "company")), "company"), "company")


@query("EXT_2_rule_pack", _EVIDENCE + " SELECT company, seg_no, rule, nth::INT AS nth, pos, signal, tier, quote FROM e")
def _(spark, d):
    return S.evidence(_segments(spark, d), "company").select("company", "seg_no", "rule", "nth", "pos", "signal", "tier", "quote")


@query("CLS_4_subjects", _SUBJECTS + " SELECT company, seg_no, rule, pos, page_type, subject FROM j")
def _(spark, d):
    return S.with_subject(S.evidence(_segments(spark, d), "company")).select("company", "seg_no", "rule", "pos", "page_type", "subject")


@query("AGG_6_rule_pack_signals", _SIGNALS + " SELECT * FROM z")
def _(spark, d):
    return _signals(spark, d)


_MAP = ", ".join(f"('{s}', '{f}')" for s, f in R.SIGNAL_FACTORS)


@query("AGG_8_rule_pack_factors", _SIGNALS + f", f(signal, factor) AS (VALUES {_MAP}) SELECT company, factor, array_to_string(list_sort(list(DISTINCT signal)), '|') AS signals FROM z JOIN f USING (signal) GROUP BY ALL")
def _(spark, d):
    return S.factors(spark, _signals(spark, d), "company").select("company", "factor", F.array_join("signals", "|").alias("signals"))


_BANK = "regexp_matches(regexp_replace(text, '(?i)(?:data|food|test|word|blood|piggy|river)\\s(bank)', '_', 'g'), '(?i)\\bbank\\b')"
_FLAG = {name: " OR ".join(_BANK if "(?<!" in p else _ON("text", p) for p in patterns) for name, patterns in R.PROFILE}
_FLAG["retailer"] += f" OR ({_ON('text', R.CONSUMER_GOODS)} AND NOT {_ON('text', R.INDUSTRIAL_CONTEXT)})"
_PRIMARY = "CASE WHEN NOT software_saas AND industrial_vendor AND manufacturer THEN 'industrial_vendor_manufacturer' " + " ".join(f"WHEN {n} THEN '{n}'" for n in R.PRIMARY) + " ELSE 'unknown' END"


@query("EXT_7_profile_flags", f"""WITH {_SEGMENTS}, f AS (SELECT company, seg_no, text, {", ".join(f"({c}) AS {n}" for n, c in _FLAG.items())} FROM s)
SELECT * EXCLUDE (text), industrial_vendor OR services_provider OR software_saas OR {_ON('text', r'\b(?:b2b|enterprise\s+(?:client|customer|sale))\b')} AS sells_to_industry, retailer OR {_ON('text', r'\b(?:b2c|consumer|end\s+user)\b')} AS sells_to_consumers, manufacturer OR industrial_vendor OR retailer AS sells_physical_product,
{_ON('text', R.RESEARCH_CENTER)} AS has_rd_center, {_ON('text', R.ROBOTICS)} AS has_robotics_or_automation, {_ON('text', R.SOFTWARE_PLATFORM)} AS has_software_platform, {_PRIMARY} AS primary_type FROM f""")
def _(spark, d):
    return _segments(spark, d).select("company", "seg_no", S.profile(F.col("text")).alias("p")).select("company", "seg_no", "p.*")


# --- Services, drafts and proofs ------------------------------------------------------------------------------------------
_WORDS = [
    "We manually sort and triage claims; our field teams see data-driven plans. Our ERP is a robust base.",
    "No tool fits our growth plans. We use our own system and add to cart.",
    "We grow with new channels on Flipkart, and an error in the order process costs us. Monthly reports.",
    "Onboarding vendors is a challenge for partners; the process is fully automated, powered by Tableau.",
    "Our team writes posts weekly and uses Salesforce. AI is near, HQ has no visibility.",
    "Our insights drive a dealer network; several teams handle an approval workflow with AI-based tools.",
    "AI-driven CRM is already there; an AI - based plan, buyers and sellers.",
]
_ANY = lambda patterns: "(" + " OR ".join(_ON("x", p) for p in patterns) + ")"


def _need(service, ruled_out, threshold):
    return f"{{'service': '{service}', 'threshold': CASE WHEN {ruled_out} THEN 'none' {threshold} ELSE 'none' END, 'disqualified': {ruled_out}}}"


_NEEDS = [_need(s, "saas" if s == V.NOT_FOR_SAAS else _ANY([a]) if a else "false", f"WHEN {_ANY(st)} THEN 'strong' WHEN {_ANY(me)}{' AND growing' if s == V.GROWING_ONLY else ''} THEN 'medium' WHEN {_ANY(we)} THEN 'weak'") for s, a, st, me, we in V.BY_TEXT]
_NEEDS.append(_need(V.INTERNAL[0], _ANY([V.INTERNAL[1]]), f"WHEN plants >= 5 OR {_ANY([V.INTERNAL[2]])} THEN 'strong' WHEN plants >= 3 OR countries >= 3 THEN 'medium' WHEN plants > 1 THEN 'weak'"))
_NEEDS.append(_need(V.ANALYTICS[0], _ANY([V.ANALYTICS[1]]), f"WHEN plants > 1 AND ({_ANY([V.ANALYTICS[2]])} OR plants >= 5) THEN 'strong' WHEN plants > 1 THEN 'medium' WHEN {_ANY([V.ANALYTICS[3]])} THEN 'weak'"))
_NEEDS.append(_need(V.INTEGRATION[0], _ANY([V.INTEGRATION[1]]), f"WHEN {_ANY([V.INTEGRATION[2]])} AND {_ANY([V.INTEGRATION[3]])} THEN 'strong' WHEN {_ANY([V.INTEGRATION[2]])} THEN 'medium' WHEN {_ANY([V.INTEGRATION[4]])} THEN 'weak'"))


@query("EXT_10_service_needs", f"""
WITH x AS (SELECT doc_id, coalesce(text, '') || chr(10) || {picked("doc_id", _LIST(_WORDS))} AS x, doc_id % 13 = 0 AS saas, doc_id % 2 = 0 AS growing, doc_id % 8 AS plants, doc_id % 5 AS countries FROM documents),
n AS (SELECT doc_id, unnest([{", ".join(_NEEDS)}]) AS n FROM x) SELECT doc_id, n.service, n.threshold, n.disqualified FROM n""")
def _(spark, d):
    doc = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), chosen(doc, [F.lit(x) for x in _WORDS]))
    found = V_OPS.needs(text, doc % 13 == 0, doc % 2 == 0, doc % 8, doc % 5, doc % 8 > 1)
    return t(spark, d, "documents").select("doc_id", F.inline(found))


_DRAFTS = ", ".join(f"({i}, '{s}', '{c}', '{f}', {j}, '{x}', '{b}')" for i, (s, c, f, xs, b) in enumerate(V.DRAFTS) for j, x in enumerate(xs))


@query("GRD_10_drafts", _SIGNALS + f""", r2(place, service, category, fit, nth, signal, base) AS (VALUES {_DRAFTS}),
a AS (SELECT company, place, service, category, fit, base, string_agg(signal, '|' ORDER BY nth) AS triggers, min(best_tier) AS tier, arg_max(best_quote, (length(best_quote), -nth)) AS anchor FROM z JOIN r2 USING (signal) WHERE NOT (company % 3 = 0 AND service IN ({listed(V.FACTORY_ONLY)})) GROUP BY ALL)
SELECT company, service, category, fit, triggers, CASE WHEN tier = 1 AND base <> 'exploratory' THEN 'high' ELSE base END AS confidence, anchor FROM a QUALIFY row_number() OVER (PARTITION BY company ORDER BY place) <= {V.MOST_DRAFTS}""")
def _(spark, d):
    profiles = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).cast("long").alias("company")).distinct().withColumn("saas_only", F.col("company") % 3 == 0)
    return V_OPS.drafts(spark, _signals(spark, d), profiles, "company").withColumn("triggers", F.array_join("triggers", "|"))


@query("GRD_9_best_proofs", """
WITH c AS (SELECT DISTINCT c_custkey, unnest(['n' || c_nationkey % 5, 's' || c_mktsegment[1], 'k' || c_custkey % 7]) AS tag FROM customer), p AS (SELECT s_suppkey AS proof, s_suppkey % 2 AS provenance, unnest(['n' || s_nationkey % 5, 'k' || s_suppkey % 7, 'sB']) AS tag FROM supplier),
j AS (SELECT c_custkey, proof, provenance, count(*) AS score FROM c JOIN p USING (tag) GROUP BY ALL)
SELECT c_custkey, proof, score, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, provenance, proof) AS rank FROM j QUALIFY rank <= 2""")
def _(spark, d):
    tagged = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    companies = t(spark, d, "customer").select("c_custkey", F.array(tagged("n", F.col("c_nationkey") % 5), tagged("s", F.substring("c_mktsegment", 1, 1)), tagged("k", F.col("c_custkey") % 7)).alias("tags"))
    proofs = t(spark, d, "supplier").select(F.col("s_suppkey").alias("proof"), F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 2).alias("provenance"), F.array(tagged("n", F.col("s_nationkey") % 5), tagged("k", F.col("s_suppkey") % 7), F.lit("sB")).alias("tags"))
    return V_OPS.best_proofs(companies, proofs, "c_custkey")


_MODELS = ["Manufacturing", "Software/SaaS", "Engineering Services", "Distribution/Logistics", "Industrial Technology Vendor", "Other"]
_FACTORS = ["industry_40_initiative", "automation_keywords", "multi_location_operations", "capacity_expansion", "digital_transformation", "growth_signal", "ai_mention"]
_MASK = "CASE m " + " ".join(f"WHEN '{n}' THEN [{listed(x)}]" for n, x in V.MEANINGLESS) + " ELSE [] END"


@query("CLS_9_meaningful_factors", f"WITH x AS (SELECT p_partkey, {picked('p_partkey', _LIST(_MODELS))} AS m, [{listed(_FACTORS)}][1 + p_size % 4 : 3 + p_partkey % 5] AS f FROM part) SELECT p_partkey, array_to_string(list_filter(f, lambda v: NOT list_contains({_MASK}, v)), '|') AS factors FROM x")
def _(spark, d):
    start, stop = F.col("p_size") % 4 + 1, F.col("p_partkey") % 5 + 3
    some = F.slice(F.array(*[F.lit(x) for x in _FACTORS]), start.cast("int"), F.greatest(F.lit(0), stop - start + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", F.array_join(V_OPS.meaningful(some, chosen(F.col("p_partkey"), [F.lit(x) for x in _MODELS])), "|").alias("factors"))


_RUNS = "list_transform(generate_series(1, greatest(len(string_split(q, ' ')) - 3, 1)), lambda i: array_to_string(list_slice(string_split(q, ' '), i, i + 3), ' '))"
_SURE, _KIND = ["high", "unknown", "low"], ["observed", "inferred", "observed", "guess"]
_SQUEEZED = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@query("GRD_3_grounded_claims", f"""
WITH x AS (SELECT doc_id, {picked("doc_id", _LIST(_KIND))} AS kind, {picked("doc_id", _LIST(_SURE))} AS sure, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 't' || doc_id END AS title, doc_id % 11 = 0 AS thin, CASE WHEN doc_id % 3 = 0 THEN 'nobody' ELSE '' END || substr(text, 1 + doc_id % 5, 60 - doc_id % 40) AS evidence, text FROM documents),
k AS (SELECT *, {_SQUEEZED("evidence")} AS q, {_SQUEEZED("text")} AS c FROM x)
SELECT doc_id, title, CASE WHEN kind IN ('observed', 'inferred') THEN kind END AS claim_type, CASE WHEN sure IN ('high', 'medium', 'low') THEN sure ELSE 'low' END AS confidence FROM k
WHERE NOT thin AND title <> '' AND (kind <> 'observed' OR coalesce(length(trim(evidence)) >= 30 AND (contains(c, q) OR (len({QUOTE_WORDS}) >= 8 AND len(list_filter({QUOTE_WORDS}, lambda x: contains(c, x))) >= 0.75 * len({QUOTE_WORDS}) AND len(list_filter({_RUNS}, lambda g: contains(c, g))) > 0)), false))""")
def _(spark, d):
    doc = F.col("doc_id")
    evidence = F.concat(F.when(doc % 3 == 0, "nobody").otherwise(""), F.substr("text", (doc % 5 + 1).cast("int"), (60 - doc % 40).cast("int")))
    claims = t(spark, d, "documents").select("doc_id", F.when(doc % 7 == 0, "").otherwise(F.concat(F.lit("t"), doc.cast("string"))).alias("title"), chosen(doc, [F.lit(x) for x in _KIND]).alias("claim_type"), chosen(doc, [F.lit(x) for x in _SURE]).alias("confidence"), evidence.alias("evidence"), F.col("text").alias("content"), (doc % 11 == 0).alias("is_thin"))
    return grounding.grounded_claims(claims).select("doc_id", "title", "claim_type", "confidence")


_GAP = "repeat('x ', 80)"
_TITLES = ["w1 || ' ' || upper(w2)", "w2 || ' home'", "'about us'", "w1 || 's'", "''"]
_BODIES = ["w1 || ' and ' || w2", f"w1 || ' ' || {_GAP} || w2", f"w1 || ' ' || {_GAP} || w2 || ' by ' || w1", "w2"]
_SHARE = lambda c: f"len(list_filter(w, lambda v: regexp_matches({c}, '(?i)\\b' || v || '\\b'))) / len(w)"
_NEAR = f"len(list_filter(range(1, len(parts)), lambda i: len(list_filter(w, lambda v: regexp_matches(substr(body, greatest(list_sum(list_transform(parts[1:i], lambda x: length(x)))::INT + (i - 1) * length(w1) - {grounding.BESIDE}, 0) + 1, least(list_sum(list_transform(parts[1:i], lambda x: length(x)))::INT + (i - 1) * length(w1), {grounding.BESIDE}) + length(w1) + {grounding.BESIDE}), '(?i)\\b' || v || '\\b'))) = len(w))) > 0"


@query("GRD_7_site_identity", f"""
WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
x AS (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN [w1] ELSE [w1, w2] END AS w, {picked("p_partkey", _TITLES)} AS title, {picked("p_partkey // 5", _BODIES)} AS body FROM n),
k AS (SELECT *, regexp_split_to_array(body, '(?i)\\b' || w1 || '\\b') AS parts FROM x)
SELECT p_partkey, CASE WHEN {_SHARE("title")} = 1 THEN 'high' WHEN len(w) <= 1 THEN 'none' WHEN {_SHARE("title")} >= 0.5 THEN 'medium' WHEN {_SHARE("body")} = 1 AND {_NEAR} THEN 'medium' ELSE 'none' END AS identity FROM k""")
def _(spark, d):
    one, two, gap = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("x " * 80)
    words = F.when(F.col("p_partkey") % 6 == 0, F.array(one)).otherwise(F.array(one, two))
    title = chosen(F.col("p_partkey"), [F.concat(one, F.lit(" "), F.upper(two)), F.concat(two, F.lit(" home")), F.lit("about us"), F.concat(one, F.lit("s")), F.lit("")])
    body = chosen(F.floor(F.col("p_partkey") / 5), [F.concat(one, F.lit(" and "), two), F.concat(one, F.lit(" "), gap, two), F.concat(one, F.lit(" "), gap, two, F.lit(" by "), one), two])
    rows = t(spark, d, "part").select("p_partkey", words.alias("w"), title.alias("title"), body.alias("body"))
    return rows.select("p_partkey", grounding.site_identity(F.col("w"), F.col("title"), F.lit(None).cast("string"), F.col("body")).alias("identity"))
