"""Registered queries on answers of models and vendors, filings, audits and why-now floors, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import grounding, scoring
from granary.operators import responses as O
from granary.plans.more import STRIP, chosen, listed, picked, q
from granary.plans.registry import query, t

# --- JSON of unknown shape; @ stands for the document's words, which hold letters and spaces alone ---------------------------
_JSON = [
    '{"services": ["pumps", " @ ", "", 7, null], "ideal_customers": "  makers ", "market_positioning": 3, "EVIDENCE": {"services": ["inner"], "extra": true}}',
    '{"company_profile": {"services": ["one"], "name": "inner"}, "PROFILE": {"services": ["later"], "size": 5}, "services": ["outer"], "SIGNALS": [1, 2], "target_company_size": "@"}',
    '{"SIGNALS": [1], "METADATA": "plain", "services": "no list", "ideal_customers": "   "}', "not json {", '["an", "array"]', '{"URGENCY": {"deep": {"er": "@"}, "list": [{"a": 1}]}, "URGENCY ": {"kept": 1.5}, "business_outcomes": ["@", "b"]}', "{}", '{"Scoring": {}, "x": null}',
]
_WORDS = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
_RAW = f"SELECT doc_id, replace({picked('doc_id', ['' + chr(39) + q(x) + chr(39) for x in _JSON])}, '@', {_WORDS}) AS raw FROM documents"
_OBJECTS = f"r AS (SELECT doc_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS j FROM ({_RAW}))"
_TYPE = lambda c: f"CASE json_type({c}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def _raw(spark, d):
    words = F.regexp_replace("text", "[^A-Za-z ]", "")
    return t(spark, d, "documents").select("doc_id", F.replace(chosen(F.col("doc_id"), [F.lit(x) for x in _JSON]), F.lit("@"), words).alias("raw"))


@query("TXT_25_flat_fields", f"""WITH {_OBJECTS},
a AS (SELECT doc_id, k AS name, json_extract(j, '$."' || k || '"') AS value, coalesce(list_position([{listed(O.SECTIONS)}], k), 0) AS place FROM (SELECT *, unnest(json_keys(j)) AS k FROM r)),
w AS (SELECT *, bool_or(place > 0 AND json_type(value) = 'OBJECT') OVER (PARTITION BY doc_id) AS wrapped FROM a),
f AS (SELECT doc_id, k AS name, json_extract(value, '$."' || k || '"') AS value, place FROM (SELECT *, unnest(json_keys(value)) AS k FROM w WHERE place > 0 AND json_type(value) = 'OBJECT') UNION ALL SELECT doc_id, name, value, 99 FROM w WHERE NOT wrapped OR place = 0)
SELECT doc_id, name, {_TYPE("value")} AS kind, CASE WHEN json_type(value) = 'VARCHAR' THEN value ->> '$' END AS text FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY place DESC) = 1""")
def _(spark, d):
    return O.fields(_raw(spark, d), "doc_id", "raw").select("doc_id", "name", O.kind_of(F.col("value")).alias("kind"), O.text_of(F.col("value")).alias("text"))


_LIST = lambda n: f"array_to_string(list_filter(list_transform(CASE WHEN json_type(j, '$.{n}') = 'ARRAY' THEN json_extract(j, '$.{n}[*]') ELSE [] END, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN {STRIP('(x ->> ' + chr(39) + '$' + chr(39) + ')')} END), lambda x: x IS NOT NULL AND x <> ''), '|') AS {n}"
_ONE = lambda n: f"coalesce(CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' THEN {STRIP('(j ->> ' + chr(39) + '$.' + n + chr(39) + ')')} END, '') AS {n}"


@query("UDF_4_business_profiles", f"WITH {_OBJECTS}, p AS (SELECT doc_id, {', '.join(map(_LIST, O.LISTS))}, {', '.join(map(_ONE, O.TEXTS))} FROM r) SELECT *, {' || '.join(O.LISTS + O.TEXTS)} = '' AS is_empty FROM p")
def _(spark, d):
    found = O.profiles(_raw(spark, d), "doc_id", "raw")
    return found.select("doc_id", *[F.array_join(n, "|").alias(n) for n in O.LISTS], *O.TEXTS, "is_empty")


# --- A vendor's answer, kept or fresh ----------------------------------------------------------------------------------------
_PARTS = {
    "email": ['"email": {"email": "@", "status": "VERIFIED"}', '"email": {"email": "@", "revealed": false}', '"email": {"email": "@"}', '"email": null', '"email": {"email": "", "status": "x"}'],
    "jobs": ['"job_history": [{"title": "t0", "current": false, "seniority": "vp"}, {"title": "t1", "current": true, "seniority": "head", "departments": ["d1", "d2"]}]', '"job_history": []', '"job_history": [{"title": "t2"}]'],
    "rest": ['"location": {"city": "A", "country": "C"}, "headline": "h"', '"location": {"city": "", "state": null}', '"current_job_title": "now"', '"headline": ""'],
    "company": ['"company": {"industry": "steel", "employee_range": "11-50"}', '"company": null', '"company": {"industry": ""}'],
}
_ANSWERS = ["{\"person\": {#email, #jobs, #rest}, #company}", "{\"person\": {#email, #jobs, #rest}, #company}", "{\"error\": true, \"error_code\": \"NO_MATCH\"}", "{\"error\": true}", "broken", "{\"error\": false, \"person\": null}", "{\"person\": {#jobs, #email, #rest}}"]
_SQL_ANSWER = picked("c_custkey // 2", [f"'{q(x)}'" for x in _ANSWERS])
for _n, (_name, _options) in enumerate(_PARTS.items()):
    _SQL_ANSWER = f"replace({_SQL_ANSWER}, '#{_name}', {picked(f'(c_custkey // {_n + 1})', [chr(39) + q(x) + chr(39) for x in _options])})"
_SQL_ANSWER = f"replace({_SQL_ANSWER}, '@', 'c' || c_custkey || '@x.example')"
_TEXT = lambda path: f"(j ->> '$.{path}')"
_SAID = lambda c: f"nullif({c}, '')"
_CONTACTS = f"""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'small' END AS known_size, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS known_industry, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM (SELECT *, {_SQL_ANSWER} AS raw FROM customer)),
x AS (SELECT *, coalesce({_TEXT('error')}::BOOLEAN, false) AS failed, coalesce(list_filter(json_extract(j, '$.person.job_history[*]'), lambda o: coalesce((o ->> '$.current')::BOOLEAN, false))[1], json_extract(j, '$.person.job_history[0]')) AS job FROM a)"""


def _answers(spark, d):
    key = F.col("c_custkey")
    raw = chosen(F.floor(key / 2).cast("long"), [F.lit(x) for x in _ANSWERS])
    for n, (name, options) in enumerate(_PARTS.items()):
        raw = F.replace(raw, F.lit("#" + name), chosen(F.floor(key / (n + 1)).cast("long"), [F.lit(x) for x in options]))
    return t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.replace(raw, F.lit("@"), F.concat(F.lit("c"), key.cast("string"), F.lit("@x.example"))).alias("raw"))


@query("GRD_14_contact_emails", _CONTACTS + f""", s AS (SELECT *, {_TEXT('person.email.email')} AS mail, CASE WHEN j IS NULL THEN 'error' WHEN failed AND {_TEXT('error_code')} = 'NO_MATCH' THEN 'not_found' WHEN failed THEN 'error' WHEN coalesce({_TEXT('person.email.email')}, '') = '' OR coalesce(NOT {_TEXT('person.email.revealed')}::BOOLEAN, false) THEN 'not_found' ELSE 'found' END AS status FROM x)
SELECT c_custkey, status, CASE WHEN status = 'found' THEN mail END AS email, CASE WHEN status <> 'found' THEN 'none' WHEN regexp_matches(coalesce({_TEXT('person.email.status')}, ''), '(?i)verif') THEN 'high' ELSE 'medium' END AS confidence FROM s""")
def _(spark, d):
    return _answers(spark, d).select("c_custkey", O.contact_email(F.col("raw")).alias("x")).select("c_custkey", "x.*")


@query("GRD_14_contact_details", _CONTACTS + f""", y AS (SELECT *, j IS NULL OR failed OR coalesce(json_type(j, '$.person'), 'NULL') = 'NULL' AS lost, job ->> '$.seniority' AS sen, coalesce({_SAID(_TEXT('company.employee_range'))}, known_size) AS size, coalesce({_SAID(_TEXT('company.industry'))}, known_industry) AS ind FROM x),
z AS (SELECT *, {_SAID('sen')} IS NOT NULL OR {_SAID('ind')} IS NOT NULL OR {_SAID(_TEXT('person.headline'))} IS NOT NULL AS substance FROM y)
SELECT c_custkey, CASE WHEN lost THEN 'not_found' WHEN substance THEN 'enriched' ELSE 'partial' END AS status, CASE WHEN NOT lost THEN job ->> '$.departments[0]' END AS department, CASE WHEN NOT lost THEN sen END AS seniority,
 CASE WHEN NOT lost THEN {_SAID("array_to_string(list_filter([" + ", ".join(_TEXT("person.location." + n) for n in ("city", "state", "country")) + "], lambda v: v <> ''), ', ')")} END AS location, CASE WHEN NOT lost THEN coalesce({_TEXT('person.current_job_title')}, job ->> '$.title') END AS role, CASE WHEN NOT lost THEN {_TEXT('person.headline')} END AS headline,
 CASE WHEN NOT lost THEN size END AS company_size, CASE WHEN NOT lost THEN ind END AS industry, CASE WHEN lost OR NOT substance THEN 'low' WHEN {_SAID('sen')} IS NOT NULL AND {_SAID('ind')} IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM z""")
def _(spark, d):
    key = F.col("c_custkey")
    return _answers(spark, d).select("c_custkey", O.contact_details(F.col("raw"), F.when(key % 3 == 0, "small"), F.when(key % 4 == 0, F.col("c_mktsegment"))).alias("x")).select("c_custkey", "x.*")


# --- Filings -----------------------------------------------------------------------------------------------------------------
_FORMS = ["10-K", "8-K", "10-Q", "4", "DEF 14A", "4", "SC 13G", "S-1", "4", "424B5", "10-Q"]


@query("SRC_15_filings", f"""WITH f AS (SELECT o_custkey, {picked("o_orderkey", [f"'{x}'" for x in _FORMS])} AS form, strftime(o_orderdate, '%Y-%m') AS filed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders),
c AS (SELECT *, form IN ({listed(O.SIGNAL_FORMS)}) AS is_signal FROM f WHERE place <= {O.LATEST})
SELECT o_custkey, form, filed, place, row_number() OVER (PARTITION BY o_custkey ORDER BY is_signal DESC, filed DESC, place) AS nth, is_signal FROM c""")
def _(spark, d):
    listed_ = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = t(spark, d, "orders").select("o_custkey", chosen(F.col("o_orderkey"), [F.lit(x) for x in _FORMS]).alias("form"), F.date_format("o_orderdate", "yyyy-MM").alias("filed"), F.row_number().over(listed_).alias("place"))
    return O.ranked_filings(rows, "o_custkey")


# --- Audit of all kinds of items, and the why-now floor ------------------------------------------------------------------------
_KINDS = ["opportunity", "pain_point", "competitor", "icp_segment"]


@query("AGG_21_four_kinds", f"""WITH i AS (SELECT o_custkey AS company, {picked("o_orderkey", [f"'{x}'" for x in _KINDS])} AS kind, o_orderkey::VARCHAR AS ref, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 40 END AS evidence_id, {picked("o_orderkey // 4", ["'high'", "'High'", "'low'", "NULL"])} AS confidence, CASE WHEN o_orderkey % 6 = 0 THEN 'High' END AS relevance, o_orderkey % 3 AS n_urls, o_orderkey % 7 = 0 AS is_self FROM orders),
l AS (SELECT * FROM i WHERE kind IN ('opportunity', 'pain_point') AND evidence_id IS NOT NULL), n AS (SELECT * FROM i WHERE kind NOT IN ('opportunity', 'pain_point')),
f AS (SELECT company, kind, ref FROM l WHERE (lower(confidence) = 'high' OR (kind = 'opportunity' AND relevance = 'High')) AND evidence_id % 4 = 1 UNION ALL SELECT company, kind, ref FROM n WHERE confidence = 'high' AND n_urls < 2 UNION ALL SELECT company, kind, ref FROM n WHERE is_self)
SELECT company, count(*) AS audited, coalesce(any_value(flagged), 0) AS flagged FROM (SELECT company FROM l UNION ALL SELECT company FROM n) LEFT JOIN (SELECT company, count(DISTINCT (kind, ref)) AS flagged FROM f GROUP BY 1) USING (company) GROUP BY company""")
def _(spark, d):
    key = F.col("o_orderkey")
    items = t(spark, d, "orders").select(F.col("o_custkey").alias("company"), chosen(key, [F.lit(x) for x in _KINDS]).alias("kind"), key.cast("string").alias("ref"), F.when(key % 5 > 0, key % 40).alias("evidence_id"), chosen(F.floor(key / 4).cast("long"), [F.lit("high"), F.lit("High"), F.lit("low"), F.lit(None).cast("string")]).alias("confidence"), F.when(key % 6 == 0, "High").alias("relevance"), (key % 3).alias("n_urls"), (key % 7 == 0).alias("is_self"))
    evidence = t(spark, d, "orders").select((key % 40).alias("evidence_id")).distinct().withColumn("subject", F.when(F.col("evidence_id") % 4 == 1, "product_capability").otherwise("company_strategy"))
    claims = F.col("kind").isin("opportunity", "pain_point")
    return grounding.audit(items.where(claims), items.where(~claims), evidence)[1]


_NARRATED = ["a new plant opens", "EXPANDING INTO Asia", "its digital transformation  roadmap", "AI-powered digitalisation", "was acquired", "nothing", "investing in automation", "greenfield and industry4.0", None]


@query("AGG_15_effective_why_now", f"""WITH x AS (SELECT doc_id, doc_id % 8 AS score, lower(coalesce(text, '') || ' ' || coalesce({picked("doc_id", ["NULL" if x is None else f"'{x}'" for x in _NARRATED])}, '')) AS s FROM documents)
SELECT doc_id, greatest(score, CASE {" ".join(f"WHEN regexp_matches(s, '{q(p)}') THEN {n}" for n, p in scoring.NARRATIVE_FLOORS)} ELSE 0 END) AS score FROM x""")
def _(spark, d):
    doc = F.col("doc_id")
    return t(spark, d, "documents").select("doc_id", scoring.effective_why_now(doc % 8, F.col("text"), chosen(doc, [F.lit(x).cast("string") for x in _NARRATED])).alias("score"))
