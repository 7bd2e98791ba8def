"""Registered queries on text blobs: segments, leaders, and the rule pack over parsed segments, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import guards as G
from granary.functions import signal_rules as R
from granary.operators import segments as P
from granary.operators import signals as S
from granary.plans.more import STRIP, chosen, listed, picked, q
from granary.plans.registry import query, t
from granary.plans.signals import _LIST, _PLACES, _SAID, evidence_sql

# each text once more with people in it, some by heading and portfolio, some by their place alone
_PEOPLE = [
    "### Ram Bhogale\n\n#### Chairman\nAfter many years in the field he heads the Process Automation and Water businesses. More text.",
    "Björn Müller\nGeschäftsführer\n\nFrançois Dubois, Directeur Général",
    "**Étienne Noir**\n**Président\n\nQuality Control\nDirector\n\nJohn Smith | Chief Operating Officer",
    "# Anna Lee\nCEO\nNo portfolio is told here",
    "# Anna Lee\nCEO\nAnna Lee oversees the Global Finance team for the entire group\n\nAnna Lee, CEO",
    "- Mary-Jane O'Neil – Head of Human Capital & Change\nJosé García\nConsejero Delegado",
    "## Our Team\nVice President of nothing; leads a small group of people here and there and everywhere",
    "Pieter de Vries, Voorzitter\nMario Rossi - Amministratore Delegato\nnot A Name, VP",
    "# Ab\nDirector\n" + "He reads. " * 80 + "He manages the Far Away Department and more.",
    "Ram Bhogale, Chairman\nJoão Silva\nDiretor Geral\n> Pia Berg\n\n> Vorstandsvorsitzende",
]
_MARKS = ["", "--- PAGE: / (https://x.example) ---\n", "--- PAGE: /about-us (https://x.example/about-us) ---\n", "--- page:  /careers/open\t---\n", "--- PAGE: /investor/ar (https://x.example/ar?a=1) --- \n", "--- PAGE: x ---\n"]
_SOURCES = [
    "", "\n[SOURCE: Annual report (high) | tier1 | https://y.example/a]\nWe are entering the capital market and expanding globally. ", "\n[SOURCE: jobs board | Tier2 |https://y.example/b ]  \n\nOur team runs a new plant, a new facility and a new campus.\n[SOURCE: blog | tier3 | https://y.example/c]\n  ",
    "\n[SOURCE: press release|tier1|u]\n# Late Comer\nCFO\nShe led the Group Treasury of all plants.", "\n[SOURCE: broken | tierX | u]\nnothing", "\n--- PAGE: /news (https://x.example/news) ---\n",
]

_BLOBS = f"b AS (SELECT doc_id, {picked('doc_id', _LIST(_MARKS))} || text || chr(10) || {picked('doc_id', _LIST(_PEOPLE))} || chr(10) || {picked('doc_id // 3', _LIST(_MARKS))} || {picked('doc_id // 5', _LIST(_SAID))} || chr(10) || {picked('doc_id // 7', _LIST(_PEOPLE))} || {picked('doc_id // 2', _LIST(_SOURCES))} AS content FROM documents)"
_PAGE_TYPE = "CASE WHEN coalesce(path, '') = '' THEN 'homepage' " + " ".join(f"WHEN regexp_matches(lower(path), '{q(p)}') THEN '{n}'" for n, p in R.PAGE_TYPES) + " ELSE 'other' END"
_SOURCE_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(label, '(?i){p}') THEN '{n}'" for n, p in P.SOURCE_PAGES) + " ELSE 'other' END"
_SEGMENTS = f"""{_BLOBS},
pp AS (SELECT doc_id, i, parts[i + 1] AS part FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, regexp_split_to_array(content, '(?i){P.PAGE_MARK}') AS parts FROM b))),
ph AS (SELECT *, {STRIP(f"regexp_extract(part, '^{P.PAGE_HEAD}', 1)")} AS head, regexp_replace(part, '^{P.PAGE_HEAD}', '') AS body FROM pp WHERE regexp_matches(part, '^{P.PAGE_HEAD}')),
pg AS (SELECT doc_id, i, CASE WHEN regexp_matches(head, '\\([^)]+\\)') THEN regexp_extract(head, '\\(([^)]+)\\)', 1) ELSE head END AS url, CASE WHEN regexp_matches(head, '\\([^)]+\\)') THEN {STRIP("regexp_extract(head, '^(.*?)\\([^)]+\\)', 1)")} ELSE head END AS path, {STRIP("body")} AS text FROM ph),
sp AS (SELECT doc_id, i, parts[i + 1] AS part FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, regexp_split_to_array(content, '(?i){P.SOURCE_MARK}') AS parts FROM b))),
sg AS (SELECT doc_id, i, {STRIP(f"regexp_extract(part, '(?i)^{P.SOURCE_HEAD}', 3)")} AS url, {STRIP(f"regexp_replace(part, '(?i)^{P.SOURCE_HEAD}', '')")} AS text, {STRIP(f"regexp_extract(part, '(?i)^{P.SOURCE_HEAD}', 1)")} AS label, right(regexp_extract(part, '(?i)^{P.SOURCE_HEAD}', 2), 1)::INT AS tier FROM sp WHERE regexp_matches(part, '(?i)^{P.SOURCE_HEAD}')),
al AS (SELECT doc_id, 0 AS k, i, url, path, text, {_PAGE_TYPE} AS page_type, NULL::INT AS tier FROM pg WHERE text <> '' UNION ALL SELECT doc_id, 1, i, url, NULL, text, {_SOURCE_TYPE}, tier FROM sg WHERE text <> ''),
no AS (SELECT doc_id, 0, 0, '', NULL, content, 'homepage', 3 FROM b WHERE {STRIP("content")} <> '' AND NOT EXISTS (FROM al WHERE al.doc_id = b.doc_id)),
s AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1)::INT AS seg_no, url, path, text, page_type, coalesce(tier, CASE WHEN page_type IN ('careers', 'investor', 'annual_report', 'press') THEN 1 WHEN page_type IN ('about', 'blog') THEN 2 ELSE 3 END) AS seg_tier FROM (FROM al UNION ALL FROM no))"""


def _segments(spark, d):
    doc, text = F.col("doc_id"), lambda values, key: chosen(key, [F.lit(x) for x in values])
    part = lambda n: F.floor(doc / n).cast("long")
    line = F.lit("\n")
    content = F.concat(text(_MARKS, doc), "text", line, text(_PEOPLE, doc), line, text(_MARKS, part(3)), text(_SAID, part(5)), line, text(_PEOPLE, part(7)), text(_SOURCES, part(2)))
    return P.segments(t(spark, d, "documents").select("doc_id", content.alias("content")), "doc_id")


@query("EXT_1_segments", f"WITH {_SEGMENTS} SELECT doc_id, seg_no, url, path, md5(text) AS text_md5, page_type, seg_tier AS tier FROM s")
def _(spark, d):
    return _segments(spark, d).select("doc_id", "seg_no", "url", "path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "page_type", "tier")


_EVIDENCE = evidence_sql(_SEGMENTS.replace("s AS (SELECT doc_id,", "s AS (SELECT doc_id AS company,"), "seg_tier")


@query("EXT_2_parsed_segments", _EVIDENCE + " SELECT company, seg_no, rule, nth::INT AS nth, pos, page_type, signal, tier, quote FROM e")
def _(spark, d):
    parts = _segments(spark, d).withColumnsRenamed({"doc_id": "company"}).withColumn("name", F.lit(None).cast("string")).withColumn("is_vendor", F.lit(False))
    return S.evidence(parts, "company").select("company", "seg_no", "rule", "nth", "pos", "page_type", "signal", "tier", "quote")


_END = "(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))))::INT"
_PERSON = f"len(regexp_split_to_array(name, '\\s+')) BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: lower(w) IN ({listed(G.NON_NAME_WORDS)}))) = 0"
_NARRATED = f"""WITH {_SEGMENTS},
h AS (SELECT doc_id, seg_no, url, text, regexp_extract_all(text, '{P.HEADED}', 0) AS found, regexp_extract_all(text, '{P.HEADED}', 1) AS names, regexp_extract_all(text, '{P.HEADED}', 2) AS titles, regexp_split_to_array(text, '{P.HEADED}') AS parts FROM s WHERE regexp_matches(text, '{P.HEADED}')),
hi AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM h),
hw AS (SELECT doc_id, seg_no, url, i, {STRIP("names[i]")} AS name, {STRIP("titles[i]")} AS title, {STRIP(f"regexp_extract(substr(text, 1 + {_END}, {P.WITHIN}), '(?i){P.PORTFOLIO}', 1)")} AS portfolio FROM hi),
told AS (SELECT doc_id, name, unnest(arg_min({{'title': title, 'portfolio': portfolio, 'url': url}}, (seg_no, i))) FROM hw WHERE portfolio <> '' GROUP BY doc_id, name)"""


@query("EXT_5_narrated_leaders", _NARRATED + " SELECT doc_id, name, title, portfolio, url FROM told")
def _(spark, d):
    return P.narrated_leaders(_segments(spark, d), "doc_id")


_PLACED = _NARRATED + f""",
l AS (SELECT doc_id, seg_no, url, regexp_extract_all(text, '(?m){q(P.BESIDE)}', 1) AS names, regexp_extract_all(text, '(?m){q(P.BESIDE)}', 2) AS titles FROM s),
li AS (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM l),
lw AS (SELECT doc_id, seg_no, url, i, {STRIP("names[i]")} AS name, {STRIP("titles[i]")} AS title FROM li),
placed AS (SELECT doc_id, name, unnest(arg_min({{'title': title, 'url': url}}, (seg_no, i))) FROM lw WHERE {_PERSON} AND NOT EXISTS (FROM told WHERE told.doc_id = lw.doc_id AND told.name = lw.name) GROUP BY doc_id, name)"""


@query("EXT_6_leaders", _PLACED + " SELECT doc_id, name, title, portfolio, url, 'high' AS confidence FROM told UNION ALL SELECT doc_id, name, title, '', url, 'medium' FROM placed")
def _(spark, d):
    return P.leaders(_segments(spark, d), "doc_id")
