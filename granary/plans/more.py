"""Further registered queries: URL preparation, guards, sources, scores, grounding and state, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import guards as G
from granary.functions import sourcing as S
from granary.functions import text as X
from granary.functions import url as U
from granary.operators import content, entity, events, evidence, scoring, web
from granary.plans.registry import HOST, LOCALES, NOW, PATH, POINTS, RULES, SEGS, _evidence, query, t
from granary.sources import leads


def q(pattern: str) -> str:
    """A pattern as a SQL literal's content."""
    return pattern.replace("'", "''")


def listed(words) -> str:
    return ", ".join("'" + q(w) + "'" for w in words)


def cases(column: str, table, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table) + f" ELSE {default} END"


def picked(key: str, values: list) -> str:
    """SQL: the value whose place is the key modulo their number."""
    return f"([{', '.join(values)}])[1 + {key} % {len(values)}]"


def chosen(key, values: list):
    return F.element_at(F.array(*values), (key % len(values) + 1).cast("int"))


STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

# --- URLs -----------------------------------------------------------------------------------------------------------------
_RAW = picked("page_id", ["url", "' ' || url || ' '", "regexp_replace(url, '^https?://', '')", "'ftp://' || url", "'http://localhost:80/' || page_id", "'192.168.0.' || (page_id % 9)", "regexp_replace(url, '^https?://[^/]*', 'https://sites.google.com/view')", "'nodots'"])


@query("URL_1_normalised", f"""
WITH r AS (SELECT page_id, {STRIP(_RAW)} AS t FROM pages), u AS (SELECT *, CASE WHEN t LIKE 'http://%' OR t LIKE 'https://%' THEN t ELSE 'https://' || t END AS url FROM r),
a AS (SELECT *, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS authority FROM u), n AS (SELECT *, regexp_replace(authority, ':\\d+$', '') AS name FROM a)
SELECT page_id, CASE WHEN t = '' OR regexp_matches(t, '\\s') OR (regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') AND NOT regexp_matches(t, '^https?://')) OR name IN ('localhost', '127.0.0.1', '::1') OR suffix(name, '.local') OR regexp_matches(name, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') OR NOT contains(name, '.') THEN NULL
  WHEN {" OR ".join(f"contains(name, '{p}')" for p in U.HOSTED_PLATFORMS)} THEN regexp_replace(regexp_extract(url, '^(https?://)', 1) || authority || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/$', '')
  ELSE regexp_extract(url, '^(https?://)', 1) || authority END AS normalised FROM n""")
def _(spark, d):
    url, key = F.col("url"), F.col("page_id")
    raw = chosen(key, [url, F.concat(F.lit(" "), url, F.lit(" ")), F.regexp_replace(url, "^https?://", ""), F.concat(F.lit("ftp://"), url), F.concat(F.lit("http://localhost:80/"), key.cast("string")), F.concat(F.lit("192.168.0."), (key % 9).cast("string")), F.regexp_replace(url, "^https?://[^/]*", "https://sites.google.com/view"), F.lit("nodots")])
    return t(spark, d, "pages").select("page_id", U.normalised(raw).alias("normalised"))


@query("URL_3_domain_by_split", "SELECT page_id, string_split(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/')[1] AS domain FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", U.domain_by_split(F.col("url")).alias("domain"))


@query("URL_4_join_and_tests", f"SELECT page_id, regexp_replace(url, '/+$', '') || '/about' AS joined, suffix(lower({PATH}), '.pdf') AS pdf FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", U.join_url(F.col("url"), F.lit("/about")).alias("joined"), U.is_pdf(F.col("url")).alias("pdf"))


@query("URL_8_same_site_links", f"""
WITH l AS (SELECT page_id, {HOST} AS site, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)', 1))) AS href, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base FROM pages),
u AS (SELECT page_id, site, CASE WHEN prefix(href, '/') THEN base || href ELSE href END AS url FROM l WHERE prefix(href, '/') OR prefix(href, 'http')),
p AS (SELECT *, {HOST} AS h, {PATH} AS path FROM u)
SELECT page_id, count(DISTINCT regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || path, '/$', '')) AS n FROM p
WHERE h = site AND path <> '/' AND NOT regexp_matches(path, '{q(U.ASSETS)}') AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 5 AND NOT regexp_matches(path, '/\\d{{4}}/\\d{{2}}') GROUP BY 1""")
def _(spark, d):
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)))).alias("href")
    links = t(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("site"), F.regexp_extract("url", "^(https?://[^/?#]*)", 1).alias("base"), href).where("href LIKE '/%' OR href LIKE 'http%'")
    found = links.select("page_id", U.links_of_site(F.when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.col("href")), F.col("site")).alias("link"))
    return found.where("link IS NOT NULL").groupBy("page_id").agg(F.count_distinct("link").alias("n"))


_B2C = "(" + " + ".join(f"(regexp_matches(content, '(?i){q(p)}'))::INT" for p in U.B2C_CONTENT) + ")"
_B2C_TEXT = picked("page_id", ["''", "'Test drive, find a dealer, MSRP. '", "'Monthly payment and financing options. '", "'Schedule service; compare cars; locate a dealer '"])


@query("URL_12_consumer_sites", f"""
WITH p AS (SELECT {HOST} AS site, {_B2C_TEXT} || html AS content, list_transform(regexp_extract_all(html, 'href="([^"#]+)', 1), lambda x: x || CASE page_id % 5 WHEN 0 THEN '/test-drive' ELSE '' END) AS links FROM pages),
e AS (SELECT site, {_B2C} AS c, len(list_filter(links, lambda x: regexp_matches(x, '(?i){q("|".join(U.B2C_LINKS))}'))) AS l FROM p)
SELECT site, max(c)::INT AS content_hits, max(l)::INT AS link_hits, max(c) >= 3 OR max(l) >= 3 AS is_b2c FROM e GROUP BY 1""")
def _(spark, d):
    said = chosen(F.col("page_id"), [F.lit(""), F.lit("Test drive, find a dealer, MSRP. "), F.lit("Monthly payment and financing options. "), F.lit("Schedule service; compare cars; locate a dealer ")])
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)), lambda x: F.concat(x, F.when(F.col("page_id") % 5 == 0, "/test-drive").otherwise("")))
    return web.consumer_sites(t(spark, d, "pages").select(U.host(F.col("url")).alias("site"), F.concat(said, "html").alias("content"), links.alias("links")))


_ALLOW = listed(U.B2C_CATEGORIES)


@query("URL_11_rank_corporate_pages", f"""
WITH {LOCALES}, s AS (SELECT g.site, url, category, CASE WHEN n IS NOT NULL AND NOT (segment = 'en' OR suffix(segment, '-en')) THEN greatest(0, ({POINTS}) - 40) ELSE {POINTS} END AS score FROM g LEFT JOIN loc USING (site, segment))
SELECT site, url, category, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank FROM s WHERE NOT prefix(site, 'blog') OR category IN ({_ALLOW}) QUALIFY rank <= 15""")
def _(spark, d):
    pages = t(spark, d, "pages")
    consumer = pages.select(U.host(F.col("url")).alias("site")).where("site LIKE 'blog%'").distinct()
    return web.rank_corporate_pages(pages, consumer).select("site", "url", "category", "score", "rank")


@query("URL_13_discovery", f"""
WITH p AS (SELECT {HOST} AS site, url, {PATH} AS path, {picked("page_id", ["'map'", "'sitemap'", "'link'"])} AS origin, page_id FROM pages), c AS (SELECT site, origin, {picked("page_id", ["'corporate'", "'careers'", "'media'", "'other'"])} AS category, page_id % 100 AS score FROM p WHERE NOT (prefix(site, 'm') AND origin = 'map')),
a AS (SELECT site, count(*) FILTER (origin = 'map') AS m, count(*) FILTER (origin = 'sitemap') AS s, count(*) FILTER (origin = 'link') AS l, count(*) FILTER (score >= 70) AS high, count(DISTINCT category) AS k FROM c GROUP BY 1)
SELECT site, CASE WHEN m > 0 THEN 'map_url' WHEN s > 3 THEN 'sitemap' WHEN l > 0 THEN 'links' ELSE 'homepage' END AS method, high < 4 OR k < 3 AS probe FROM a""")
def _(spark, d):
    key = F.col("page_id")
    p = t(spark, d, "pages").select(U.host(F.col("url")).alias("site"), chosen(key, [F.lit("map"), F.lit("sitemap"), F.lit("link")]).alias("origin"), chosen(key, [F.lit(x) for x in ("corporate", "careers", "media", "other")]).alias("category"), (key % 100).alias("score"))
    return web.discovery(p.where("NOT (site LIKE 'm%' AND origin = 'map')"))


_HOSTS = picked("page_id", ["h", "h || '.gov'", "'en.wikipedia.org'", "'x.gov.in'", "'notg2.com'", "'www.g2.com'", "'mit.edu'"])


@query("URL_14_non_corporate", f"WITH p AS (SELECT page_id, {HOST} AS h FROM pages), x AS (SELECT page_id, {_HOSTS} AS domain FROM p) SELECT page_id, domain, regexp_matches(domain, '(?i){q('|'.join(U.NON_CORPORATE))}') AS other FROM x")
def _(spark, d):
    h = U.host(F.col("url"))
    domain = chosen(F.col("page_id"), [h, F.concat(h, F.lit(".gov")), *[F.lit(x) for x in ("en.wikipedia.org", "x.gov.in", "notg2.com", "www.g2.com", "mit.edu")]])
    return t(spark, d, "pages").select("page_id", domain.alias("domain"), U.is_non_corporate(domain).alias("other"))


@query("SRC_12_probes", f"""
WITH s AS (SELECT DISTINCT {HOST} AS site FROM pages), l AS (SELECT site, pos - 1 AS pos, 'https://' || site || ([{listed(U.UNIVERSAL_PATHS)}])[pos] AS url FROM s, generate_series(1, {len(U.UNIVERSAL_PATHS)}) g(pos)),
h AS (SELECT DISTINCT {HOST} AS site, 'https://' || {HOST} || '/about/' AS url FROM pages WHERE page_id % 2 = 0)
SELECT site, url, pos::INT AS pos FROM l ANTI JOIN h USING (site, url) QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos) <= 8""")
def _(spark, d):
    site = t(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("site"))
    have = site.where("page_id % 2 = 0").select("site", F.concat(F.lit("https://"), "site", F.lit("/about/")).alias("url")).distinct()
    return web.probes(site.select("site").distinct(), have, 8).select("site", "url", "pos")


_MD = "'# T' || chr(10) || '![a](b)' || chr(10) || url || chr(10) || '---' || chr(10) || 'Menu' || chr(10) || chr(10) || chr(10) || chr(10) || 'x [l](' || url || ') [m](https://q.example/a#b)'"


@query("SRC_9_markdown_links", f"WITH m AS (SELECT page_id, {_MD} AS md FROM pages) SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(md, '\\]\\((https?://[^)\\s]+)\\)', 1), lambda u: regexp_replace(u, '#.*$', '')))) AS link FROM m")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(leads.markdown_links(_markdown())).alias("link"))


def _markdown():
    return F.concat(F.lit("# T\n![a](b)\n"), F.col("url"), F.lit("\n---\nMenu\n\n\n\nx [l]("), F.col("url"), F.lit(") [m](https://q.example/a#b)"))


# --- Text -----------------------------------------------------------------------------------------------------------------
def nested(column: str, rules) -> str:
    out = column
    for pattern, new in rules:
        out = f"regexp_replace({out}, '{q(pattern)}', '{q(new).replace('$1', chr(92) + '1')}', 'g')"
    return out


@query("TXT_1_clean_markdown", f"WITH m AS (SELECT page_id, {_MD} AS md FROM pages) SELECT page_id, {STRIP(nested('md', X.MARKDOWN_NOISE))} AS cleaned FROM m")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", X.clean_markdown(_markdown()).alias("cleaned"))


@query("TXT_4_useful_pages", "SELECT doc_id, substr(text, 1, 5000) AS page FROM documents WHERE length(text) >= 150")
def _(spark, d):
    return t(spark, d, "documents").where(F.length("text") >= 150).select("doc_id", F.substring("text", 1, 5000).alias("page"))


@query("TXT_2_page_blob", f"WITH p AS (SELECT {HOST} AS site, page_id, '--- PAGE: ' || {PATH} || ' (' || url || ') ---' || chr(10) || substr(html, 1, 200) AS block FROM pages WHERE html <> '') SELECT site, string_agg(block, chr(10) || chr(10) ORDER BY page_id) AS blob FROM p GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "pages").where("html <> ''").select(U.host(F.col("url")).alias("site"), "page_id", F.concat(F.lit("--- PAGE: "), U.path(F.col("url")), F.lit(" ("), F.col("url"), F.lit(") ---\n"), F.substring("html", 1, 200)).alias("block"))
    return p.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "block"))), lambda x: x["block"]), "\n\n").alias("blob"))


@query("TXT_3_cut_blocks", "WITH p AS (SELECT page_id, repeat(substr(html, 1, 1500) || chr(10) || chr(10), 1 + (page_id % 4)::INT) AS x FROM pages), h AS (SELECT page_id, x, substr(x, 1, 4000) AS h FROM p), c AS (SELECT *, length(h) - strpos(reverse(h), chr(10) || chr(10)) - 1 AS place FROM h) SELECT page_id, CASE WHEN length(x) <= 4000 THEN x WHEN strpos(h, chr(10) || chr(10)) > 0 AND place > 2000 THEN substr(h, 1, place) ELSE h END AS cut FROM c")
def _(spark, d):
    block = F.concat(F.substring("html", 1, 1500), F.lit("\n\n"))
    return t(spark, d, "pages").select("page_id", X.cut_blocks(F.repeat(block, (F.col("page_id") % 4 + 1).cast("int")), 4000).alias("cut"))


_COMPANY = picked("p_partkey", ["p_name", "p_name || ' & Sons Ltd.'", "'Acme Corp. ' || p_brand", "p_name || ', Inc.'", "'Plc ' || p_name"])


def _company():
    name, brand = F.col("p_name"), F.col("p_brand")
    return chosen(F.col("p_partkey"), [name, F.concat(name, F.lit(" & Sons Ltd.")), F.concat(F.lit("Acme Corp. "), brand), F.concat(name, F.lit(", Inc.")), F.concat(F.lit("Plc "), name)])


@query("TXT_8_filing_name_keys", f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({_COMPANY}), '&', ' and '), '\\b(?:pvt\\.?|private|ltd\\.?|limited|inc\\.?|incorporated|llc|corp\\.?|corporation|co\\.?|plc)\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.sec_name_key(_company()).alias("key"))


@query("TXT_9_segment_keys", f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({_COMPANY}), '[^\\p{{L}}\\p{{N}}\\s&-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", G.segment_key(_company()).alias("key"))


_NAMES = ["p_name", "'as ' || p_name", "'Best of the'", "p_name || ' 48x48'", "'G2'", "'Launched'", "'our clients'", "'us'", "'Quality ' || p_brand", "'Ada Byron'", "'the world'", "split_part(p_name, ' ', 1) || ' guide'"]


def _names():
    name, brand = F.col("p_name"), F.col("p_brand")
    return chosen(F.col("p_partkey"), [name, F.concat(F.lit("as "), name), F.lit("Best of the"), F.concat(name, F.lit(" 48x48")), F.lit("G2"), F.lit("Launched"), F.lit("our clients"), F.lit("us"), F.concat(F.lit("Quality "), brand), F.lit("Ada Byron"), F.lit("the world"), F.concat(F.split_part(name, F.lit(" "), F.lit(1)), F.lit(" guide"))])


_KEY = "trim(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N}\\s-]', '', 'g'), '\\s+', ' ', 'g'))"
_FRAGMENT = f"(regexp_matches(name, '(?i)\\b\\d{{1,4}}x\\d{{1,4}}\\b') OR regexp_replace(lower(string_split(name, ' ')[1]), '[^\\p{{L}}\\p{{N}}]', '', 'g') IN ({listed(G.FRAGMENT_STARTERS)}))"
_ALL_IN = lambda stop: f"len(list_filter(string_split(key, ' '), lambda w: w <> '' AND w NOT IN ({listed(stop)}))) = 0"
_NAMED = f"WITH n AS (SELECT p_partkey, {picked('p_partkey', _NAMES)} AS name, {picked('p_partkey // 12', ['chr(32)', chr(39) + 'its customers include all' + chr(39), chr(39) + 'partnered with them' + chr(39), chr(39) + 'a member of it' + chr(39)])} AS said FROM part), k AS (SELECT *, {_KEY} AS key FROM n) "


@query("CLS_13_competitor_rejection", _NAMED + f"SELECT p_partkey, CASE WHEN key = 'ada byron' THEN 'self' WHEN regexp_matches(name, '{G.named_pattern(G.NON_COMPETITOR_NAMES)}') THEN 'directory' WHEN {_FRAGMENT} THEN 'fragment' WHEN length(key) < 3 THEN 'short' WHEN {_ALL_IN(G.COMPETITOR_STOPWORDS)} THEN 'stopwords' " + " ".join(f"WHEN regexp_matches(said, '(?i){p}') THEN '{r}'" for r, p in G.RELATIONSHIPS) + " END AS reason FROM k")
def _(spark, d):
    said = chosen(F.floor(F.col("p_partkey") / 12), [F.lit(" "), F.lit("its customers include all"), F.lit("partnered with them"), F.lit("a member of it")])
    n = t(spark, d, "part").select("p_partkey", _names().alias("name"), said.alias("said"))
    return n.select("p_partkey", G.competitor_rejection(F.col("name"), X.name_key(F.col("name")), entity.same_company(F.col("name"), F.lit("Ada Byron")), F.col("said")).alias("reason"))


@query("CLS_14_segment_rejection", _NAMED + f", s AS (SELECT p_partkey, name, trim(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}\\s&-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM k) SELECT p_partkey, CASE WHEN key = 'ada byron' THEN 'self' WHEN {_FRAGMENT} THEN 'fragment' WHEN length(key) < 3 THEN 'short' WHEN key IN ({listed(G.GENERIC_SEGMENT_TERMS)}) THEN 'generic' WHEN {_ALL_IN(G.GENERIC_SEGMENT_TERMS)} THEN 'generic phrase' END AS reason FROM s")
def _(spark, d):
    n = t(spark, d, "part").select("p_partkey", _names().alias("name"))
    return n.select("p_partkey", G.segment_rejection(F.col("name"), entity.same_company(F.col("name"), F.lit("Ada Byron"))).alias("reason"))


@query("CLS_15_company_rejection", _NAMED + f"SELECT p_partkey, CASE WHEN key = 'ada byron' THEN 'self' WHEN regexp_matches(name, '{G.named_pattern(G.NON_COMPANY_NAMES)}') THEN 'directory' WHEN length(key) < 3 THEN 'short' WHEN {_ALL_IN(G.COMPANY_STOPWORDS)} THEN 'stopwords' WHEN key IN ({listed(G.COMMON_NON_COMPANY_WORDS)}) THEN 'common word' END AS reason FROM k")
def _(spark, d):
    n = t(spark, d, "part").select("p_partkey", _names().alias("name"))
    return n.select("p_partkey", G.company_rejection(F.col("name"), X.name_key(F.col("name")), entity.same_company(F.col("name"), F.lit("Ada Byron"))).alias("reason"))


@query("CLS_19_person_names", _NAMED + f"SELECT p_partkey, len(regexp_split_to_array({STRIP('name')}, '\\s+')) BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array({STRIP('name')}, '\\s+'), lambda w: lower(w) IN ({listed(G.NON_NAME_WORDS)}))) = 0 AS person, {_FRAGMENT} AS fragment FROM k")
def _(spark, d):
    n = t(spark, d, "part").select("p_partkey", _names().alias("name"))
    return n.select("p_partkey", G.is_person_name(F.col("name")).alias("person"), G.is_fragment(F.col("name")).alias("fragment"))


_SCALE = picked("c_custkey", ["'revenue of $' || (c_custkey % 30) || '.5 billion'", "(c_custkey % 4) || ' million employees'", "'over ' || (c_custkey * 100) || '+ employees'", "'a Fortune 500 firm'", "c_name", "'USD ' || (c_custkey % 20) || ' bn and 60,000 employees'"])


@query("CLS_16_size_mismatch", f"""
WITH s AS (SELECT c_custkey, {_SCALE} AS x FROM customer)
SELECT c_custkey, CASE WHEN try_cast(regexp_extract(x, '{q(G.REVENUE)}', 1) AS DOUBLE) >= 10 THEN 'revenue' WHEN regexp_matches(x, '{q(G.MILLION_EMPLOYEES)}') THEN 'million employees' WHEN try_cast(replace(regexp_extract(x, '{q(G.EMPLOYEES)}', 1), ',', '') AS DOUBLE) >= 50000 THEN 'employees' WHEN regexp_matches(x, '{q(G.MEGA_PHRASE)}') THEN 'phrase' END AS reason FROM s""")
def _(spark, d):
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    x = chosen(k, [F.concat(F.lit("revenue of $"), n(30), F.lit(".5 billion")), F.concat(n(4), F.lit(" million employees")), F.concat(F.lit("over "), (k * 100).cast("string"), F.lit("+ employees")), F.lit("a Fortune 500 firm"), F.col("c_name"), F.concat(F.lit("USD "), n(20), F.lit(" bn and 60,000 employees"))])
    return t(spark, d, "customer").select("c_custkey", G.size_mismatch(x).alias("reason"))


_MESSAGES = ["'ok ' || event_id", "'HTTP 429 returned'", "'Rate limit hit by ' || user_id", "'quota exceeded'", "'code 4290'", "'{\"a\": ' || event_id || '}'"]


def _messages():
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    return chosen(F.col("event_id"), [F.concat(F.lit("ok "), e), F.lit("HTTP 429 returned"), F.concat(F.lit("Rate limit hit by "), u), F.lit("quota exceeded"), F.lit("code 4290"), F.concat(F.lit('{"a": '), e, F.lit("}"))])


@query("CLS_18_quota_signature", f"WITH e AS (SELECT event_id, [event_type, {picked('event_id', _MESSAGES)}, 'rate limit later'] AS h FROM events) SELECT event_id, list_filter(h, lambda x: regexp_matches(x, '(?i){q('|'.join(G.QUOTA_SIGNATURES))}'))[1] AS signature FROM e")
def _(spark, d):
    return t(spark, d, "events").select("event_id", G.quota_signature(F.array(F.col("event_type"), _messages(), F.lit("rate limit later"))).alias("signature"))


@query("CLS_22_response_tests", f"WITH e AS (SELECT event_id, {picked('event_id', _MESSAGES)} AS m FROM events) SELECT event_id, regexp_matches(m, '\\b429\\b') OR regexp_matches(m, '(?i)rate.?limit') AS limited, length(trim(m)) >= 10 AND contains(m, '{{') AND contains(m, '}}') AS json FROM e")
def _(spark, d):
    return t(spark, d, "events").select("event_id", S.is_rate_limit(_messages()).alias("limited"), S.is_json_like(_messages()).alias("json"))


_OFFERS = ["p_name || ' that runs plants'", "'to build ' || p_name", "p_name", "p_type || ', ' || p_name || '; for all of us'"]


@query("TXT_15_query_phrases", f"WITH o AS (SELECT p_partkey, {picked('p_partkey', _OFFERS)} AS x FROM part), a AS (SELECT *, length(regexp_extract(x, '(?i)^(.*?)\\b(?:that|which|for|to)\\b', 1)) AS n, regexp_matches(x, '{G.CLAUSE_BREAK}') AS hit FROM o), c AS (SELECT p_partkey, {STRIP('CASE WHEN hit AND n > 8 THEN substr(x, 1, n) ELSE x END')} AS x FROM a) SELECT p_partkey, regexp_replace(array_to_string(list_slice(regexp_split_to_array(x, '\\s+'), 1, 6), ' '), '[,;:]+$', '') AS phrase FROM c")
def _(spark, d):
    name = F.col("p_name")
    x = chosen(F.col("p_partkey"), [F.concat(name, F.lit(" that runs plants")), F.concat(F.lit("to build "), name), name, F.concat(F.col("p_type"), F.lit(", "), name, F.lit("; for all of us"))])
    return t(spark, d, "part").select("p_partkey", G.query_phrase(x).alias("phrase"))


_PROSE = ["'I hope this email finds you well. ' || p_name || ' -- and more.'", "'Furthermore, we leverage ' || p_name || ' , twice. in conclusion, we utilize it.'", "'it is worth noting that ' || p_name || '. ok? yes  .'", "'Moreover, ' || p_name"]


def _prose():
    name = F.col("p_name")
    return chosen(F.col("p_partkey"), [F.concat(F.lit("I hope this email finds you well. "), name, F.lit(" -- and more.")), F.concat(F.lit("Furthermore, we leverage "), name, F.lit(" , twice. in conclusion, we utilize it.")), F.concat(F.lit("it is worth noting that "), name, F.lit(". ok? yes  .")), F.concat(F.lit("Moreover, "), name)])


@query("TXT_21_humanised", f"WITH h AS (SELECT p_partkey, {STRIP(nested(picked('p_partkey', _PROSE), X.DASHES + X.FILLERS + X.TIDY))} AS x FROM part), s AS (SELECT p_partkey, string_split(regexp_replace(x, '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM h) SELECT p_partkey, array_to_string(list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(substr(p, 1, 1)) || substr(p, 2) ELSE p END), '') AS said FROM s")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.humanised(_prose()).alias("said"))


@query("TXT_19_context_windows", "WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)[0-9]{3,}', 1) AS head, regexp_extract(text, '([0-9]{3,})', 1) AS hit FROM documents WHERE regexp_matches(text, '[0-9]{3,}')) SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, length(head) + 1 - 45), length(head) + 1 + length(hit) + 55 - greatest(1, length(head) + 1 - 45)), '\\s+', ' ', 'g')) AS around FROM m")
def _(spark, d):
    around = X.context_window(F.col("text"), "[0-9]{3,}")
    return t(spark, d, "documents").select("doc_id", around.alias("around")).where("around IS NOT NULL")


@query("TXT_31_base64url", "SELECT p_partkey, regexp_replace(replace(replace(to_base64(encode(p_name || '?>' || p_brand)), '+', '-'), '/', '_'), '=+$', '') AS raw, 'To: ' || p_brand || chr(13) || chr(10) || 'Subject: ' || p_name || chr(13) || chr(10) || 'MIME-Version: 1.0' || chr(13) || chr(10) || 'Content-Type: text/plain; charset=\"UTF-8\"' || chr(13) || chr(10) || chr(13) || chr(10) || p_type AS mime FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.base64url(F.concat("p_name", F.lit("?>"), "p_brand")).alias("raw"), X.mime_message(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("mime"))


_TITLES = ["'CEO'", "' vp Sales '", "'Plant Head'", "p_name", "'cto'"]


@query("TXT_32_seniority", f"WITH x AS (SELECT p_partkey, lower(trim({picked('p_partkey', _TITLES)})) AS title FROM part) SELECT p_partkey, {cases('title', X.SENIORITY, chr(39) + 'Manager' + chr(39))} AS level FROM x")
def _(spark, d):
    title = chosen(F.col("p_partkey"), [F.lit("CEO"), F.lit(" vp Sales "), F.lit("Plant Head"), F.col("p_name"), F.lit("cto")])
    return t(spark, d, "part").select("p_partkey", X.seniority(title).alias("level"))


@query("TXT_28_mail_fields", "SELECT p_partkey, CASE WHEN lower(s) LIKE 're:%' THEN s ELSE 'Re: ' || s END AS subject, CASE WHEN len(w) > 1 THEN w[1] || '.' || w[-1] ELSE w[1] END AS local FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'RE: ' || p_brand ELSE p_brand END AS s, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM part)")
def _(spark, d):
    subject = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("RE: "), "p_brand")).otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", X.reply_subject(subject).alias("subject"), X.local_part(F.col("p_name")).alias("local"))


@query("TXT_27_stat_token_list", "WITH c AS (SELECT conv_id, turn, text || ' +5% in ' || turn || ' days, -2.5x' AS x FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(x, '([+-]?[0-9]+(?:[.][0-9]+)?(?:%|x| ?days?| ?hours?| ?cr))', 1), lambda v: regexp_replace(lower(v), '^[+-]', '')), '|') AS tokens FROM c")
def _(spark, d):
    x = F.concat("text", F.lit(" +5% in "), F.col("turn").cast("string"), F.lit(" days, -2.5x"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.stat_tokens(x), "|").alias("tokens"))


@query("TXT_18_statement_keys", "SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), 1, 60) AS key, nullif(regexp_extract('say \"' || substr(text, 1, 20) || '\" now', '\"([^\"]+)\"', 1), '') AS topic FROM conversations")
def _(spark, d):
    quoted = F.concat(F.lit('say "'), F.substring("text", 1, 20), F.lit('" now'))
    return t(spark, d, "conversations").select("conv_id", "turn", X.statement_key(F.col("text")).alias("key"), X.quoted_topic(quoted).alias("topic"))


@query("TXT_13_topic_gate", "WITH b AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 4) AS w, lower(p_type || ' ' || split_part(p_name, ' ', 2)) AS low FROM part), c AS (SELECT *, len(list_filter(w, lambda x: contains(low, x))) AS n FROM b) SELECT p_partkey, CASE WHEN n = 0 THEN false WHEN len(w) <= 3 THEN true ELSE n >= len(w) * 0.34 END AS mentions FROM c")
def _(spark, d):
    words = F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) >= 4)
    return t(spark, d, "part").select("p_partkey", X.mentions_topic(words, F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("mentions"))


# --- Extraction -----------------------------------------------------------------------------------------------------------
@query("EXT_12_versus_pairs", "WITH x AS (SELECT p_partkey, upper(p_name[1]) || 'ox Ltd ' || CASE p_partkey % 3 WHEN 0 THEN 'vs ' WHEN 1 THEN 'versus ' ELSE 'or ' END || p_brand AS s FROM part) SELECT p_partkey, regexp_extract(s, '([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*) (?:vs[.]?|versus) ([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*)', 1) AS a, regexp_extract(s, '([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*) (?:vs[.]?|versus) ([A-Z][A-Za-z0-9&-]*(?: [A-Z][A-Za-z0-9&-]*)*)', 2) AS b FROM x WHERE NOT contains(s, ' or ')")
def _(spark, d):
    s = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit("ox Ltd "), chosen(F.col("p_partkey"), [F.lit("vs "), F.lit("versus "), F.lit("or ")]), "p_brand")
    return t(spark, d, "part").select("p_partkey", X.versus_pair(s).alias("pair")).where("pair IS NOT NULL").select("p_partkey", F.element_at("pair", 1).alias("a"), F.element_at("pair", 2).alias("b"))


@query("EXT_14_numbered_items", "WITH x AS (SELECT p_partkey, '1. ' || p_name || chr(10) || 'text' || chr(10) || ' 2) ' || p_brand || chr(10) || '3 none' AS s FROM part) SELECT p_partkey, unnest(regexp_extract_all(s, '(?m)^\\s*[0-9]+[.)] +([^\\n]+)$', 1)) AS item FROM x")
def _(spark, d):
    s = F.concat(F.lit("1. "), "p_name", F.lit("\ntext\n 2) "), "p_brand", F.lit("\n3 none"))
    return t(spark, d, "part").select("p_partkey", F.explode(X.numbered_items(s)).alias("item"))


_MARKET = ["'the market is growing at ' || p_size || '% in all of its regions'", "'margin pressure from rising costs hits ' || p_name", "'buyers are shifting toward ' || p_name || ' this year'", "'an emerging trend in ' || p_name || ' is seen'", "p_name || ' market size outlook share and trends 2035'", "'MARKET SIZE AND GROWTH OF ALL THE REGIONS WE SELL'", "'short trend'", "p_name"]


def _market():
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    return chosen(F.col("p_partkey"), [F.concat(F.lit("the market is growing at "), size, F.lit("% in all of its regions")), F.concat(F.lit("margin pressure from rising costs hits "), name), F.concat(F.lit("buyers are shifting toward "), name, F.lit(" this year")), F.concat(F.lit("an emerging trend in "), name, F.lit(" is seen")), F.concat(name, F.lit(" market size outlook share and trends 2035")), F.lit("MARKET SIZE AND GROWTH OF ALL THE REGIONS WE SELL"), F.lit("short trend"), name])


@query("CLS_10_market_statements", f"""
WITH x AS (SELECT p_partkey, {picked("p_partkey", _MARKET)} AS s FROM part)
SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(s, '{q(p)}') THEN '{n}'" for n, p in content.MARKET_PATTERNS)} END AS category, regexp_matches(s, '{q(X.STRONG_INDICATOR)}') AS strong,
  CASE WHEN length(s) NOT BETWEEN 30 AND 280 THEN 'length' WHEN len(regexp_split_to_array(s, '\\s+')) < 5 THEN 'words' WHEN length(regexp_replace(s, '[^A-Za-z]', '', 'g')) > 8 AND NOT regexp_matches(s, '[a-z]') THEN 'capitals' WHEN regexp_matches(s, '{q(X.BARE_YEAR_END)}') AND NOT regexp_matches(s, '{q(X.PROSE_CONNECTOR)}') THEN 'title' END AS reason FROM x""")
def _(spark, d):
    s = _market()
    return t(spark, d, "part").select("p_partkey", content.market_statement(s).alias("category"), X.has_strong_indicator(s).alias("strong"), X.statement_rejection_full(s).alias("reason"))


# --- Sources --------------------------------------------------------------------------------------------------------------
_SOURCE_TITLES = ["'Annual Report ' || page_id", "'Q3 results'", "'Transcript of the earnings call'", "'Acme appoints new CEO'", "'Our insights'", "'Press release'", "'An interview'", "'ESG'", "'Home'", "'Jobs'"]
_SOURCE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(ti, '{q(p[0])}') AND regexp_matches(u || ti, '{q(p[1])}') THEN '{n}'" if w == "tb" else f"WHEN regexp_matches({'u || ti' if w == 'b' else 'u'}, '{q(p)}') THEN '{n}'" for n, w, p in S.SOURCE_TYPES) + " ELSE 'other' END"


@query("CLS_6_source_types", f"""
WITH x AS (SELECT page_id, lower(CASE WHEN page_id % 7 = 0 THEN 'https://www.linkedin.com/' || page_id ELSE url END) AS u, lower({picked("page_id", _SOURCE_TITLES)}) AS ti FROM pages), k AS (SELECT page_id, u, {_SOURCE_SQL} AS kind FROM x)
SELECT page_id, kind, {cases("kind", [(n, s) for n, s, _ in S.SOURCE_VALUES], "'low'")} AS strength, {cases("kind", [(n, p) for n, _, p in S.SOURCE_VALUES], "10")} AS priority, NOT contains(u, 'linkedin.com') AND NOT contains(u, 'glassdoor.com') AS fetchable FROM k""")
def _(spark, d):
    title = chosen(F.col("page_id"), [F.concat(F.lit("Annual Report "), F.col("page_id").cast("string")), *[F.lit(x) for x in ("Q3 results", "Transcript of the earnings call", "Acme appoints new CEO", "Our insights", "Press release", "An interview", "ESG", "Home", "Jobs")]])
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://www.linkedin.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    k = t(spark, d, "pages").select("page_id", url.alias("u"), S.source_type(url, title).alias("kind"))
    return k.select("page_id", "kind", S.source_strength(F.col("kind")).alias("strength"), S.source_priority(F.col("kind")).alias("priority"), S.is_fetchable(F.col("u")).alias("fetchable"))


_PAGES = ["'/investors'", "'/careers/list'", "'/about'", "'/products/x'", "'/'", "NULL", "'/annual-report-2020'", "'/docs/a'", "'/press'", "'/iron'", "'/blog/x'"]


@query("CLS_3_page_tiers", f"""
WITH x AS (SELECT page_id, {picked("page_id", _PAGES)} AS p FROM pages), y AS (SELECT *, lower(coalesce(p, '')) AS l FROM x)
SELECT page_id, CASE WHEN regexp_matches(l, '{q(S.TIER1_PAGES)}') THEN 'tier1' WHEN regexp_matches(l, '{q(S.TIER2_PAGES)}') THEN 'tier2' ELSE 'tier3' END AS tier FROM y""")
def _(spark, d):
    p = chosen(F.col("page_id"), [F.lit(None).cast("string") if x == "NULL" else F.lit(x.strip("'")) for x in _PAGES])
    return t(spark, d, "pages").select("page_id", S.page_tier(p).alias("tier"))


@query("CLS_1_page_types", f"""
WITH x AS (SELECT page_id, lower({picked("page_id", _PAGES)}) AS p FROM pages), k AS (SELECT page_id, CASE WHEN coalesce(p, '') = '' THEN 'homepage' {" ".join(f"WHEN regexp_matches(p, '{q(x)}') THEN '{n}'" for n, x in U.PAGE_TYPES)} ELSE 'other' END AS kind FROM x)
SELECT page_id, kind, CASE WHEN kind IN ('careers', 'investor', 'annual_report', 'press') THEN 1 WHEN kind IN ('about', 'blog') THEN 2 ELSE 3 END AS tier FROM k""")
def _(spark, d):
    p = chosen(F.col("page_id"), [F.lit(None).cast("string") if x == "NULL" else F.lit(x.strip("'")) for x in _PAGES])
    k = t(spark, d, "pages").select("page_id", U.page_type(p).alias("kind"))
    return k.select("page_id", "kind", U.tier(F.col("kind")).alias("tier"))


_MODELS = ["p_name", "'Tier 1 auto component maker'", "'a diversified holding'", "'cloud platform'", "'engineering service'", "'freight and logistics'", "'robotics company'", "'forging and casting'", "'automotive'", "'OEM manufacturer'"]


@query("CLS_8_business_models", f"WITH x AS (SELECT p_partkey, trim(lower({picked('p_partkey', _MODELS)})) AS m FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(m, '{q(p)}') THEN '{n}'" for n, p in S.BUSINESS_MODELS) + " ELSE 'Other' END AS model FROM x")
def _(spark, d):
    m = chosen(F.col("p_partkey"), [F.col("p_name") if x == "p_name" else F.lit(x.strip("'")) for x in _MODELS])
    return t(spark, d, "part").select("p_partkey", S.business_model(m).alias("model"))


_TAGGED = ["p_name", "'a dealer network of vehicles and one vehicle'", "'forex brokerage, e-commerce'", "'distributed network and NBFC'", "'media house'"]


@query("CLS_20_industry_tags", f"""
WITH x AS (SELECT p_partkey, {picked("p_partkey", _TAGGED)} AS m, {picked("p_partkey // 5", ["'manufacturer'", "'retailer'", "'none'", "'logistics_operator'"])} AS kind FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN regexp_matches(m, '(?i){q(p)}') THEN '{g}' END" for g, p in S.INDUSTRY_TAGS)}, {", ".join(f"CASE WHEN kind = '{k}' THEN '{g}' END" for k, tags in S.TYPE_TAGS for g in tags)}], lambda v: v IS NOT NULL))), ',') AS tags FROM x""")
def _(spark, d):
    m = chosen(F.col("p_partkey"), [F.col("p_name") if x == "p_name" else F.lit(x.strip("'")) for x in _TAGGED])
    kind = chosen(F.floor(F.col("p_partkey") / 5), [F.lit(x) for x in ("manufacturer", "retailer", "none", "logistics_operator")])
    return t(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(S.industry_tags(m, F.array(kind))), ",").alias("tags"))


@query("AGG_28_category_coverage", f"WITH x AS (SELECT {HOST} AS site, lower(url) AS u, lower({picked('page_id', _SOURCE_TITLES)}) AS ti FROM pages), k AS (SELECT site, {_SOURCE_SQL} AS kind FROM x) SELECT site, kind, count(*) AS n FROM k GROUP BY ALL")
def _(spark, d):
    title = chosen(F.col("page_id"), [F.concat(F.lit("Annual Report "), F.col("page_id").cast("string")), *[F.lit(x) for x in ("Q3 results", "Transcript of the earnings call", "Acme appoints new CEO", "Our insights", "Press release", "An interview", "ESG", "Home", "Jobs")]])
    return t(spark, d, "pages").select(U.host(F.col("url")).alias("site"), S.source_type(F.col("url"), title).alias("kind")).groupBy("site", "kind").agg(F.count("*").alias("n"))


# --- Scores ---------------------------------------------------------------------------------------------------------------
_CLUSTERS = [n for n, _ in scoring.CLUSTER_FLOORS] + ["unknown"]


@query("AGG_14_cluster_floor", f"""
WITH c AS (SELECT o_custkey, {picked("o_orderkey", ["'" + x + "'" for x in _CLUSTERS])} AS id, CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'low' END AS conf FROM orders)
SELECT o_custkey, least(floor(sum(({cases("id", scoring.CLUSTER_FLOORS, "0")}) * CASE conf WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END) + 0.5), 88)::BIGINT AS floor FROM c GROUP BY 1""")
def _(spark, d):
    conf = F.when(F.col("o_orderstatus") == "O", "high").when(F.col("o_orderstatus") == "F", "medium").otherwise("low")
    return scoring.cluster_floor(t(spark, d, "orders").select("o_custkey", chosen(F.col("o_orderkey"), [F.lit(x) for x in _CLUSTERS]).alias("id"), conf.alias("confidence")), "o_custkey")


_SIGNALS = [n for n, _ in scoring.SIGNAL_URGENCY] + ["unknown"]


@query("AGG_15_why_now", f"WITH s AS (SELECT o_custkey, {picked('o_orderkey', ['' + chr(39) + x + chr(39) for x in _SIGNALS])} AS type FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, least(10, floor(sum({cases('type', scoring.SIGNAL_URGENCY, '0')}) / 8.0::DOUBLE + 0.5))::BIGINT AS score FROM s GROUP BY 1")
def _(spark, d):
    return scoring.why_now_scores(t(spark, d, "orders").select("o_custkey", chosen(F.col("o_orderkey"), [F.lit(x) for x in _SIGNALS]).alias("type"), (F.col("o_orderstatus") != "P").alias("is_company_subject")), "o_custkey")


_TRIGGERS = [n for n, _ in scoring.TRIGGER_URGENCY] + ["unknown"]


@query("AGG_19_urgency", f"""
WITH e AS (SELECT user_id, {picked("event_id", ["'" + x + "'" for x in _TRIGGERS])} AS type, event_type = 'purchase' AS first FROM events), w AS (SELECT *, {cases("type", scoring.TRIGGER_URGENCY, "0")} AS w FROM e),
c AS (SELECT user_id, type, max(w) + CASE WHEN bool_or(first) THEN 10 ELSE 0 END AS c FROM w WHERE w > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC) AS k FROM c),
s AS (SELECT user_id, count(*) AS n_triggers, least(100, sum(c) FILTER (k <= 4))::BIGINT AS urgency_score FROM r GROUP BY 1)
SELECT *, CASE WHEN urgency_score >= 60 THEN 'immediate' WHEN urgency_score >= 35 THEN 'near_term' ELSE 'emerging' END AS urgency FROM s""")
def _(spark, d):
    return scoring.urgency(t(spark, d, "events").select("user_id", chosen(F.col("event_id"), [F.lit(x) for x in _TRIGGERS]).alias("type"), F.when(F.col("event_type") == "purchase", "tier1").otherwise("tier3").alias("tier")), "user_id")


@query("AGG_11_scrape_quality", f"""
WITH s AS (SELECT {HOST} AS site, count(*) AS n, sum(length(html)) AS c, min(page_id) % 3 AS m FROM pages GROUP BY 1),
b AS (SELECT *, least(100, CASE WHEN n = 1 THEN 30 WHEN n <= 3 THEN 55 WHEN n <= 6 THEN 70 WHEN n <= 10 THEN 80 ELSE 90 END + CASE WHEN c >= 15000 THEN 10 WHEN c >= 8000 THEN 5 ELSE 0 END) AS b FROM s)
SELECT site, least(100, b + CASE WHEN m < 2 THEN 5 ELSE 0 END)::INT AS score FROM b""")
def _(spark, d):
    s = t(spark, d, "pages").groupBy(U.host(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("c"), (F.min("page_id") % 3).alias("m"))
    return s.select("site", scoring.scrape_quality(F.col("n"), F.col("c"), F.when(F.col("m") == 0, "map_url").when(F.col("m") == 1, "sitemap").otherwise("links")).cast("int").alias("score"))


_QUALITY = "floor(least(100.0, greatest(0.0, {})) + 0.5)"


@query("AGG_20_intelligence_quality", f"""
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS e, count(*) FILTER (event_type = 'click') AS f, count(*) FILTER (event_type = 'purchase') AS t1, count(*) FILTER (event_type = 'signup') AS t2, count(*) FILTER (event_type = 'error') AS t3, min(event_id) AS v FROM events GROUP BY 1),
d AS (SELECT user_id, {_QUALITY.format("least(40, n * 4) + least(30, e * 6) + least(30, f * 10)")} AS a, {_QUALITY.format("t1 * 25 + t2 * 10 + t3 * 3")} AS b, {_QUALITY.format("least(50, t2 * 15) + least(50, t3 * 25)")} AS c, {_QUALITY.format("(v % 97)::DOUBLE")} AS s, {_QUALITY.format("t1 * 40 + t2 * 20")} AS o FROM g),
x AS (SELECT *, floor(a * 0.20::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE + s * 0.15::DOUBLE + o * 0.15::DOUBLE + 0.5) AS overall FROM d)
SELECT user_id, a::BIGINT AS data_coverage, b::BIGINT AS evidence_strength, c::BIGINT AS validation_strength, s::BIGINT AS signal_confidence, o::BIGINT AS opportunity_confidence, overall::BIGINT AS overall, CASE WHEN overall >= 80 THEN 'Excellent' WHEN overall >= 65 THEN 'Good' WHEN overall >= 45 THEN 'Fair' ELSE 'Limited' END AS label FROM x""")
def _(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    g = t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), n("view").alias("e"), n("click").alias("f"), n("purchase").alias("t1"), n("signup").alias("t2"), n("error").alias("t3"), F.min("event_id").alias("v"))
    c = F.col
    dims = scoring.intelligence_quality(c("n"), c("e"), c("f"), (c("t1"), c("t2"), c("t3")), c("t2"), c("t3"), (c("v") % 97).cast("double"), c("t1"), c("t2"))
    out = g.select("user_id", *[x.cast("long").alias(name) for name, x in dims.items()])
    return out.withColumn("label", scoring.quality_label(F.col("overall")))


@query("AGG_22_sufficiency", "SELECT o_custkey, NOT (count(*) FILTER (o_orderpriority = '1-URGENT') = 0 AND count(*) FILTER (o_orderstatus = 'P') = 0 AND count(*) FILTER (o_totalprice > 400000) = 0 AND NOT coalesce(max(CASE WHEN o_orderkey % 7 = 0 THEN 3 END) > 0, false)) AS sufficient FROM orders GROUP BY 1")
def _(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("b"), F.count_if(F.col("o_totalprice") > 400000).alias("c"), F.max(F.when(F.col("o_orderkey") % 7 == 0, 3)).alias("p"))
    return g.select("o_custkey", scoring.is_sufficient(F.col("a"), F.col("b"), F.col("c"), F.col("p"), F.lit(None).cast("int")).alias("sufficient"))


@query("AGG_24_evaluation", """
WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderpriority = '5-LOW') AS l, min(o_orderkey) AS k FROM orders GROUP BY 1),
s AS (SELECT *, k % 2 = 0 AS ok, (['PASS', 'WARN', 'PARTIAL', 'FAIL'])[1 + k % 4] AS v FROM g)
SELECT o_custkey, CASE WHEN k % 9 = 0 THEN 0.0 ELSE floor(((CASE v WHEN 'PASS' THEN 20 WHEN 'WARN' THEN 14 WHEN 'PARTIAL' THEN 8 ELSE 0 END) + (CASE WHEN f = 0 THEN CASE WHEN ok THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END ELSE least(u, f) / f::DOUBLE * 20 END)
 + (CASE WHEN ok THEN 7.5::DOUBLE ELSE 0.0::DOUBLE END) + least(1.0::DOUBLE, n / 5::DOUBLE) * 7.5::DOUBLE + (CASE WHEN o = 0 THEN CASE WHEN ok THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END ELSE least(l, o) / o::DOUBLE * 10 END)
 + CASE WHEN u > 0 THEN 5 ELSE 0 END + CASE WHEN l > 0 THEN 5 ELSE 0 END + (1 - least(l, n) / n::DOUBLE) * 15 + CASE WHEN k % 5 = 0 THEN 0 ELSE 10 END) * 100 + 0.5) / 100 END AS score FROM s""")
def _(spark, d):
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), is_("o_orderstatus", "F").alias("f"), is_("o_orderstatus", "O").alias("o"), is_("o_orderpriority", "1-URGENT").alias("u"), is_("o_orderpriority", "5-LOW").alias("l"), F.min("o_orderkey").alias("k"))
    c = F.col
    given = {"success": c("k") % 9 != 0, "validation": chosen(c("k"), [F.lit(x) for x in ("PASS", "WARN", "PARTIAL", "FAIL")]), "sufficient": c("k") % 2 == 0, "opportunities": c("f"), "with_evidence": F.least("u", "f"), "signals": c("n"), "min_signals": F.lit(5), "pain_points": c("o"), "backed": F.least("l", "o"), "competitors_ok": c("u") > 0, "segments_ok": c("l") > 0, "audited": c("n"), "flagged": F.least("l", "n"), "contaminated": c("k") % 5 == 0}
    return g.select("o_custkey", scoring.evaluation_score(given).alias("score"))


@query("AGG_25_run_summary", "WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, avg(floor(o_totalprice)) AS s FROM orders GROUP BY ALL), l AS (SELECT *, s - lag(s) OVER (PARTITION BY p ORDER BY y) AS delta FROM m) SELECT p, y::INT AS y, round(s, 4) AS mean, coalesce(delta < -5, false) AS regressed FROM l")
def _(spark, d):
    m = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.avg(F.floor("o_totalprice").cast("double")).alias("s"))
    delta = F.col("s") - F.lag("s").over(Window.partitionBy("p").orderBy("y"))
    return m.select("p", "y", F.round("s", 4).alias("mean"), F.coalesce(delta < -5, F.lit(False)).alias("regressed"))


# --- Grounding ------------------------------------------------------------------------------------------------------------
_WORDS = "list_filter(string_split(regexp_replace(q, '[^a-z0-9\\s]', '', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ('the', 'and', 'for', 'of'))"


@query("GRD_1_quote_tiers", f"""
WITH b AS (SELECT item_id, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS q FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE text || ' and words that nobody wrote' END AS x FROM benchmark) WHERE length(trim(x)) >= 30),
w AS (SELECT item_id, q, {_WORDS} AS w, list_transform(generate_series(1, greatest(len(string_split(q, ' ')) - 3, 1)), lambda i: array_to_string(list_slice(string_split(q, ' '), i, i + 3), ' ')) AS runs FROM b),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS c FROM documents),
j AS (SELECT item_id, doc_id, CASE WHEN contains(c, q) THEN 'exact' WHEN len(w) >= 8 AND len(list_filter(runs, lambda g: contains(c, g))) > 0 AND len(list_filter(w, lambda x: contains(c, x))) >= 0.75 * len(w) THEN 'close' END AS tier FROM w, d WHERE len(list_filter(runs, lambda g: contains(c, g))) > 0)
SELECT item_id, doc_id, tier FROM j WHERE tier IS NOT NULL""")
def _(spark, d):
    quote = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" and words that nobody wrote")))
    return content.quote_tiers(t(spark, d, "benchmark").select("item_id", quote.alias("quote")), t(spark, d, "documents").select("doc_id", "text"))


@query("GRD_2_tier_gate", "SELECT event_id, tier = 'exact' AS exact, tier IN ('exact', 'close') AS close FROM (SELECT event_id, (['exact', 'close', 'none'])[1 + event_id % 3] AS tier FROM events)")
def _(spark, d):
    tier = chosen(F.col("event_id"), [F.lit(x) for x in ("exact", "close", "none")])
    return t(spark, d, "events").select("event_id", content.is_grounded(tier, "exact").alias("exact"), content.is_grounded(tier).alias("close"))


# --- Joins, sinks, state --------------------------------------------------------------------------------------------------
@query("JOIN_4_unseen_both_ways", """
WITH r AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS domain FROM part), h AS (SELECT p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS domain FROM part WHERE p_partkey % 5 = 0 AND p_brand < 'Brand#3')
SELECT p_partkey FROM r WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM h WHERE domain IS NOT NULL) UNION ALL SELECT p_partkey FROM r WHERE domain IS NULL AND lower(name) NOT IN (SELECT lower(name) FROM h)""")
def _(spark, d):
    p = t(spark, d, "part")
    rows = p.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("domain"))
    history = p.where("p_partkey % 5 = 0 AND p_brand < 'Brand#3'").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("domain"))
    return entity.unseen(rows, history).select("p_partkey")


@query("SNK_1_upsert_changes", "WITH b AS (SELECT o_orderkey, o_totalprice AS v, o_orderdate AS changed FROM orders WHERE o_orderkey % 3 > 0), c AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS v, max(l_shipdate) AS changed FROM lineitem GROUP BY 1) SELECT o_orderkey, v, changed FROM (SELECT *, 0 AS k FROM b UNION ALL SELECT *, 1 FROM c) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY changed DESC, k DESC) = 1")
def _(spark, d):
    base = t(spark, d, "orders").where("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("changed"))
    changes = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("v"), F.max("l_shipdate").alias("changed"))
    return events.upsert(base, changes, "o_orderkey", "changed")


@query("SNK_2_update_delete", "SELECT c_custkey, CASE WHEN o.v IS NOT NULL THEN o.v ELSE c_acctbal END AS c_acctbal, c_name FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) o ON c_custkey = o_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name", "c_nationkey")
    changes = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    gone = t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return events.deleted(events.updated(c, changes, "c_custkey"), gone, "c_nationkey").drop("c_nationkey")


@query("TIME_10_snapshots", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id")
    return events.snapshots(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("event_id", "pos")


@query("TIME_3_followup_outcome", f"""
WITH s AS (SELECT *, {picked("event_id", ["'sent'", "'followup_1'", "'followup_2'", "'followup_3'", "'queued'"])} AS status FROM events), e AS (SELECT *, CASE status WHEN 'sent' THEN 3 WHEN 'followup_1' THEN 4 WHEN 'followup_2' THEN 7 END AS days FROM s)
SELECT event_id, CASE WHEN days IS NULL THEN 'skipped' WHEN NOT event_type = 'signup' AND NOT coalesce(ts + to_days(days) <= TIMESTAMP '{NOW}', false) THEN 'not_due' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'cancelled_bounce' WHEN event_type = 'click' THEN 'cancelled_reply' WHEN user_id % 7 = 0 THEN 'no_email' WHEN user_id % 11 = 0 THEN 'no_draft' WHEN user_id % 13 = 0 THEN 'suppressed' ELSE 'sent' END AS outcome FROM e""")
def _(spark, d):
    status = chosen(F.col("event_id"), [F.lit(x) for x in ("sent", "followup_1", "followup_2", "followup_3", "queued")])
    e = t(spark, d, "events").withColumn("status", status).withColumn("ts", F.col("ts").cast("timestamp"))
    kind, user = F.col("event_type"), F.col("user_id")
    email, draft = F.when(user % 7 != 0, "a@b"), F.when(user % 11 != 0, "text")
    return e.select("event_id", events.followup_outcome(F.col("status"), F.col("ts"), F.lit(NOW).cast("timestamp"), kind == "click", F.col("event_id") % 3 == 0, email, draft, user % 13 == 0, kind == "signup").alias("outcome"))


@query("TIME_5_cooldown", """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch(ts) AS t, event_type = 'error' AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, event_id, i, true AS tried, CASE WHEN l THEN t + 172800 ELSE -1e18 END AS until FROM e WHERE i = 1 UNION ALL
 SELECT e.key, e.event_id, e.i, e.t >= r.until, CASE WHEN e.t >= r.until AND e.l THEN e.t + 172800 ELSE r.until END FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, event_id, tried FROM r""")
def _(spark, d):
    return events.cooled_down(t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("limited")), 172_800)


# --- Orders and sets ------------------------------------------------------------------------------------------------------
_CONFIDENCE = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END"


@query("SORT_1_tier_then_confidence", f"SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, {_CONFIDENCE}, o_orderkey) AS rank FROM orders")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", rank, "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"))


@query("SORT_8_threshold_then_count", "SELECT o_custkey, o_orderpriority, n, row_number() OVER (PARTITION BY o_custkey ORDER BY strong DESC, n DESC, o_orderpriority) AS rank FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) >= 3 AS strong FROM orders GROUP BY 1, 2)")
def _(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("n") >= 3), F.desc("n"), "o_orderpriority")
    return g.withColumn("rank", F.row_number().over(w))


def _best_two(c, p):
    score = (F.col("c_nationkey") % 3 == F.col("p_size") % 3).cast("int") + (F.substring("c_mktsegment", 1, 1) == F.upper(F.substring("p_name", 1, 1))).cast("int")
    # customers of one nation and segment have the same parts, so the best are found once for each such class
    own = ["c_nationkey", "c_mktsegment"]
    both = c.select(*own).distinct().join(p, c.c_nationkey == p.p_size).select(*own, "p_partkey", score.alias("score"), (F.col("p_partkey") % 2).alias("provenance")).where("score > 0")
    w = Window.partitionBy(*own).orderBy(F.desc("score"), "provenance", "p_partkey")
    best = both.select(*own, "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 2")
    return c.select("c_custkey", *own).join(best, own).select("c_custkey", "p_partkey", "rank")


@query("SORT_9_best_two", "WITH p AS (SELECT c_custkey, p_partkey, (c_nationkey % 3 = p_size % 3)::INT + (c_mktsegment[1] = upper(p_name[1]))::INT AS score, p_partkey % 2 AS provenance FROM customer JOIN part ON c_nationkey = p_size WHERE p_partkey % 10 = 0) SELECT c_custkey, p_partkey, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, provenance, p_partkey) AS rank FROM p WHERE score > 0 QUALIFY rank <= 2")
def _(spark, d):
    return _best_two(t(spark, d, "customer"), t(spark, d, "part").where("p_partkey % 10 = 0"))


# every part, of which SORT_9_best_two takes one in ten, all of one provenance
@query("SORT_9_best_two_of_all", "WITH p AS (SELECT c_custkey, p_partkey, (c_nationkey % 3 = p_size % 3)::INT + (c_mktsegment[1] = upper(p_name[1]))::INT AS score, p_partkey % 2 AS provenance FROM customer JOIN part ON c_nationkey = p_size) SELECT c_custkey, p_partkey, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, provenance, p_partkey) AS rank FROM p WHERE score > 0 QUALIFY rank <= 2")
def _(spark, d):
    return _best_two(t(spark, d, "customer"), t(spark, d, "part"))


@query("SET_3_append_missing", "SELECT c_nationkey AS k, c_mktsegment AS segment, true AS found FROM customer WHERE c_acctbal > 8000 GROUP BY 1, 2 UNION ALL SELECT c_nationkey, c_mktsegment, false FROM customer GROUP BY 1, 2 HAVING max(c_acctbal) <= 8000")
def _(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    base = c.where("c_acctbal > 8000").select("k", "segment").distinct()
    missing = c.select("k", "segment").distinct().join(base, ["k", "segment"], "left_anti")
    return base.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("SET_5_suppressed", "WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O')) AS b FROM orders GROUP BY 1) SELECT o_custkey, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)))::INT AS n FROM s")
def _(spark, d):
    s = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b"))
    return s.select("o_custkey", F.size(F.array_except("a", "b")).alias("n"))


@query("SET_6_trust_order", "SELECT o_custkey, src, id, row_number() OVER (PARTITION BY o_custkey ORDER BY src, id) AS pos FROM (SELECT o_custkey, 0 AS src, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    o = t(spark, d, "orders")
    parts = [o.where(F.col("o_orderstatus") == s).select("o_custkey", F.lit(i).alias("src"), F.col("o_orderkey").alias("id")) for i, s in enumerate("FOP")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("src", "id")))


@query("UI_1_name_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00') AND contains(lower(c_mktsegment), 'mach')")
def _(spark, d):
    return t(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("00")) & F.contains(F.lower("c_mktsegment"), F.lit("mach"))).select("c_custkey")
