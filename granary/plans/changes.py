"""Registered queries on histories, sitemaps, state machines and late arrivals, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import frontier, history, states
from granary.plans.more import chosen, picked
from granary.plans.registry import query, t

# --- History of a changed table --------------------------------------------------------------------------------------------
_OPS = ["insert", "update", "update", "delete", "update", "insert", "update", "odd"]


def _changes(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), i.alias("seq"), chosen(i, [F.lit(x) for x in _OPS]).alias("op"), F.when(i % 3 > 0, F.col("value")).alias("value"), F.when(i % 4 > 0, F.col("event_type")).alias("note"))


_BEFORE = "OVER (PARTITION BY key ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("SNK_2_history", f"""WITH c AS (SELECT user_id AS key, ts AS t, event_id AS seq, {picked("event_id", ["'" + x + "'" for x in _OPS])} AS op, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 4 > 0 THEN event_type END AS note FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) {_BEFORE} = 'insert', false) AS there FROM c WHERE op <> 'odd' AND key IS NOT NULL AND t IS NOT NULL),
e AS (SELECT *, sum((op = 'insert')::INT) OVER (PARTITION BY key ORDER BY t, seq) AS life, lead(t) OVER (PARTITION BY key ORDER BY t, seq) AS valid_to FROM s WHERE there = (op <> 'insert')),
v AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS new_value, last_value(note IGNORE NULLS) OVER w AS new_note FROM e WINDOW w AS (PARTITION BY key, life ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, new_value AS value, new_note AS note, t AS valid_from, valid_to, valid_to IS NULL AS is_current FROM v WHERE op <> 'delete'""")
def _(spark, d):
    return history.versions(_changes(spark, d), ["value", "note"])


# --- Sitemaps --------------------------------------------------------------------------------------------------------------
_MAPS = ["sitemap-corporate.xml", "sitemap-arena.xml", "About.xml", "sitemap.xml", "press.xml", "esg-1.xml", "careers.xml", "newsroom-2.xml"]
_FILLER = "<!-- " + "-" * 90 + " -->"
_ROUNDS = 3
_SITE = "'https://s' || page_id // 5 || '.example/'"
_NAME = lambda key: picked(f"({key})", ["'" + m + "'" for m in _MAPS])
_LOC = lambda url: f"'<loc>' || {url} || '</loc>'"
_READ = "SELECT f.site, f.place, contains(xml, '<sitemapindex') OR contains(xml, '<sitemap>') AS is_index, list_filter(list_transform(regexp_extract_all(xml, '(?i)<loc[^>]*>([^<]+)</loc>', 1), lambda u: trim(u)), lambda u: starts_with(u, 'http')) AS urls FROM {front} f JOIN known USING (url)"
_SQL = f"""WITH fetched AS (SELECT {_SITE} || 'sitemap.xml' AS url, '<sitemapindex>{_FILLER}' || string_agg(CASE WHEN (page_id // 5) % 3 = 0 THEN {_LOC("coalesce(url, '')")} ELSE {_LOC(_SITE + " || " + _NAME("page_id * 3 + page_id // 5"))} || {_LOC(_SITE + " || " + _NAME("page_id"))} || {_LOC("url")} END, ' ' ORDER BY page_id) AS xml FROM pages WHERE (page_id // 5) % 7 <> 5 AND (page_id // 5) % 3 > 0 GROUP BY page_id // 5
 UNION ALL SELECT {_SITE} || 'sitemap.xml', '<urlset>{_FILLER}' || string_agg({_LOC("url")}, ' ' ORDER BY page_id) FROM pages WHERE (page_id // 5) % 3 = 0 GROUP BY page_id // 5
 UNION ALL SELECT {_SITE} || {_NAME("page_id")}, CASE WHEN page_id % 2 = 0 THEN '<urlset' ELSE '<sitemapindex' END || '>' || CASE WHEN page_id % 11 > 0 THEN '{_FILLER}' ELSE '' END || {_LOC("' ' || url")} || {_LOC(_SITE + " || " + _NAME("page_id + 2"))} || {_LOC(_SITE + " || 'sitemap.xml'")} || {_LOC("'/relative'")} FROM pages WHERE page_id % 8 <> 3),
known AS (SELECT url, min(xml) AS xml FROM fetched WHERE length(xml) > {frontier.SHORT} GROUP BY url),
f0 AS (SELECT DISTINCT page_id // 5 AS site, {_SITE} || 'sitemap.xml' AS url, 0 AS place FROM pages)""" + "".join(f""",
r{n} AS ({_READ.format(front=f"f{n}")}),
g{n} AS (SELECT site, place, unnest(range(1, len(maps) + 1)) AS nth, unnest(maps) AS url FROM (SELECT site, place, list_filter(urls, lambda u: ends_with(u, '.xml') AND regexp_matches(lower(u), '{frontier.CORPORATE}'))[1:{frontier.MOST}] AS maps FROM r{n} WHERE is_index)),
k{n} AS (SELECT site, url, min(rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place, nth, url) AS rank FROM g{n}) WHERE rank <= {frontier.MOST} GROUP BY ALL),
f{n + 1} AS (SELECT site, url, place FROM k{n} ANTI JOIN ({" UNION ALL ".join(f"SELECT site, url FROM f{m}" for m in range(n + 1))}) USING (site, url))""" for n in range(_ROUNDS)) + f""",
r{_ROUNDS} AS ({_READ.format(front=f"f{_ROUNDS}")}),
p AS ({" UNION ALL ".join(f"SELECT site, unnest(list_filter(urls, lambda u: NOT ends_with(u, '.xml'))) AS url, {n} AS round FROM r{n}" + (" WHERE NOT is_index" if not n else "") for n in range(_ROUNDS + 1))})
SELECT site, url, min(round) AS round FROM p GROUP BY ALL"""


@query("SRC_8_sitemap_pages", _SQL)
def _(spark, d):
    pages, i = t(spark, d, "pages"), F.col("page_id")
    k = F.floor(i / 5).cast("long")
    site = F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/"))
    name = lambda key: chosen(key, [F.lit(m) for m in _MAPS])
    loc = lambda *url: F.concat(F.lit("<loc>"), *url, F.lit("</loc>"))
    listed = lambda entry: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("x")))), lambda x: x["x"]), " ")
    root = F.concat(F.first(site), F.lit("sitemap.xml")).alias("url")
    index = pages.where((k % 7 != 5) & (k % 3 > 0)).groupBy(k.alias("site")).agg(root, F.concat(F.lit("<sitemapindex>" + _FILLER), listed(F.concat(loc(site, name(i * 3 + k)), loc(site, name(i)), loc(F.col("url"))))).alias("xml"))
    plain = pages.where(k % 3 == 0).groupBy(k.alias("site")).agg(root, F.concat(F.lit("<urlset>" + _FILLER), listed(loc(F.col("url")))).alias("xml"))
    subs = pages.where(i % 8 != 3).select(F.concat(site, name(i)).alias("url"), F.concat(F.when(i % 2 == 0, "<urlset").otherwise("<sitemapindex"), F.lit(">"), F.when(i % 11 > 0, _FILLER).otherwise(""), loc(F.lit(" "), F.col("url")), loc(site, name(i + 2)), loc(site, F.lit("sitemap.xml")), loc(F.lit("/relative"))).alias("xml"))
    fetched = index.select("url", "xml").unionByName(plain.select("url", "xml")).unionByName(subs)
    return frontier.sitemap_pages(pages.select(k.alias("site"), F.concat(site, F.lit("sitemap.xml")).alias("url")), fetched, rounds=_ROUNDS)


# --- State machines and late arrivals --------------------------------------------------------------------------------------
_KINDS = ["sent", "followup", "opened", "followup", "sent", "followup", "replied", "followup", "sent", "stopped", "followup", "bounced"]
_MOVE = "CASE kind " + " ".join(f"WHEN '{kind}' THEN CASE state " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in moves.items()) + " END" for kind, moves in states.MOVES.items()) + " END"


@query("TIME_2_transitions", f"""WITH RECURSIVE e AS (SELECT user_id * 7 + event_id % 7 AS key, event_id AS seq, {picked("event_id", ["'" + k + "'" for k in _KINDS])} AS kind, row_number() OVER (PARTITION BY user_id * 7 + event_id % 7 ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS before, 'queued' AS state, false AS accepted FROM (SELECT DISTINCT key FROM e)
 UNION ALL SELECT key, i, seq, kind, state, coalesce({_MOVE}, state), {_MOVE} IS NOT NULL FROM (SELECT e.*, r.state FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))
SELECT key, seq, kind, before, state, accepted FROM r WHERE i > 0""")
def _(spark, d):
    i = F.col("event_id")
    return states.transitions(t(spark, d, "events").select((F.col("user_id") * 7 + i % 7).alias("key"), F.col("ts").alias("at"), i.alias("seq"), chosen(i, [F.lit(k) for k in _KINDS]).alias("kind")))


_ARRIVALS = f"""WITH e AS (SELECT user_id * 50 + event_id // 100 % 50 AS key, ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'result' END AS kind FROM events),
b AS (SELECT key, min(ts) AS start FROM e WHERE kind = 'start' GROUP BY 1),
w AS (SELECT key, seq, CASE WHEN ts >= start THEN epoch_us(ts) // 1000 - epoch_us(start) // 1000 END AS waited_ms FROM e LEFT JOIN b USING (key) WHERE kind = 'result'),
a AS (SELECT *, CASE WHEN waited_ms <= {states.SOFT_MS * 1000} THEN 'prompt' WHEN waited_ms <= {states.HARD_MS * 1000} THEN 'late' ELSE 'dropped' END AS arrived FROM w)"""


def _arrived(spark, d):
    # the table's events are minutes apart, so seconds stand for milliseconds
    i = F.col("event_id")
    rows = t(spark, d, "events").select((F.col("user_id") * 50 + F.floor(i / 100) % 50).cast("long").alias("key"), F.col("ts").alias("at"), i.alias("seq"), F.when(i % 3 == 0, "start").otherwise("result").alias("kind"))
    return states.arrivals(rows, states.SOFT_MS * 1000, states.HARD_MS * 1000)


@query("TIME_8_arrivals", _ARRIVALS + " SELECT key, seq, waited_ms, arrived FROM a")
def _(spark, d):
    return _arrived(spark, d)


@query("TIME_8_enriched", _ARRIVALS + " SELECT key, count(*) FILTER (arrived = 'prompt') AS n_prompt, count(*) FILTER (arrived = 'late') AS n_late, count(*) FILTER (arrived = 'prompt') > 0 AS prompt_enriched, count(*) FILTER (arrived = 'late') > 0 AS reextract FROM a GROUP BY key")
def _(spark, d):
    return states.enriched(_arrived(spark, d))
