"""Registered queries on extraction, matching, audits and lead lists, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import extraction as E
from granary.functions import text as X
from granary.functions.signal_rules import OWN_SUBJECTS
from granary.operators import entity, grounding
from granary.plans.more import chosen, listed, picked, q
from granary.plans.registry import query, t
from granary.sources import leads

# --- Extraction -----------------------------------------------------------------------------------------------------------
_LISTS = ["'Top competitors include ' || p_brand || ' Corp, Zeta and others. Not Alpha'", "'alternatives to Omega Works; ' || p_name", "'we compete with Beta Ltd and ' || upper(p_name[1]) || 'x! Gamma'", "p_name"]


def _lists():
    name, brand = F.col("p_name"), F.col("p_brand")
    return chosen(F.col("p_partkey"), [F.concat(F.lit("Top competitors include "), brand, F.lit(" Corp, Zeta and others. Not Alpha")), F.concat(F.lit("alternatives to Omega Works; "), name), F.concat(F.lit("we compete with Beta Ltd and "), F.upper(F.substring(name, 1, 1)), F.lit("x! Gamma")), name])


@query("EXT_13_listed_names", f"WITH x AS (SELECT p_partkey, {picked('p_partkey', _LISTS)} AS s FROM part), w AS (SELECT p_partkey, regexp_extract(regexp_extract(s, '(?i:{q(E.LIST_TRIGGER)})(?s:(.{{0,200}}))', 1), '^[^.!?]*', 0) AS w FROM x) SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(w, '({q(E.PROPER_NOUN)})', 1), lambda n: length(n) BETWEEN 3 AND 60), '|') AS names FROM w")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(E.listed_names(_lists()), "|").alias("names"))


_HEADS = ["upper(p_name[1]) || 'ab Works: ' || p_type", "'Top Makers: ' || p_name", "'Acme & Co | Home'", "p_name", "'Steel Market Size: 2030'"]


@query("EXT_15_title_names", f"WITH x AS (SELECT p_partkey, {picked('p_partkey', _HEADS)} AS s FROM part), n AS (SELECT p_partkey, regexp_extract(s, '{q(E.TITLE_PREFIX)}', 1) AS n FROM x) SELECT p_partkey, CASE WHEN length(n) BETWEEN 3 AND 60 AND NOT regexp_matches(n, '{q(E.LISTICLE)}') THEN n END AS name FROM n")
def _(spark, d):
    name = F.col("p_name")
    s = chosen(F.col("p_partkey"), [F.concat(F.upper(F.substring(name, 1, 1)), F.lit("ab Works: "), "p_type"), F.concat(F.lit("Top Makers: "), name), F.lit("Acme & Co | Home"), name, F.lit("Steel Market Size: 2030")])
    return t(spark, d, "part").select("p_partkey", E.title_name(s).alias("name"))


_PLANTS = ["'we run ' || p_size || ' manufacturing plants in ' || p_size || '+ countries'", "'with Seven manufacturing facilities'", "p_name", "'two offices, 3 manufacturing  units'"]
_NUMBERS = f"[{listed(E.NUMBER_WORDS)}]"


@query("EXT_8_plant_counts", f"WITH x AS (SELECT p_partkey, {picked('p_partkey', _PLANTS)} AS s FROM part) SELECT p_partkey, coalesce(try_cast(regexp_extract(s, '(?i)(\\d+){E.PLANTS}', 1) AS INT), nullif(list_position({_NUMBERS}, lower(regexp_extract(s, '(?i)\\b({'|'.join(E.NUMBER_WORDS)}){E.PLANTS}', 1))), 0)::INT) AS plants, try_cast(regexp_extract(s, '(?i)(\\d+)\\+?\\s+countr', 1) AS INT) AS countries FROM x")
def _(spark, d):
    size = F.col("p_size").cast("string")
    s = chosen(F.col("p_partkey"), [F.concat(F.lit("we run "), size, F.lit(" manufacturing plants in "), size, F.lit("+ countries")), F.lit("with Seven manufacturing facilities"), F.col("p_name"), F.lit("two offices, 3 manufacturing  units")])
    return t(spark, d, "part").select("p_partkey", E.plant_count(s).alias("plants"), E.country_count(s).alias("countries"))


@query("EXT_4_job_blocks", f"WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Role. Key responsibilities: ' ELSE '' END || text AS s FROM conversations), b AS (SELECT conv_id, turn, trim(regexp_replace(regexp_extract(s, '{q(E.RESPONSIBILITIES)}(?s:(.{{0,400}}))', 1), '\\s+', ' ', 'g')) AS block FROM x) SELECT conv_id, turn, block FROM b WHERE length(block) >= 60")
def _(spark, d):
    s = F.concat(F.when(F.col("turn") % 3 == 0, "Role. Key responsibilities: ").otherwise(""), "text")
    return t(spark, d, "conversations").select("conv_id", "turn", E.job_block(s).alias("block")).where("block IS NOT NULL")


@query("EXT_19_last_message", "SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS said FROM conversations GROUP BY 1")
def _(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("said"))


# --- Confidence and matching ----------------------------------------------------------------------------------------------
@query("AGG_4_confidence_formulas", "SELECT p_partkey, CASE WHEN n >= 2 AND f THEN 'high' WHEN n >= 2 OR (n = 1 AND f) THEN 'medium' ELSE 'low' END AS framed, CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS counted, CASE WHEN r >= 1 AND f THEN 'high' WHEN r >= 0.5 THEN 'medium' ELSE 'low' END AS titled FROM (SELECT p_partkey, p_partkey % 4 AS n, p_size % 2 = 0 AS f, (p_size % 5) / 4::DOUBLE AS r FROM part)")
def _(spark, d):
    n, f, r = F.col("p_partkey") % 4, F.col("p_size") % 2 == 0, (F.col("p_size") % 5) / 4
    return t(spark, d, "part").select("p_partkey", entity.framed_confidence(n, f).alias("framed"), entity.counted_confidence(n).alias("counted"), entity.title_confidence(r, f).alias("titled"))


_TITLE_LIST = ["Vice President of Sales", "Chief Executive Officer", "Head of Plant", "Sales Director"]
_OWN_TITLES = ["CEO", "VP Sales", "Plant Head", "Director of Design", "the sales vice president"]
_TW = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ({listed(grounding.TITLE_STOPWORDS)}))"
_RATIO = lambda a, b: f"CASE WHEN len({a}) > 0 THEN len(list_filter({a}, lambda w: list_contains({b}, w))) / len({a})::DOUBLE ELSE 0.0 END"
_NW = lambda c: f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s-]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


@query("JOIN_8_grounded_people", f"""
WITH c AS (SELECT p_partkey AS id, p_brand AS company, p_name AS a, {picked("p_partkey", ["'" + x + "'" for x in _OWN_TITLES])} AS own FROM part WHERE p_partkey % 2 = 1), l AS (SELECT p_brand AS company, p_partkey AS pos, p_name AS b, {picked("p_partkey // 2", ["'" + x + "'" for x in _TITLE_LIST])} AS listed FROM part WHERE p_partkey % 2 = 0 AND p_brand <> 'Brand#11'),
m AS (SELECT id, own, listed FROM c JOIN l USING (company) WHERE lower(a) = lower(b) OR greatest({_RATIO(_NW('a'), _NW('b'))}, {_RATIO(_NW('b'), _NW('a'))}) >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)
SELECT c.id, CASE WHEN c.company NOT IN (SELECT company FROM l) THEN NULL WHEN listed IS NULL THEN 'not_found' WHEN (regexp_matches(c.own, '^[A-Za-z]{{2,5}}$') AND array_to_string(list_transform(string_split(listed, ' '), lambda w: upper(w[1])), '') = upper(c.own)) OR greatest({_RATIO(_TW('c.own'), _TW('listed'))}, {_RATIO(_TW('listed'), _TW('c.own'))}) >= 0.4 THEN 'confirmed' ELSE 'conflict' END AS status, listed AS listed_title FROM c LEFT JOIN m USING (id)""")
def _(spark, d):
    p = t(spark, d, "part")
    people = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("name"), chosen(F.col("p_partkey"), [F.lit(x) for x in _OWN_TITLES]).alias("title"))
    contacts = p.where("p_partkey % 2 = 0 AND p_brand <> 'Brand#11'").select(F.col("p_brand").alias("company"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), chosen(F.floor(F.col("p_partkey") / 2), [F.lit(x) for x in _TITLE_LIST]).alias("title"))
    return grounding.ground_people(people, contacts)


@query("JOIN_9_best_titles", f"""
WITH j AS (SELECT p_size AS person, {picked("p_partkey", ["'" + x + "'" for x in _OWN_TITLES])} AS title, p_partkey % 3 = 0 AS cur FROM part), g AS (SELECT unnest([{listed(_TITLE_LIST)}]) AS target, unnest(generate_series(0, 3)) AS place),
r AS (SELECT person, target, place, cur, {_RATIO(_TW('target'), _TW('title'))} AS ratio FROM j, g), b AS (SELECT DISTINCT person, target, ratio, cur FROM r WHERE ratio > 0 QUALIFY dense_rank() OVER (PARTITION BY person ORDER BY ratio DESC, cur DESC, place) = 1)
SELECT person, target, ratio, CASE WHEN ratio >= 1 AND cur THEN 'high' WHEN ratio >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def _(spark, d):
    jobs = t(spark, d, "part").select(F.col("p_size").alias("person"), chosen(F.col("p_partkey"), [F.lit(x) for x in _OWN_TITLES]).alias("title"), (F.col("p_partkey") % 3 == 0).alias("is_current"))
    return grounding.best_titles(jobs, _TITLE_LIST)


@query("JOIN_10_tickers", """
WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS key FROM part WHERE p_partkey % 4 = 1),
l AS (SELECT p_partkey AS pos, p_brand || p_partkey AS ticker, lower(p_name) AS key FROM part WHERE p_partkey % 4 = 2),
x AS (SELECT id, arg_min(ticker, pos) AS ticker FROM n JOIN l ON lower(n.key) = l.key GROUP BY 1),
w AS (SELECT id, list_filter(string_split(lower(key), ' '), lambda v: v <> '' AND v NOT IN ('and', 'the', 'of', 'a', 'an')) AS w FROM n WHERE id NOT IN (SELECT id FROM x)),
m AS (SELECT pos, ticker, list_filter(string_split(key, ' '), lambda v: v <> '' AND v NOT IN ('and', 'the', 'of', 'a', 'an')) AS m FROM l),
c AS (SELECT id, ticker FROM w, m WHERE len(w) > 1 AND len(list_filter(w, lambda v: NOT list_contains(m, v))) = 0 AND len(m) <= len(w) + 2),
o AS (SELECT id, min(ticker) AS ticker FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT n.id, coalesce(x.ticker, o.ticker) AS ticker FROM n LEFT JOIN x USING (id) LEFT JOIN o USING (id)""")
def _(spark, d):
    p, word = t(spark, d, "part"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    name = chosen(F.col("p_partkey"), [F.lower("p_name"), F.concat_ws(" ", word(1), word(2)), word(1)])
    names = p.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("id"), name.alias("name"))
    tickers = p.where("p_partkey % 4 = 2").select(F.col("p_partkey").alias("pos"), F.concat("p_brand", F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("title"))
    return grounding.match_tickers(names, tickers)


@query("JOIN_11_shared_words", "WITH r AS (SELECT p_brand AS key, p_partkey AS id, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 4) AS w FROM part), t AS (SELECT key, id AS pos, w FROM r WHERE id % 3 = 0) SELECT r.id, min(pos) AS pos FROM r JOIN t ON r.key = t.key AND list_has_any(r.w, t.w) WHERE r.id % 3 = 1 GROUP BY 1")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("key"), "p_partkey", F.col("p_name").alias("text"))
    return grounding.first_shared_word(p.where("p_partkey % 3 = 1").withColumnRenamed("p_partkey", "id"), p.where("p_partkey % 3 = 0").withColumnRenamed("p_partkey", "pos"))


@query("JOIN_12_by_key", "WITH k AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part), f AS (SELECT key, min(p_partkey) AS entity FROM k WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, entity FROM k LEFT JOIN f USING (key) WHERE p_partkey % 2 = 1")
def _(spark, d):
    k = t(spark, d, "part").select("p_partkey", X.ascii_name_key(F.col("p_name")).alias("key"))
    first = k.where("p_partkey % 2 = 0").groupBy("key").agg(F.min("p_partkey").alias("entity"))
    return k.where("p_partkey % 2 = 1").join(first, "key", "left").select("p_partkey", "entity")


# --- Grounding and audits -------------------------------------------------------------------------------------------------
_DRAFTS = ["'cut costs by 30% in ' || p_size || ' days'", "'saved 3x'", "p_name", "'grew 12.5%'"]


@query("GRD_5_stat_grounding", f"""
WITH x AS (SELECT p_partkey, {picked("p_partkey", _DRAFTS)} AS s, {picked("p_partkey // 4", ["'30% and 7 days'", "'13x'", "'none'"])} AS o FROM part),
k AS (SELECT p_partkey, s, o, list_transform(regexp_extract_all(s, '([+-]?[0-9]+(?:[.][0-9]+)?(?:%|x| ?days?| ?hours?| ?cr))', 1), lambda v: regexp_replace(lower(v), '^[+-]', '')) AS a, list_transform(regexp_extract_all(o, '([+-]?[0-9]+(?:[.][0-9]+)?(?:%|x| ?days?| ?hours?| ?cr))', 1), lambda v: regexp_replace(lower(v), '^[+-]', '')) AS b FROM x)
SELECT p_partkey, len(a) > 0 AND len(list_filter(a, lambda y: len(list_filter(b, lambda z: contains(y, z) OR contains(z, y))) > 0)) = 0 AS ungrounded, CASE WHEN list_contains(['p1', 'p2'], 'p' || (p_partkey % 4)) THEN 'p' || (p_partkey % 4) ELSE '' END AS id FROM k""")
def _(spark, d):
    s = chosen(F.col("p_partkey"), [F.concat(F.lit("cut costs by 30% in "), F.col("p_size").cast("string"), F.lit(" days")), F.lit("saved 3x"), F.col("p_name"), F.lit("grew 12.5%")])
    o = chosen(F.floor(F.col("p_partkey") / 4), [F.lit("30% and 7 days"), F.lit("13x"), F.lit("none")])
    claimed = F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string"))
    return t(spark, d, "part").select("p_partkey", grounding.has_ungrounded_stat(s, o).alias("ungrounded"), grounding.whitelisted(claimed, F.array(F.lit("p1"), F.lit("p2"))).alias("id"))


_SUBJECTS = ["industry_trend", "product_capability", "other", "industry_trend", "company_operations"]


@query("AGG_7_subject_floor", f"""
WITH e AS (SELECT o_custkey, o_orderkey AS seq, o_orderpriority AS type, CASE WHEN o_custkey % 3 = 0 THEN 'industry_trend' ELSE {picked("o_orderkey", ["'" + x + "'" for x in _SUBJECTS])} END AS subject, 1 + o_orderkey % 3 AS tier, 'q' || o_orderkey AS quote FROM orders),
f AS (SELECT * FROM e WHERE subject IN ('industry_trend', 'product_capability') AND o_custkey NOT IN (SELECT o_custkey FROM e WHERE subject IN ({listed(OWN_SUBJECTS)})) QUALIFY row_number() OVER (PARTITION BY o_custkey, type ORDER BY seq) <= 2)
SELECT o_custkey, type, count(*) AS n, arg_min(quote, (tier, seq)) AS best_quote FROM f GROUP BY ALL""")
def _(spark, d):
    subject = F.when(F.col("o_custkey") % 3 == 0, "industry_trend").otherwise(chosen(F.col("o_orderkey"), [F.lit(x) for x in _SUBJECTS]))
    e = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("type"), subject.alias("subject"), (F.col("o_orderkey") % 3 + 1).alias("tier"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("quote"))
    return grounding.subject_floor(e, "o_custkey")


def _audited(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    claims = o.select(F.col("o_custkey").alias("company"), F.lit("opportunity").alias("kind"), F.col("o_orderkey").cast("string").alias("ref"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("evidence_id"), F.when(F.col("o_orderstatus") == "O", "high").otherwise("low").alias("confidence"))
    names = c.select(F.col("c_custkey").alias("company"), F.lit("competitor").alias("kind"), F.col("c_name").alias("ref"), F.when(F.col("c_acctbal") > 0, "high").otherwise("low").alias("confidence"), (F.col("c_nationkey") % 4).alias("n_urls"), (F.col("c_custkey") % 10 == 0).alias("is_self"))
    evidence = o.select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "product_capability").otherwise("other").alias("subject"))
    return grounding.audit(claims, names, evidence)


@query("AGG_21_research_audit", """
WITH s AS (SELECT o_custkey AS company, o_orderkey::VARCHAR AS ref FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'), n AS (SELECT c_custkey AS company, c_name AS ref FROM customer WHERE (c_acctbal > 0 AND c_nationkey % 4 < 2) OR c_custkey % 10 = 0),
f AS (SELECT company, count(*) AS flagged FROM (SELECT company, 'o' AS k, ref FROM s UNION SELECT company, 'c', ref FROM n) GROUP BY 1), a AS (SELECT company, count(*) AS audited FROM (SELECT o_custkey AS company FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT c_custkey FROM customer) GROUP BY 1)
SELECT company, audited, coalesce(flagged, 0) AS flagged FROM a LEFT JOIN f USING (company)""")
def _(spark, d):
    return _audited(spark, d)[1]


@query("JOIN_13_audit_flags", "SELECT o_custkey AS company, 'opportunity' AS kind, o_orderkey::VARCHAR AS ref, 'evidence_subject_mismatch' AS flag FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey, 'competitor', c_name, 'single_mention_high_confidence' FROM customer WHERE c_acctbal > 0 AND c_nationkey % 4 < 2 UNION ALL SELECT c_custkey, 'competitor', c_name, 'self_name_collision' FROM customer WHERE c_custkey % 10 = 0")
def _(spark, d):
    return _audited(spark, d)[0]


# --- Lead lists and outputs -----------------------------------------------------------------------------------------------
@query("SRC_3_table_rows", "WITH h AS (SELECT c_custkey, '<table><tr><th>Company</th><th>Role</th></tr><tr><td> <b>' || c_name || '</b></td><td>' || c_mktsegment || '</td></tr></table>' AS h FROM customer), r AS (SELECT c_custkey, regexp_extract_all(h, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS rows FROM h) SELECT c_custkey, len(rows)::INT AS n, array_to_string(list_transform(regexp_extract_all(rows[2], '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(c, '<[^>]+>', '', 'g'))), '|') AS cells FROM r")
def _(spark, d):
    html = F.concat(F.lit("<table><tr><th>Company</th><th>Role</th></tr><tr><td> <b>"), "c_name", F.lit("</b></td><td>"), "c_mktsegment", F.lit("</td></tr></table>"))
    return t(spark, d, "customer").select("c_custkey", leads.html_rows(html).alias("r")).select("c_custkey", F.size("r").alias("n"), F.array_join(F.element_at("r", 2), "|").alias("cells"))


@query("SRC_4_tab_rows", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END::INT AS n, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS second FROM customer")
def _(spark, d):
    text = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Company\tRole\n\n").otherwise("Company Role\n"), "c_name", F.lit("\tx"))
    return t(spark, d, "customer").select("c_custkey", leads.tab_rows(text).alias("r")).select("c_custkey", F.size("r").alias("n"), F.get(F.get("r", 1), 0).alias("second"))


@query("SRC_7_projected_leads", "SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS company_name, c_mktsegment AS job_title, CASE WHEN c_custkey % 5 = 0 THEN 'Row ' || (c_custkey + 2) || ': no company name' END AS warning FROM customer")
def _(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_phone" if "c_phone" in t(spark, d, "customer").columns else "c_mktsegment").alias("Profile URL"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit(" "), "c_name")).otherwise("  ").alias("Organization Name"), F.col("c_mktsegment").alias("Role"))
    good, bad = leads.project(rows)
    return good.select("pos", "company_name", "job_title", F.lit(None).cast("string").alias("warning")).unionByName(bad.join(rows.select("pos", F.col("Role").alias("job_title")), "pos").select("pos", F.lit(None).cast("string").alias("company_name"), "job_title", "warning"))


@query("SNK_3_brief_html", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.html' AS file, '<h1>' || replace(replace(p_name || ' & <' || p_brand || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') || '</h1>' AS html FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.concat(X.slug(F.col("p_name")), F.lit(".html")).alias("file"), F.concat(F.lit("<h1>"), X.html_escape(F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">"))), F.lit("</h1>")).alias("html"))


@query("SNK_4_json_history", "SELECT o_custkey, '{\"runs\":' || count(*) || ',\"last\":' || max(o_orderkey) || '}' AS json FROM orders GROUP BY 1")
def _(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("runs"), F.max("o_orderkey").alias("last"))
    return g.select("o_custkey", F.to_json(F.struct("runs", "last")).alias("json"))


@query("SORT_3_stable_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS pos FROM orders")
def _(spark, d):
    strength = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(strength, "o_orderdate", "o_orderkey")).alias("pos"))


@query("SORT_7_by_name_and_age", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey DESC) AS by_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS newest FROM customer")
def _(spark, d):
    w = Window.partitionBy("c_nationkey")
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w.orderBy("c_name", F.desc("c_custkey"))).alias("by_name"), F.row_number().over(w.orderBy(F.desc("c_custkey"))).alias("newest"))


_VARIANT_TEXT = "lower(p_name || ' and the ' || p_type || ' of ' || p_brand)"


@query("TXT_10_significant_words", f"WITH x AS (SELECT p_partkey, {_VARIANT_TEXT} AS k FROM part) SELECT p_partkey, len(list_filter(regexp_split_to_array(regexp_replace(k, '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({listed(X.GENERIC_NAME_WORDS)})))::INT AS guards, len(list_filter(string_split(k, ' '), lambda w: w <> '' AND w NOT IN ('and', 'the', 'of', 'a', 'an')))::INT AS filings, len(list_filter(string_split(k, ' '), lambda w: w <> ''))::INT AS plain FROM x")
def _(spark, d):
    k = F.lower(F.concat("p_name", F.lit(" and the "), "p_type", F.lit(" of "), "p_brand"))
    return t(spark, d, "part").select("p_partkey", F.size(X.guard_words(k)).alias("guards"), F.size(X.filing_words(k)).alias("filings"), F.size(X.plain_words(k)).alias("plain"))


@query("TXT_11_word_match", "SELECT p_partkey, regexp_matches(' ' || lower(p_type) || ' ', '[^a-z0-9]' || lower(split_part(p_type, ' ', 1)) || '[^a-z0-9]') AS whole, regexp_matches(' ' || lower(p_type) || 's ', '[^a-z0-9]' || lower(split_part(p_type, ' ', -1)) || '[^a-z0-9]') AS part FROM part")
def _(spark, d):
    words = F.split("p_type", " ")
    return t(spark, d, "part").select("p_partkey", X.has_word(F.col("p_type"), F.element_at(words, 1)).alias("whole"), X.has_word(F.concat("p_type", F.lit("s")), F.element_at(words, -1)).alias("part"))
