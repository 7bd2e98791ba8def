"""Queries over the driver tables, each with equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import url as U
from granary.operators import content, entity, events, evidence, scoring, web

REGISTRY: dict = {}
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def put(f):
        REGISTRY[name] = (f, sql)
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- URLs -----------------------------------------------------------------------------------------------------------
REST = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
HOST = f"regexp_replace(lower(regexp_extract({REST}, '^([^/?#:]*)', 1)), '^www\\.', '')"
PATH = f"CASE WHEN regexp_extract({REST}, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({REST}, '^[^/?#]*([^?#]*)', 1) END"
SEGS = "list_filter(string_split(lower(path), '/'), lambda s: s <> '')"
ARTICLE = f"(len({SEGS}) >= 2 AND regexp_matches({SEGS}[1], '{U.ARTICLE_FOLDERS}') AND {SEGS}[2] NOT IN ({', '.join(repr(x) for x in U.SUB_INDEXES)}) AND NOT regexp_matches({SEGS}[2], '^\\d{{4}}$'))"
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{U.keyword_pattern(w)}') THEN " + (f"CASE WHEN {ARTICLE} THEN 'article' ELSE 'media' END" if n == "media" else f"'{n}'") for n, _, w in U.CATEGORIES) + " ELSE 'other' END"
POINTS = "CASE category WHEN 'article' THEN 15 " + " ".join(f"WHEN '{n}' THEN {s}" for n, s, _ in U.CATEGORIES) + " ELSE 30 END"
LOCALES = f"""d AS (SELECT DISTINCT {HOST} AS site, url, {PATH} AS path FROM pages),
g AS (SELECT *, {SEGS}[1] AS segment, {CATEGORY} AS category FROM d),
loc AS (SELECT site, segment, count(*) AS n FROM g WHERE regexp_matches(segment, '^[a-z]{{2}}(-[a-z]{{2}})?$') AND segment NOT IN ({', '.join(repr(x) for x in U.SHORT_KEYWORDS)}) GROUP BY ALL HAVING count(*) >= 3)"""
SCORED = f"""WITH {LOCALES}, s AS (SELECT g.site, url, category, CASE WHEN n IS NOT NULL AND NOT (segment = 'en' OR suffix(segment, '-en')) THEN greatest(0, ({POINTS}) - 40) ELSE {POINTS} END AS score FROM g LEFT JOIN loc USING (site, segment))"""


@query("URL_11_rank_pages", SCORED + " SELECT site, url, category, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank FROM s QUALIFY rank <= 15")
def _(spark, d):
    return web.rank_pages(t(spark, d, "pages")).select("site", "url", "category", "score", "rank")


@query("URL_9_locale_segments", f"WITH {LOCALES} SELECT site, segment, n FROM loc")
def _(spark, d):
    return web.locale_segments(t(spark, d, "pages").select(U.host(F.col("url")).alias("site"), "url", U.path(F.col("url")).alias("path")).distinct())


@query("URL_2_domains", f"SELECT {HOST} AS site, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    return t(spark, d, "pages").groupBy(U.host(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


@query("URL_6_categories", f"WITH d AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, {CATEGORY} AS category FROM d")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", U.category(U.path(F.col("url"))).alias("category"))


@query("SRC_9_page_links", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"#]+)', 1))) AS link FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1)))).alias("link")).where("link IS NOT NULL")


@query("TXT_23_page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS size FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


@query("TIME_11_early_exit", f"WITH p AS (SELECT {HOST} AS site, page_id, length(html) AS n FROM pages), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT site, page_id, before::BIGINT AS before FROM c WHERE before < 12000")
def _(spark, d):
    p = t(spark, d, "pages").select(U.host(F.col("url")).alias("site"), F.col("page_id").alias("pos"), F.length("html").alias("n_chars"))
    return web.accumulate(p, 12_000).select("site", F.col("pos").alias("page_id"), F.col("before").cast("long").alias("before"))


@query("WIN_2_one_per_host", f"WITH p AS (SELECT 'all' AS key, {HOST} AS host, CASE WHEN contains(url, '/en/') THEN 0 ELSE 1 END AS pass, page_id AS pos FROM pages), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY host ORDER BY pass, pos) = 1) SELECT host, pass, pos, row_number() OVER (PARTITION BY key ORDER BY pass, pos) AS rank FROM f QUALIFY rank <= 5")
def _(spark, d):
    p = t(spark, d, "pages").select(F.lit("all").alias("key"), U.host(F.col("url")).alias("host"), F.when(F.contains("url", F.lit("/en/")), 0).otherwise(1).alias("pass"), F.col("page_id").alias("pos"))
    return web.one_per_host(p, 5).select("host", "pass", "pos", "rank")


# --- Text -----------------------------------------------------------------------------------------------------------
FIXTURE_OPERATIONAL = "(?i)(tion|ment|keit)"
_COOKIE, _BOILER, _NAV, _SEP = (x.replace("'", "''") for x in (content.COOKIE, content.BOILERPLATE, content.NAVIGATION, content.SEPARATOR))


@query("AGG_10_content_quality", f"""
WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\\s+|\\s+$', '', 'g') AS l FROM documents),
k AS (SELECT doc_id, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '{_COOKIE}') THEN 'c' WHEN regexp_matches(l, '{_BOILER}') THEN 'b'
  WHEN len(regexp_split_to_array(l, '\\s+')) <= 4 AND (regexp_matches(l, '{_NAV}') OR regexp_matches(l, '{_SEP}')) THEN 'v'
  WHEN len(regexp_split_to_array(l, '\\s+')) >= 8 THEN CASE WHEN regexp_matches(l, '{FIXTURE_OPERATIONAL}') THEN 'o' ELSE 's' END ELSE 'x' END AS k FROM l),
c AS (SELECT doc_id, count(k) AS n_lines, count(*) FILTER (k = 'c') / greatest(count(k), 1)::DOUBLE AS rc, count(*) FILTER (k = 'v') / greatest(count(k), 1)::DOUBLE AS rv,
  count(*) FILTER (k = 'b') / greatest(count(k), 1)::DOUBLE AS rb, count(*) FILTER (k IN ('s', 'o')) / greatest(count(k), 1)::DOUBLE AS rs, count(*) FILTER (k = 'o') / greatest(count(k), 1)::DOUBLE AS ro, count(*) FILTER (k = 'o') AS o FROM k GROUP BY doc_id),
s AS (SELECT *, CASE WHEN n_lines = 0 THEN 0 ELSE greatest(0, least(100, floor(100.5 - (CASE WHEN rc > 0.10 THEN least(40.0, rc * 200) ELSE 0 END) - (CASE WHEN rv > 0.20 THEN least(20.0, rv * 60) ELSE 0 END) - (CASE WHEN rb > 0.20 THEN least(20.0, rb * 60) ELSE 0 END) + (CASE WHEN ro > 0.30 THEN 10 WHEN ro < 0.10 THEN -20 ELSE 0 END)))) END::INT AS score,
  list_filter([CASE WHEN rc > 0.15 THEN 'cookie_heavy' END, CASE WHEN rv > 0.40 AND rs < 0.20 THEN 'navigation_only' END, CASE WHEN rb > 0.30 AND rs < 0.20 THEN 'marketing_boilerplate' END, CASE WHEN ro < 0.05 AND rs > 0.15 THEN 'customer_stories_only' END, CASE WHEN rs < 0.10 AND o = 0 THEN 'no_operational_content' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT doc_id, n_lines, score, array_to_string(f, ',') AS flags, CASE WHEN score >= 60 AND len(f) = 0 THEN 'proceed' WHEN n_lines > 0 AND (score >= 35 OR (len(f) <= 1 AND NOT list_contains(f, 'no_operational_content'))) THEN 'proceed_with_caution' ELSE 'low_confidence' END AS recommendation FROM s""")
def _(spark, d):
    return content.content_quality(t(spark, d, "documents").select("doc_id", "text"), "doc_id", FIXTURE_OPERATIONAL).select("doc_id", "n_lines", "score", "flags", "recommendation")


@query("TXT_5_token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", X.tokens_estimate(F.col("text")).cast("long").alias("tokens"))


@query("TXT_22_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("TXT_7_ascii_name_keys", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.ascii_name_key(F.col("c_name")).alias("key"))


@query("TXT_27_stat_tokens", "SELECT conv_id, turn, len(regexp_extract_all(text, '([+-]?[0-9]+(?:[.][0-9]+)?(?:%|x| ?days?| ?hours?| ?cr))', 1))::BIGINT AS n FROM conversations")
def _(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(X.stat_tokens(F.col("text"))).cast("long").alias("n"))


@query("TXT_30_fnv1a", "SELECT p_partkey, list_reduce(list_transform(string_split(p_brand, ''), lambda c: ascii(c)::HUGEINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::HUGEINT)::BIGINT AS h FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.fnv1a(F.col("p_brand")).alias("h"))


@query("AGG_5_keep_first", "WITH k AS (SELECT doc_id, source, substr(text, 1, 60) AS k FROM documents) SELECT doc_id, source FROM k QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id) = 1")
def _(spark, d):
    return events.keep_first(t(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 60).alias("k")), ["source", "k"], ["doc_id"]).select("doc_id", "source")


@query("GRD_1_quote_verification", """
WITH b AS (SELECT item_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q, substr(text, 1, 24) AS k FROM benchmark WHERE length(trim(text)) >= 30)
SELECT DISTINCT item_id, doc_id FROM b JOIN documents d ON contains(d.text, b.k) AND contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), q)""")
def _(spark, d):
    quotes = t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return content.quote_tiers(quotes, t(spark, d, "documents").select("doc_id", "text")).where("tier = 'exact'").select("item_id", "doc_id").distinct()


@query("EXT_18_last_user_turn", "SELECT conv_id, max(turn) AS turn, arg_max(length(text), turn) AS size FROM conversations WHERE role = 'user' GROUP BY 1")
def _(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.length("text"), "turn").cast("long").alias("size"))


# --- Events and state ---------------------------------------------------------------------------------------------------
STATUS = {"signup": "queued", "view": "sent", "click": "followup_1", "purchase": "followup_2", "error": "replied"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items()) + " END"


def status_of(column):
    out = F.lit(None).cast("string")
    for a, b in STATUS.items():
        out = F.when(column == a, b).otherwise(out)
    return out


@query("AGG_1_status_histogram", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) / count(*)::DOUBLE AS rate FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("value") > 100) / F.count("*")).alias("rate"))


@query("AGG_2_last_day", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 24 HOURS")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("TIME_2_latest_state", f"SELECT user_id, event_id, {STATUS_SQL} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    return events.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", status_of(F.col("event_type")).alias("status"))


@query("TIME_1_followup_due", f"WITH l AS (SELECT user_id, ts, {STATUS_SQL} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), s AS (SELECT *, CASE status WHEN 'sent' THEN 3 WHEN 'followup_1' THEN 4 WHEN 'followup_2' THEN 7 END AS days FROM l) SELECT user_id, status, days IS NOT NULL AND ts + to_days(days) <= TIMESTAMP '{NOW}' AS due FROM s")
def _(spark, d):
    last = events.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", F.col("ts").cast("timestamp").alias("ts"), status_of(F.col("event_type")).alias("status"))
    return last.select("user_id", "status", F.coalesce(events.due_at(F.col("status"), F.col("ts")) <= F.lit(NOW).cast("timestamp"), F.lit(False)).alias("due"))


@query("TIME_4_rate_limit", """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT key, event_id, t, i, t AS start, 1 AS n, true AS allowed FROM e WHERE i = 1 UNION ALL
 SELECT e.key, e.event_id, e.t, e.i, CASE WHEN e.t - r.start >= 21600 THEN e.t ELSE r.start END, CASE WHEN e.t - r.start >= 21600 THEN 1 WHEN r.n >= 2 THEN r.n ELSE r.n + 1 END, e.t - r.start >= 21600 OR r.n < 2 FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, event_id, allowed, CASE WHEN NOT allowed THEN ceil(start + 21600 - t)::BIGINT END AS retry_s FROM r""")
def _(spark, d):
    return events.rate_limited(t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id"), 2, 6 * 3600)


@query("TIME_6_ttl", f"SELECT event_id, ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AS fresh FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", (F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 30 DAYS")).alias("fresh"))


@query("TIME_7_idempotent_events", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) = 1")
def _(spark, d):
    return events.keep_first(t(spark, d, "events"), ["user_id", "event_type", "props"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("TIME_8_late_class", "SELECT event_id, CASE WHEN value * 100 <= 8000 THEN 'prompt' WHEN value * 100 <= 70000 THEN 'late' ELSE 'dropped' END AS arrived FROM events")
def _(spark, d):
    ms = F.col("value") * 100
    return t(spark, d, "events").select("event_id", F.when(ms <= 8000, "prompt").when(ms <= 70000, "late").otherwise("dropped").alias("arrived"))


@query("WIN_3_streaks", "WITH h AS (SELECT *, (event_type = 'error')::INT AS hit, sum(1 - (event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT event_id, sum(hit) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS streak FROM h")
def _(spark, d):
    return events.streaks(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", F.col("streak").cast("long").alias("streak"))


@query("WIN_4_previous_value", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("WIN_6_first_fill", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS filled FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("filled"))


@query("TXT_24_json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json(X.json_object(F.col("props")), "k bigint")["k"].alias("k"))


# --- Joins, sets, upserts ------------------------------------------------------------------------------------------------
@query("JOIN_1_left_embeds", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("JOIN_3_unseen", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return entity.unseen(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("domain")), o.select(F.lit(None).cast("string").alias("name"), F.col("o_custkey").cast("string").alias("domain"))).select("c_custkey", F.col("name").alias("c_name"))


@query("JOIN_5_suppressed", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, d):
    n = t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return t(spark, d, "supplier").join(n, "s_nationkey", "left_anti").select("s_suppkey")


@query("JOIN_18_cache_hits", "SELECT o_orderkey, coalesce(CASE WHEN l_tax <= 0.04 THEN l_quantity END, -1) AS q FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) ON o_orderkey = l_orderkey")
def _(spark, d):
    line = t(spark, d, "lineitem").where("l_linenumber = 1")
    o = t(spark, d, "orders")
    return o.join(line, o.o_orderkey == line.l_orderkey, "left").select("o_orderkey", F.coalesce(F.when(F.col("l_tax") <= 0.04, F.col("l_quantity")), F.lit(-1.0)).alias("q"))


@query("SNK_1_upsert", "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC) = 1")
def _(spark, d):
    return events.latest(t(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_quantity", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("SNK_1_insert_absent", "SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + 1000 FROM supplier WHERE s_suppkey + 1000 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    return events.insert_absent(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), t(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("id")), "id")


@query("SET_1_concat_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def _(spark, d):
    return t(spark, d, "nation").select(F.col("n_name").alias("name")).union(t(spark, d, "region").select("r_name")).distinct()


@query("SET_4_overlap", "WITH c AS (SELECT c_nationkey AS k, list_distinct(list(c_mktsegment)) AS s FROM customer GROUP BY 1) SELECT k, len(list_intersect(s, ['BUILDING', 'MACHINERY']))::BIGINT AS n FROM c")
def _(spark, d):
    return t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.size(F.array_intersect(F.collect_set("c_mktsegment"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")))).cast("long").alias("n"))


@query("SORT_6_page_then_filter", "SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50) WHERE o_orderstatus = 'O'")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).offset(50).where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus")


@query("WIN_1_top_n", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5")
def _(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("WIN_5_top_two_gap", "SELECT p_brand, p_partkey, p_retailprice = lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS tied FROM part")
def _(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") == F.lead("p_retailprice").over(w)).alias("tied"))


# --- Mentions, scores, evaluation ------------------------------------------------------------------------------------------
@query("AGG_3_mentions", """
WITH o AS (SELECT p_brand AS key, p_size AS r, min(p_partkey) AS pos, bool_or(p_retailprice > 1500) AS framed FROM part GROUP BY 1, 2),
m AS (SELECT o.*, p_name, p_type FROM o JOIN part ON p_partkey = pos)
SELECT key, arg_min(p_name, pos) AS name, count(*) AS mention_count, count(DISTINCT p_type) AS n_sources, bool_or(framed) AS framed,
  CASE WHEN count(*) >= 2 AND bool_or(framed) THEN 'high' WHEN count(*) >= 2 OR bool_or(framed) THEN 'medium' ELSE 'low' END AS confidence FROM m GROUP BY 1""")
def _(spark, d):
    m = t(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("result_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("url"), F.col("p_name").alias("snippet"), (F.col("p_retailprice") > 1500).alias("framed"))
    return entity.group_mentions(m).select("key", "name", "mention_count", "n_sources", "framed", entity.framed_confidence(F.col("mention_count"), F.col("framed")).alias("confidence"))


def _flag(name: str, i: int) -> str:
    return f"(c_custkey // {i + 2}) % 2 = 0"


_ALL = list(dict.fromkeys(n for n, _ in scoring.FIT + scoring.AUTOMATION))
_SUM = lambda w: "least(100, " + " + ".join(f"CASE WHEN {_flag(n, _ALL.index(n))} THEN {p} ELSE 0 END" for n, p in w) + ")"
_CAP = "CASE conf WHEN 'high' THEN 100 WHEN 'medium' THEN 82 ELSE 50 END"


@query("AGG_12_scores", f"""
WITH f AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf, (c_custkey % 12)::DOUBLE AS w FROM customer),
g AS (SELECT *, least({_SUM(scoring.FIT)}, {_CAP}) AS fit, least({_SUM(scoring.AUTOMATION)}, {_CAP}) AS auto, CASE WHEN conf = 'low' THEN least(w, 5.0) ELSE greatest(0.0, least(w, 10.0)) END AS why FROM f),
p AS (SELECT *, least(floor(fit * 0.35::DOUBLE + auto * 0.30::DOUBLE + why * 10 * 0.35::DOUBLE + 0.5), {_CAP})::BIGINT AS priority FROM g)
SELECT c_custkey, fit::BIGINT AS fit, auto::BIGINT AS automation, priority, CASE WHEN priority >= 80 THEN 'Strong' WHEN priority >= 60 THEN 'Good' WHEN priority >= 40 THEN 'Moderate' ELSE 'Weak' END AS label FROM p""")
def _(spark, d):
    conf = F.when(F.col("c_custkey") % 3 == 0, "high").when(F.col("c_custkey") % 3 == 1, "medium").otherwise("low")
    flag = lambda n: F.expr(f"(c_custkey div {_ALL.index(n) + 2}) % 2 = 0")
    s = t(spark, d, "customer").select("c_custkey", conf.alias("conf"), (F.col("c_custkey") % 12).cast("double").alias("w"))
    s = s.select("*", scoring.capped(scoring.points(scoring.FIT, flag), F.col("conf")).alias("fit"), scoring.capped(scoring.points(scoring.AUTOMATION, flag), F.col("conf")).alias("auto"), scoring.why_now(F.col("w"), F.col("conf")).alias("why"))
    s = s.withColumn("priority", scoring.priority(F.col("fit"), F.col("auto"), F.col("why"), F.col("conf")).cast("long"))
    return s.select("c_custkey", F.col("fit").cast("long").alias("fit"), F.col("auto").cast("long").alias("automation"), "priority", scoring.score_label(F.col("priority")).alias("label"))


@query("AGG_13_clusters", """
WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1), r AS (SELECT o_custkey, len(list_intersect(p, ['1-URGENT', '2-HIGH', '3-MEDIUM'])) / 3.0::DOUBLE AS x FROM s)
SELECT o_custkey, CASE WHEN x >= 0.66 THEN 'high' WHEN x >= 0.33 THEN 'medium' WHEN x > 0 THEN 'low' END AS confidence FROM r""")
def _(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")])
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).select("o_custkey", scoring.cluster_confidence(F.col("p"), wanted).alias("confidence"))


@query("AGG_25_run_deltas", "WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT m::DATE AS month, n, lo, hi, n - lag(n) OVER (ORDER BY m) AS delta FROM m")
def _(spark, d):
    m = t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return m.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("month")))


@query("AGG_29_leader_clusters", """
WITH RECURSIVE k AS (SELECT *, CASE WHEN length(replace(k, ' ', '')) >= 5 THEN replace(k, ' ', '') END AS s, row_number() OVER (ORDER BY pos) AS i FROM (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) || '.example' END AS domain, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM part)),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::BIGINT AS leader_pos, []::STRUCT(pos BIGINT, domain VARCHAR, k VARCHAR, s VARCHAR)[] AS led UNION ALL
 SELECT i, pos, coalesce(l, pos), CASE WHEN l IS NULL THEN list_append(led, {'pos': pos, 'domain': domain, 'k': k, 's': s}) ELSE led END FROM (SELECT k.*, led, coalesce(list_filter(led, lambda x: x.domain = k.domain)[1].pos, list_filter(led, lambda x: x.k = k.k)[1].pos, list_filter(led, lambda x: x.s = k.s)[1].pos) AS l FROM g JOIN k ON k.i = g.i + 1))
SELECT pos, leader_pos FROM g WHERE i > 0""")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")), F.lit(".example"))).alias("domain"), F.col("p_name").alias("name"))
    return entity.leader_clusters(p)


@query("UI_2_unpivot", "SELECT k, metric, v FROM (SELECT r_regionkey AS k, 'names' AS metric, length(r_name)::BIGINT AS v FROM region UNION ALL SELECT n_regionkey, 'nations', count(*) FROM nation GROUP BY 1)")
def _(spark, d):
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.length("r_name").cast("long").alias("names"))
    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("nations"))
    return r.join(n, "k").unpivot("k", ["names", "nations"], "metric", "v")


# --- Evidence, with rules that occur in the driver's texts -------------------------------------------------------------------
RULES = [("licence", "licen[sc]e"), ("copyright", "copyright"), ("contact", "[a-z0-9.]+@[a-z0-9.]+"), ("number", "[0-9]{4,}"), ("licence", "all rights reserved")]
_EVIDENCE = "WITH e AS (" + " UNION ALL ".join(f"SELECT doc_id, source, {i} AS rule, '{s}' AS signal, len(regexp_extract_all(text, '(?i){p}')) AS n FROM documents" for i, (s, p) in enumerate(RULES)) + ") "


def _evidence(spark, d):
    return evidence.extract(t(spark, d, "documents").select("doc_id", "source", "text"), ["doc_id", "source"], RULES)


@query("EXT_2_signal_matches", _EVIDENCE + """, p AS (SELECT doc_id, rule, signal, n, coalesce(sum(n) OVER (PARTITION BY doc_id, signal ORDER BY rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, rule, CASE WHEN n = 0 THEN 0 ELSE least(n, greatest(1, 3 - least(before, 3))) END::BIGINT AS n FROM p WHERE n > 0""")
def _(spark, d):
    return _evidence(spark, d).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("AGG_6_signals", None)
def _(spark, d):
    tiered = _evidence(spark, d).withColumn("tier", F.when(F.col("signal") == "licence", 1).when(F.col("signal") == "contact", 2).otherwise(3))
    return evidence.signals(evidence.keep_first_quotes(tiered, "doc_id"), "doc_id").select("doc_id", "signal", "n", "best_tier", "strength", "validated")


@query("AGG_8_factors", _EVIDENCE + "SELECT doc_id, CASE WHEN signal IN ('licence', 'copyright') THEN 'legal' ELSE 'data' END AS factor, count(DISTINCT signal) AS n_signals FROM e WHERE n > 0 GROUP BY ALL")
def _(spark, d):
    mapping = spark.createDataFrame([("licence", "legal"), ("copyright", "legal"), ("contact", "data"), ("number", "data")], ["signal", "factor"])
    return evidence.factors(_evidence(spark, d).select("doc_id", "signal").distinct(), "doc_id", mapping)


@query("AGG_17_validation", _EVIDENCE + "SELECT signal, count(DISTINCT source) AS n_sources, CASE WHEN count(DISTINCT source) >= 4 THEN 90 WHEN count(DISTINCT source) = 3 THEN 75 WHEN count(DISTINCT source) = 2 THEN 55 ELSE 30 END AS score FROM e WHERE n > 0 GROUP BY 1")
def _(spark, d):
    return _evidence(spark, d).groupBy("signal").agg(F.count_distinct("source").alias("n_sources")).withColumn("score", evidence.validation_score(F.col("n_sources")))


@query("AGG_23_worst_status", "SELECT user_id, CASE max(CASE WHEN event_type = 'error' THEN 3 WHEN value < 10 THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(evidence.worst(F.when(F.col("event_type") == "error", "FAIL").when(F.col("value") < 10, "WARN").otherwise("PASS")).alias("status"))


@query("GRD_8_forbidden_terms", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'apache') THEN 'Apache' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END], lambda x: x IS NOT NULL), ',') AS terms FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(evidence.forbidden_terms(F.col("text"), ["Apache", "license"]), ",").alias("terms"))


@query("JOIN_2_required_embeds", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no customer' WHEN c_acctbal < 0 THEN 'in debt' ELSE 'ok' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.when(F.col("c_custkey").isNull(), "no customer").when(F.col("c_acctbal") < 0, "in debt").otherwise("ok").alias("reason"))


@query("SET_2_union_minus", "SELECT id, src, rank FROM (SELECT id, src, row_number() OVER (ORDER BY src, id) AS rank FROM (SELECT c_custkey AS id, 0 AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT DISTINCT o_custkey, 1 FROM orders WHERE o_totalprice > 490000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000))) WHERE rank <= 500")
def _(spark, d):
    base = t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.lit(0).alias("src"))
    more = t(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("id")).distinct().join(base.select("id"), "id", "left_anti").select("id", F.lit(1).alias("src"))
    top = base.unionByName(more).orderBy("src", "id").limit(500)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("src", "id")))


@query("WIN_7_latest_completed", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SORT_4_nulls_last", "SELECT user_id, due, row_number() OVER (ORDER BY due ASC NULLS LAST, user_id) AS rank FROM (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS due FROM events GROUP BY 1) ORDER BY rank LIMIT 100")
def _(spark, d):
    due = t(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("due"))
    return due.orderBy(F.asc_nulls_last("due"), "user_id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("due"), "user_id")))


@query("TIME_9_warmup_curve", "SELECT event_id, floor(least(1.0, ((day(ts) - 1) / 30.0::DOUBLE)) * 50 + 0.5)::BIGINT AS sent FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.floor(F.least(F.lit(1.0), (F.dayofmonth("ts") - 1) / F.lit(30.0)) * 50 + 0.5).cast("long").alias("sent"))


# --- More text rules, leads, confidence -----------------------------------------------------------------------------------------
@query("TXT_12_name_gate", "WITH b AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, lower(p_type || ' ' || p_brand || ' ' || p_name) AS low FROM part), c AS (SELECT *, list_filter(w, lambda x: length(x) >= 4) AS s FROM b) SELECT p_partkey, len(s) > 0 AND len(list_filter(s, lambda x: contains(low, x))) >= CASE WHEN len(s) <= 2 THEN len(s) ELSE len(s) * 0.6 END AS mentions FROM c")
def _(spark, d):
    words = F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) >= 4)
    return t(spark, d, "part").select("p_partkey", X.mentions_name(words, F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("mentions"))


@query("CLS_12_statement_rejection", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), r AS (SELECT doc_id, CASE WHEN length(trim(l)) NOT BETWEEN 30 AND 280 THEN 'length' WHEN len(regexp_split_to_array(trim(l), '\\s+')) < 5 THEN 'words' ELSE 'kept' END AS reason FROM l WHERE NOT regexp_matches(l, '[^\\x00-\\x7F]') AND regexp_matches(l, '[a-z]')) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    lines = t(spark, d, "documents").select(F.explode_outer(F.split("text", "\n")).alias("l")).where(~F.col("l").rlike("[^\\x00-\\x7F]") & F.col("l").rlike("[a-z]"))
    return lines.groupBy(F.coalesce(X.statement_rejection(F.col("l")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# every line, of which CLS_12's SQL judges those in ASCII with a small letter; regex dialects differ on the others
@query("CLS_12_all_statements", None)
def _(spark, d):
    lines = t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy(F.coalesce(X.statement_rejection(F.col("l")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("AGG_27_leads", "WITH l AS (SELECT c_nationkey AS key, c_mktsegment AS segment, c_name AS name, CASE WHEN c_acctbal > 5000 THEN 0 WHEN c_acctbal > 0 THEN 1 ELSE 2 END AS rank, c_custkey AS pos FROM customer), f AS (SELECT key, segment, min(pos) AS seen FROM l GROUP BY ALL) SELECT key, arg_min(name, (rank, pos)) AS name, any_value(s.segments) AS segments FROM l JOIN (SELECT key, string_agg(segment, ',' ORDER BY seen) AS segments FROM f GROUP BY 1) s USING (key) GROUP BY 1")
def _(spark, d):
    rank = F.when(F.col("c_acctbal") > 5000, 0).when(F.col("c_acctbal") > 0, 1).otherwise(2)
    return entity.aggregate_leads(t(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), rank.alias("rank"), F.col("c_custkey").alias("pos")))


@query("JOIN_16_ambiguity", "WITH r AS (SELECT p_brand AS key, p_partkey AS candidate, p_size AS confidence FROM part), m AS (SELECT key, max(confidence) AS confidence FROM r GROUP BY 1) SELECT key, CASE WHEN count(*) = 1 THEN min(candidate) END AS candidate, confidence FROM r JOIN m USING (key, confidence) GROUP BY key, confidence")
def _(spark, d):
    return entity.ambiguous_tops(t(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("candidate"), F.col("p_size").alias("confidence")), "key")


@query("AGG_16_confidence", "SELECT o_custkey, floor(avg((o_orderpriority = '1-URGENT')::INT) * 30 + avg((o_totalprice > 100000)::INT) * 25 + least(1.0::DOUBLE, count(DISTINCT o_orderstatus) / 8.0::DOUBLE) * 25 + least(1.0::DOUBLE, count(DISTINCT o_orderpriority) / 4.0::DOUBLE) * 20 + 0.5::DOUBLE)::BIGINT AS confidence FROM orders GROUP BY 1")
def _(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("a"), F.avg((F.col("o_totalprice") > 100000).cast("int")).alias("b"), F.count_distinct("o_orderstatus").alias("c"), F.count_distinct("o_orderpriority").alias("e"))
    return g.select("o_custkey", scoring.evidence_confidence(F.col("a"), F.col("b"), F.col("c"), F.col("e")).cast("long").alias("confidence"))


@query("AGG_18_theme_priority", "SELECT user_id, (least(40, 10 * count(DISTINCT event_type)) + floor(least(100.0, max(value)) * 0.4 + 0.5) + CASE WHEN bool_or(event_type = 'purchase') THEN 20 ELSE 10 END)::BIGINT AS priority FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def _(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"), F.least(F.lit(100.0), F.max("value")).alias("top"), F.bool_or(F.col("event_type") == "purchase").alias("p")).where("n >= 2")
    return g.select("user_id", scoring.theme_priority(F.col("n"), F.col("top"), F.col("p")).cast("long").alias("priority"))
