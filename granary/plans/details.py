"""Registered queries on the smaller rules, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import url as U
from granary.operators import events, evidence, history, scoring, web
from granary.plans.more import STRIP, chosen, listed, picked, q
from granary.plans.registry import HOST, REGISTRY, query, t

# --- Names, answers, values ----------------------------------------------------------------------------------------------------
_ENDINGS = [".com", ".co.in", "", "-tech.io", "_Works.ltd", "BigName.net"]


@query("TXT_23_domain_names", f"""WITH x AS (SELECT page_id, {HOST} || {picked("page_id", [f"'{x}'" for x in _ENDINGS])} AS d FROM pages), w AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(d, '\\.(com|co\\.in|in|net|org|io|biz|co|ltd)$', ''), '[_\\-]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS w FROM x)
SELECT page_id, upper(w[1]) || w[2:] AS name FROM w""")
def _(spark, d):
    domain = F.concat(U.host(F.col("url")), chosen(F.col("page_id"), [F.lit(x) for x in _ENDINGS]))
    return t(spark, d, "pages").select("page_id", X.name_from_domain(domain).alias("name"))


_ANSWERS = ["```json\n{\"a\": \"@\"}\n```", "Sure: {\"a\": 1} and {\"b\": 2} @", "```\n[1, 2] @\n``` ", "  @ {no end", "} @ {", "```JSON{\"x\": \"```\"}```"]


@query("TXT_24_answers", f"""WITH x AS (SELECT doc_id, replace({picked("doc_id", ["'" + q(x) + "'" for x in _ANSWERS])}, '@', text) AS r FROM documents),
s AS (SELECT doc_id, {STRIP(f"regexp_replace(regexp_replace({STRIP('r')}, '(?i)^```(?:json)?\\s*', ''), '\\s*```\\s*$', '')")} AS s FROM x),
p AS (SELECT *, strpos(s, '{{') AS a, CASE WHEN contains(s, '}}') THEN length(s) - strpos(reverse(s), '}}') + 1 ELSE 0 END AS b FROM s)
SELECT doc_id, md5(CASE WHEN a > 0 AND b > a THEN substr(s, a, b - a + 1) ELSE s END) AS json_md5 FROM p""")
def _(spark, d):
    raw = F.replace(chosen(F.col("doc_id"), [F.lit(x) for x in _ANSWERS]), F.lit("@"), F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(X.json_from_answer(raw).cast("binary")).alias("json_md5"))


_VALUES = ["'  ' || c_name || ' '", "'   '", "c_acctbal::VARCHAR || ' USD'", "'-' || c_custkey || 'e1x'", "NULL", "'.5 of it'", "'0.0'", "'x7'"]


@query("TXT_26_coercions", f"""WITH x AS (SELECT c_custkey, {picked("c_custkey", _VALUES)} AS v FROM customer), y AS (SELECT *, nullif(regexp_extract({STRIP('v')}, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?', 0), '')::DOUBLE AS n FROM x)
SELECT c_custkey, CASE WHEN v IS NULL OR {STRIP('v')} = '' THEN 'none' ELSE {STRIP('v')} END AS text, CASE WHEN n IS NULL OR n = 0 THEN -1.0 ELSE n END AS number FROM y""")
def _(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    v = chosen(key, [F.concat(F.lit("  "), name, F.lit(" ")), F.lit("   "), F.concat(F.col("c_acctbal").cast("string"), F.lit(" USD")), F.concat(F.lit("-"), key.cast("string"), F.lit("e1x")), F.lit(None).cast("string"), F.lit(".5 of it"), F.lit("0.0"), F.lit("x7")])
    return t(spark, d, "customer").select("c_custkey", X.text_or(v, "none").alias("text"), X.number_or(v, -1.0).alias("number"))


_PEOPLE = ["'Mary-Jane O''Neil'", "' ' || p_name", "'Dr. Ana de la Cruz'", "'X'", "'42'", "p_brand"]
_OPTIONS = ["low", "medium", "high"]


@query("TXT_29_mail_addresses", f"""WITH x AS (SELECT p_partkey, p_brand, {picked("p_partkey", _PEOPLE)} AS n FROM part), w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower({STRIP('n')}), '[^a-z\\s''-]', '', 'g'), '\\s+'), lambda v: v <> '') AS w FROM x),
h AS (SELECT *, list_reduce(list_transform(string_split(p_brand || p_partkey, ''), lambda c: ascii(c)::HUGEINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::HUGEINT)::BIGINT AS h FROM w)
SELECT p_partkey, CASE WHEN len(w) > 1 THEN w[1] || '.' || w[-1] WHEN len(w) = 1 THEN w[1] END || '@' || p_partkey || '.example' AS address, ([{listed(_OPTIONS)}])[1 + (floor(h / 4294967295.0 * 3)::BIGINT % 3)] AS picked FROM h""")
def _(spark, d):
    key = F.col("p_partkey")
    name = chosen(key, [F.lit("Mary-Jane O'Neil"), F.concat(F.lit(" "), "p_name"), F.lit("Dr. Ana de la Cruz"), F.lit("X"), F.lit("42"), F.col("p_brand")])
    seed = F.concat("p_brand", key.cast("string"))
    return t(spark, d, "part").select("p_partkey", F.concat(X.mail_local(name), F.lit("@"), key.cast("string"), F.lit(".example")).alias("address"), X.seeded_pick(seed, F.array(*[F.lit(x) for x in _OPTIONS])).alias("picked"))


# --- Probes, caches, replies ------------------------------------------------------------------------------------------------------
@query("SRC_12_corporate_probes", f"""WITH s AS (SELECT DISTINCT {HOST} AS site FROM pages), l AS (SELECT site, pos - 1 AS pos, 'https://' || site || ([{listed(U.CORPORATE_PATHS)}])[pos] AS url FROM s, generate_series(1, {len(U.CORPORATE_PATHS)}) g(pos)),
h AS (SELECT DISTINCT {HOST} AS site, 'https://' || {HOST} || '/investors' AS url FROM pages WHERE page_id % 2 = 0)
SELECT site, url, pos::INT AS pos FROM l ANTI JOIN h USING (site, url) QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos) <= 12""")
def _(spark, d):
    site = t(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("site"))
    have = site.where("page_id % 2 = 0").select("site", F.concat(F.lit("https://"), "site", F.lit("/investors")).alias("url")).distinct()
    return web.probes(site.select("site").distinct(), have, 12, U.CORPORATE_PATHS).select("site", "url", "pos")


@query("JOIN_18_cache_with_ttl", """WITH c AS (SELECT user_id AS url, ts AS t, value FROM events WHERE event_id % 3 = 0), l AS (SELECT url, max(t) AS t, arg_max(value, t) AS value FROM c GROUP BY url),
r AS (SELECT event_id AS id, user_id AS url, ts AS now FROM events WHERE event_id % 3 > 0), j AS (SELECT r.*, l.value, coalesce(epoch_us(now) // 1000 - epoch_us(t) // 1000 <= 24 * 3600000, false) AS is_hit FROM r LEFT JOIN l USING (url))
SELECT id, url, CASE WHEN is_hit THEN value END AS value, is_hit FROM j""")
def _(spark, d):
    e, i = t(spark, d, "events"), F.col("event_id")
    requests = e.where(i % 3 > 0).select(i.alias("id"), F.col("user_id").alias("url"), F.col("ts").alias("now"))
    return history.cache_hits(requests, e.where(i % 3 == 0).select(F.col("user_id").alias("url"), F.col("ts").alias("at"), "value"), 24)


_SENDERS = ["'Me <U' || conv_id || '@x.example>'", "role || '@y.example'", "'Mailer-Daemon@z.example'", "NULL", "'post <postmaster@z.example>'", "'friend@postmasters.example'"]
_SUBJECTS = ["'Re: hello'", "'Delivery Status Notification (Failure)'", "NULL", "text", "'failure notice'"]


@query("EXT_18_last_replies", f"""WITH m AS (SELECT conv_id, turn, 'm' || turn AS message_id, {picked("(turn + conv_id)", _SENDERS)} AS sender, {picked("(turn + conv_id // 2)", _SUBJECTS)} AS subject, 'u' || conv_id || '@X.example' AS connected FROM conversations),
r AS (SELECT conv_id, unnest(arg_max({{'message_id': message_id, 'sender': sender, 'subject': subject}}, (turn, message_id))) FROM m WHERE sender IS NOT NULL AND NOT contains(lower(sender), lower(connected)) GROUP BY conv_id)
SELECT conv_id, message_id, sender, coalesce(regexp_matches(sender, '(?i)\\b(mailer-daemon|postmaster)@'), false) OR coalesce(regexp_matches(subject, '(?i)\\b(delivery status notification|undelivered mail returned to sender|mail delivery failed|failure notice)\\b'), false) AS is_bounce FROM r""")
def _(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    sender = chosen(turn + conv, [F.concat(F.lit("Me <U"), conv.cast("string"), F.lit("@x.example>")), F.concat("role", F.lit("@y.example")), F.lit("Mailer-Daemon@z.example"), F.lit(None).cast("string"), F.lit("post <postmaster@z.example>"), F.lit("friend@postmasters.example")])
    subject = chosen(turn + F.floor(conv / 2).cast("long"), [F.lit("Re: hello"), F.lit("Delivery Status Notification (Failure)"), F.lit(None).cast("string"), F.col("text"), F.lit("failure notice")])
    rows = t(spark, d, "conversations").select("conv_id", turn.alias("place"), F.concat(F.lit("m"), turn.cast("string")).alias("message_id"), sender.alias("sender"), subject.alias("subject"), F.concat(F.lit("u"), conv.cast("string"), F.lit("@X.example")).alias("connected"))
    return events.last_reply(rows, "conv_id")


# --- Confidence, labels, gates ----------------------------------------------------------------------------------------------------
@query("AGG_4_market_confidence", f"SELECT company, statement_key, CASE WHEN mention_count >= 2 AND strong THEN 'high' WHEN mention_count >= 2 OR strong THEN 'medium' ELSE 'low' END AS confidence FROM ({REGISTRY['EXT_17_market_groups'][1]})")
def _(spark, d):
    found = REGISTRY["EXT_17_market_groups"][0](spark, d)
    n, strong = F.col("mention_count"), F.col("strong")
    return found.select("company", "statement_key", F.when((n >= 2) & strong, "high").when((n >= 2) | strong, "medium").otherwise("low").alias("confidence"))


@query("CLS_23_urgency_labels", f"SELECT doc_id, CASE WHEN score >= 8 THEN 'Contact immediately' WHEN score >= 5 THEN 'Contact this week' WHEN score >= 2 THEN 'Watch list' ELSE 'Deprioritize' END AS label FROM ({REGISTRY['AGG_15_effective_why_now'][1]})")
def _(spark, d):
    return REGISTRY["AGG_15_effective_why_now"][0](spark, d).select("doc_id", scoring.urgency_label(F.col("score")).alias("label"))


@query("AGG_26_gates", "SELECT user_id, event_type, CASE max(CASE WHEN value > 95 THEN 3 WHEN value > 80 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'PARTIAL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM events GROUP BY ALL")
def _(spark, d):
    v = F.col("value")
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(evidence.worst(F.when(v > 95, "FAIL").when(v > 80, "PARTIAL").when(v > 60, "WARN").otherwise("PASS")).alias("status"))
