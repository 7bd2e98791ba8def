"""Registered queries on lead lists: merged companies, their flags and how rows came to their group, with SQL that goes row by row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import signal_rules as R
from granary.operators import companies
from granary.plans.more import chosen, picked, q
from granary.plans.registry import query, t

_FORMS = ["", " Ltd", " Inc.", " Pvt. Ltd."]
_LEADS = f"""r AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 11 = 0 THEN c_mktsegment || ' Works' WHEN c_custkey % 7 = 0 THEN 'A.' || c_nationkey || '. ' || lower(c_mktsegment) WHEN c_custkey % 29 = 0 THEN n_name || ' ' || n_name || ' ' || c_custkey
  WHEN c_custkey % 31 = 0 THEN n_name || ' of north east south west iron steel and ' || c_mktsegment ELSE n_name || ' ' || c_mktsegment || ' unit ' || c_custkey % 50 END || {picked("c_custkey", ["'" + x + "'" for x in _FORMS])} AS name,
  CASE WHEN c_custkey % 4 = 0 THEN 'https://www.' || c_custkey % 300 || '.example/home' WHEN c_custkey % 9 = 1 THEN 'not a site' END AS website, CASE WHEN c_custkey % 5 = 0 THEN 'in/' || c_custkey END AS linkedin,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_SHARED = "len(list_filter(k.words, lambda v: list_contains(x.words, v)))"
_MERGED = f"""WITH RECURSIVE {_LEADS},
b AS (SELECT *, CASE WHEN website LIKE 'http%' THEN regexp_extract(website, '//(?:www\\.)?([^/]*)', 1) END AS domain, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{q(R.LEGAL_FORMS)}', ' ', 'g'), '[^A-Za-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM r),
k AS (SELECT *, replace(k, ' ', '') AS s, string_split(k, ' ') AS words, row_number() OVER (ORDER BY pos) AS i FROM b),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::BIGINT AS leader_pos, NULL::VARCHAR AS tier, NULL::BIGINT AS other_pos, []::STRUCT(pos BIGINT, domain VARCHAR, k VARCHAR, s VARCHAR, words VARCHAR[])[] AS led
 UNION ALL SELECT i, pos, coalesce(d, e, f, pos), CASE WHEN d IS NOT NULL THEN 'domain' WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'squash' WHEN p IS NOT NULL THEN 'partial' ELSE 'none' END, CASE WHEN coalesce(d, e, f) IS NULL THEN p END,
 CASE WHEN coalesce(d, e, f) IS NULL THEN list_append(led, {{'pos': pos, 'domain': domain, 'k': k, 's': s, 'words': words}}) ELSE led END
 FROM (SELECT k.*, led, list_filter(led, lambda x: x.domain = k.domain)[1].pos AS d, list_filter(led, lambda x: x.k = k.k)[1].pos AS e, CASE WHEN length(k.s) >= {companies.SQUASHED} THEN list_filter(led, lambda x: x.s = k.s)[1].pos END AS f,
   list_filter(led, lambda x: 2 * {_SHARED} >= greatest(len(k.words), len(x.words)))[1].pos AS p FROM g JOIN k ON k.i = g.i + 1)),
m AS (SELECT pos, leader_pos, tier, other_pos FROM g WHERE i > 0)"""


def _rows(spark, d):
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key, text = F.col("c_custkey"), lambda x: F.col(x).cast("string")
    space = F.lit(" ")
    name = (F.when(key % 11 == 0, F.concat("c_mktsegment", F.lit(" Works"))).when(key % 7 == 0, F.concat(F.lit("A."), text("c_nationkey"), F.lit(". "), F.lower("c_mktsegment")))
            .when(key % 29 == 0, F.concat("n_name", space, "n_name", space, text("c_custkey"))).when(key % 31 == 0, F.concat("n_name", F.lit(" of north east south west iron steel and "), "c_mktsegment"))
            .otherwise(F.concat("n_name", space, "c_mktsegment", F.lit(" unit "), (key % 50).cast("string"))))
    website = F.when(key % 4 == 0, F.concat(F.lit("https://www."), (key % 300).cast("string"), F.lit(".example/home"))).when(key % 9 == 1, "not a site")
    return c.select(key.alias("pos"), F.concat(name, chosen(key, [F.lit(x) for x in _FORMS])).alias("name"), website.alias("website"), F.when(key % 5 == 0, F.concat(F.lit("in/"), text("c_custkey"))).alias("linkedin"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("industry"), F.when(key % 3 == 0, F.col("n_name")).alias("country"))


@query("JOIN_6_lead_tiers", _MERGED + " SELECT pos, leader_pos, tier FROM m")
def _(spark, d):
    return companies.resolve(_rows(spark, d))[0]


_FILL = ", ".join(f"arg_min({c}, pos) FILTER ({c} IS NOT NULL) AS {c}" for c in companies.FILLED)


@query("AGG_29_companies", _MERGED + f""", c AS (SELECT leader_pos, arg_min(name, pos) AS name, {_FILL}, count(*) AS n_contacts FROM m JOIN r USING (pos) GROUP BY 1)
SELECT c.*, (SELECT count(*) FROM m WHERE m.pos = c.leader_pos AND other_pos IS NOT NULL) AS flags, (SELECT count(*) FROM m WHERE other_pos = c.leader_pos) AS flagged_by FROM c""")
def _(spark, d):
    return companies.resolve(_rows(spark, d))[1]


@query("AGG_29_possible_duplicates", _MERGED + """, f AS (SELECT pos, other_pos, -1 AS place FROM m WHERE other_pos IS NOT NULL UNION ALL SELECT other_pos, pos, pos FROM m WHERE other_pos IS NOT NULL)
SELECT f.pos, other_pos, name AS other_name, row_number() OVER (PARTITION BY f.pos ORDER BY place) AS nth FROM f JOIN r ON r.pos = other_pos""")
def _(spark, d):
    flags = companies.resolve(_rows(spark, d))[2]
    return flags.select("pos", "other_pos", "other_name", F.row_number().over(Window.partitionBy("pos").orderBy("place")).alias("nth"))
