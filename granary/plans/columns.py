"""Class tests on the tables' own columns, whole and as they stand, beside the queries that read fixed cases; with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import guards as G
from granary.functions import sourcing as S
from granary.functions import text as X
from granary.functions import url as U
from granary.operators import content
from granary.plans.more import STRIP, cases, q
from granary.plans.registry import REGISTRY, query, t

_PATH = "regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*([^?#]*)', 1)"


@query("CLS_1_url_types", f"""WITH x AS (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path FROM pages), k AS (SELECT page_id, path, CASE WHEN path IS NULL THEN 'homepage' {" ".join(f"WHEN regexp_matches(lower(path), '{q(x)}') THEN '{n}'" for n, x in U.PAGE_TYPES)} ELSE 'other' END AS kind FROM x)
SELECT page_id, kind, CASE WHEN kind IN ('careers', 'investor', 'annual_report', 'press') THEN 1 WHEN kind IN ('about', 'blog') THEN 2 ELSE 3 END AS tier, CASE WHEN regexp_matches(lower(coalesce(path, '')), '{q(S.TIER1_PAGES)}') THEN 'tier1' WHEN regexp_matches(lower(coalesce(path, '')), '{q(S.TIER2_PAGES)}') THEN 'tier2' ELSE 'tier3' END AS page_tier FROM k""")
def _(spark, d):
    k = t(spark, d, "pages").select("page_id", U.path(F.col("url")).alias("path")).withColumn("kind", U.page_type(F.col("path")))
    return k.select("page_id", "kind", U.tier(F.col("kind")).alias("tier"), S.page_tier(F.col("path")).alias("page_tier"))


@query("CLS_8_document_models", "WITH x AS (SELECT doc_id, trim(lower(text)) AS m FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(m, '{q(p)}') THEN '{n}'" for n, p in S.BUSINESS_MODELS) + " ELSE 'Other' END AS model FROM x")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", S.business_model(F.col("text")).alias("model"))


@query("CLS_18_event_messages", f"SELECT event_id, list_filter([event_type, props], lambda x: regexp_matches(x, '(?i){q('|'.join(G.QUOTA_SIGNATURES))}'))[1] AS signature, regexp_matches(props, '\\b429\\b') OR regexp_matches(props, '(?i)rate.?limit') AS limited, length(trim(props)) >= 10 AND contains(props, '{{') AND contains(props, '}}') AS json FROM events")
def _(spark, d):
    props = F.col("props")
    return t(spark, d, "events").select("event_id", G.quota_signature(F.array("event_type", "props")).alias("signature"), S.is_rate_limit(props).alias("limited"), S.is_json_like(props).alias("json"))


@query("TXT_32_role_levels", f"WITH x AS (SELECT conv_id, turn, {STRIP('lower(role)')} AS title, lower(text) AS said FROM conversations) SELECT conv_id, turn, {cases('title', X.SENIORITY, chr(39) + 'Manager' + chr(39))} AS level, {cases('said', X.SENIORITY, chr(39) + 'Manager' + chr(39))} AS said_level FROM x")
def _(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", X.seniority(F.col("role")).alias("level"), X.seniority(F.col("text")).alias("said_level"))


_TIERS = REGISTRY["GRD_1_quote_tiers"][1]


@query("GRD_2_gated_quotes", f"SELECT item_id, doc_id, tier = 'exact' AS exact, tier IN ('exact', 'close') AS close FROM ({_TIERS})")
def _(spark, d):
    found = REGISTRY["GRD_1_quote_tiers"][0](spark, d)
    return found.select("item_id", "doc_id", content.is_grounded(F.col("tier"), "exact").alias("exact"), content.is_grounded(F.col("tier")).alias("close"))
