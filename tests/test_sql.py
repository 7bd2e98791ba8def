"""Registered queries of every family against their SQL in DuckDB on the smallest tables (the driver compares all)."""

import os

import pytest

from granary.plans import changes, columns, companies, grounded, lists, more, registry, responses, segments, signals, synthesis

NEW = ["URL_1_normalised", "URL_12_consumer_sites", "CLS_13_competitor_rejection", "CLS_6_source_types", "AGG_24_evaluation", "GRD_1_quote_tiers", "TIME_5_cooldown", "EXT_13_listed_names", "JOIN_8_grounded_people", "JOIN_10_tickers", "AGG_21_research_audit", "SRC_7_projected_leads", "CLS_1_page_types", "AGG_7_subject_floor", "AGG_8_rule_pack_factors", "EXT_7_profile_flags", "EXT_10_service_needs", "GRD_3_grounded_claims", "GRD_9_best_proofs"]
NEW += ["AGG_29_companies", "AGG_29_possible_duplicates", "EXT_1_segments", "EXT_6_leaders", "AGG_13_cluster_table", "AGG_18_theme_table", "GRD_4_opportunities", "AGG_9_derived_factors", "GRD_12_brief_bullets", "SNK_2_history", "SRC_8_sitemap_pages", "TIME_2_transitions", "TIME_8_arrivals", "EXT_11_offerings", "EXT_16_segment_lists", "EXT_17_market_groups", "SRC_2_numbered_rows", "TXT_25_flat_fields", "UDF_4_business_profiles", "GRD_14_contact_details", "SRC_15_filings", "AGG_21_four_kinds", "AGG_15_effective_why_now", "CLS_1_url_types"]
NEW += ["SORT_9_best_two", "SORT_9_best_two_of_all"]


def test_every_new_query_has_sql():
    assert all(sql for f, sql in registry.REGISTRY.values() if f.__module__ in [m.__name__ for m in (changes, columns, companies, grounded, lists, more, responses, segments, signals, synthesis)])


@pytest.fixture(scope="module")
def tables(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, small, tables, name):
    query, sql = registry.REGISTRY[name]
    got = query(spark, small)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want) and want
