"""Clusters, themes, opportunities and factors by hand on small tables with ties, nulls and repeated rows."""

from granary.operators import proposals as P
from granary.operators import synthesis as Y

PROFILE = "k long, manufacturer boolean, industrial_vendor boolean, software_saas boolean, services_provider boolean, conglomerate boolean, logistics_operator boolean, n_plants int, n_countries int"


def test_clusters(spark):
    factors = spark.createDataFrame([(1, "multi_location_operations"), (1, "multi_location_operations"), (1, "growth_signal"), (1, None), (2, "growth_signal"), (3, "ai_mention"), (4, "recent_news_or_event"), (5, "technology_investment")], "k long, factor string")
    profiles = spark.createDataFrame([(1, True, None, False, False, False, False, 5, None), (2, False, False, True, False, False, False, None, None), (3, True, False, True, False, False, False, 9, 9), (4, None, None, None, None, None, None, None, None), (5, True, False, False, False, False, False, 0, 0)], PROFILE)
    got = {}
    for r in Y.clusters(spark, factors, profiles, "k").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.cluster, r.tier, r.confidence, r.signals))
    sites = ["multi_location_operations", "growth_signal"]
    assert sorted(got[1]) == sorted([("multi_site_coordination", 2, "high", sites), ("dealer_distribution_network", 2, "high", sites[::-1]), ("scale_and_capacity", 2, "low", ["growth_signal"]), ("automotive_after_sales", 2, "high", sites[::-1]), ("supply_chain_growth", 3, "medium", ["growth_signal"])])
    assert [c for c, *_ in got[1]][-1] == "supply_chain_growth" and [x[2] for x in got[1]][:3] == ["high"] * 3
    assert got[2] == [("saas_customer_operations", 1, "low", ["growth_signal"])]
    assert {c for c, *_ in got[3]} == {"industrial_ai", "saas_product_intelligence"} and got[4] == [("business_event_momentum", 3, "medium", ["recent_news_or_event"])]
    # a further factor alone makes no cluster
    assert {c for c, *_ in got[5]} == {"technology_integration"}
    assert Y.clusters(spark, factors.limit(0), profiles, "k").count() == 0


def test_themes(spark):
    rows = [(1, "ai_mention", s, n, f"q{n}") for n, s in enumerate(["press", "press", "blog", "about", "careers", "other"])] + [(1, "hiring_signal", "press", 9, "q0"), (1, "hiring_signal", None, 1, "no source"), (2, "ai_mention", "press", 1, "alone"), (1, None, "press", 0, "x"), (3, "recent_news_or_event", "a", 1, None), (3, "capacity_expansion", "a", 2, "y" * 300)]
    quotes = Y.first_quotes(spark.createDataFrame(rows, "k long, signal string, source string, n int, quote string"), "k", ["n"])
    valid = {(r.k, r.signal): (r.n_sources, r.score, r.level, r.sources) for r in Y.validated(quotes, "k").collect()}
    assert valid[1, "ai_mention"] == (5, 90, "very_high", ["press", "blog", "about", "careers", "other"]) and valid[1, "hiring_signal"] == (1, 30, "low", ["press"])
    got = {(r.k, r.theme): r for r in Y.themes(spark, quotes, "k").collect()}
    assert set(got) == {(1, "ai_digital_strategy"), (1, "talent_technology_buildout"), (3, "enterprise_scaling"), (3, "strategic_event_response")}
    one = got[1, "ai_digital_strategy"]
    # 20 for two signals, 36 for the best score, 20 as it is very high; five sources of which four are shown, and one quote twice
    assert (one.signals, one.confidence, one.priority, one.score, one.place, one.quotes) == (["ai_mention", "hiring_signal"], "very_high", "critical", 76, 1, ["q0", "q2", "q3", "q4"])
    three = got[3, "enterprise_scaling"]
    assert (three.signals, three.priority, three.score, three.quotes) == (["capacity_expansion", "recent_news_or_event"], "secondary", 32, ["y" * 200, ""])


def test_opportunities(spark):
    said = "the plant in the north will run a new press line for heavy parts from next year on"
    companies = spark.createDataFrame([(1, f"Here {said}.", False), (2, said, True), (3, None, None)], "k long, content string, is_thin boolean")
    catalogue = spark.createDataFrame([(1, 0, "Press monitoring", "c0", "cat", "High"), (1, 1, "Energy reports", "c1", "cat", "Low"), (1, 2, "Press planning", "c2", "cat", "Low"), (2, 0, "Press", "c", "cat", "High")], "k long, place int, title string, challenge string, category string, relevance string")
    known = P.SERVICES[0]
    offers = [
        (1, 0, "Nothing shared", "d", known, "observed", said, None), (1, 1, "A press, watched", "told", "none", "observed", None, None), (1, 2, "Press again", "late", known, "observed", said, None),
        (1, 3, "Unsure", "d", known, "inferred", None, "  fifteen letters "), (1, 4, "Unsure too", "d", known, "inferred", None, "short"), (1, 5, "Made up", "d", known, "observed", "this sentence is nowhere to be found in any of the texts", None),
        (1, 6, "Other trade", "d", "Roofing", "inferred", None, "a long and good reason"), (2, 0, "Press", "d", known, "observed", said, None), (3, 0, None, None, known, "inferred", None, "a long and good reason")]
    got = P.opportunities(catalogue, spark.createDataFrame(offers, "k long, place int, title string, description string, service_line string, claim_type string, evidence string, inferred_from string"), companies, "k")
    assert sorted((r.k, r.path, r.place, r.description or "", r.relevance, -1 if r.proposal is None else r.proposal) for r in got.collect()) == [
        (1, "catalogue", 0, "told", "High", 1), (1, "catalogue", 1, "c1", "Low", -1), (1, "catalogue", 2, "told", "Low", 1), (1, "inferred", 3, "d", "Low", 3), (1, "verified", 0, "d", "Medium", 0), (1, "verified", 2, "late", "Medium", 2), (3, "inferred", 0, "", "Low", 0)]


def test_factors(spark):
    signals = spark.createDataFrame([(1, "digital", 2, "MES", "a new"), (1, "growth", 1, None, "plain"), (1, "business", 1, "x", "plant of robots"), (2, "hiring", 1, None, None)], "k long, kind string, place int, type string, evidence string")
    evidence = spark.createDataFrame([(1, "Automation", None, "company_strategy"), (1, "hiring", None, "industry_trend"), (3, None, "an iiot line", None)], "k long, category string, quote string, subject string")
    given = spark.createDataFrame([(1, "growth_signal"), (4, "ai_mention"), (4, None)], "k long, factor string")
    got = {(r.k, r.factor): r.by_pass for r in P.derived_factors(signals, evidence, given, "k").collect()}
    # "plant" follows on "a new mes", so no several sites; robots only come up in the last pass, after evidence of automation
    assert got == {(1, "growth_signal"): 0, (1, "digital_transformation"): 1, (1, "industry_40_initiative"): 1, (1, "technology_investment"): 1, (1, "automation_keywords"): 2, (2, "hiring_signal"): 1, (3, "digital_transformation"): 2, (3, "industry_40_initiative"): 2, (4, "ai_mention"): 0}
