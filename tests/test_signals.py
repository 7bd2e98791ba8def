"""The signal rule pack against plain Python and by hand, odd rows included."""

import regex
from pyspark.sql import functions as F

from granary.functions import signal_rules as R
from granary.operators import grounding, services, signals

SEGMENTS = "company string, seg_no int, url string, path string, text string, name string, is_vendor boolean"


def plain_evidence(rows):
    """Rule by rule with a counter of signal and url, as the rules say it."""
    out, taken = [], {}
    for company, seg_no, url, path, text, name, vendor in sorted(rows, key=lambda r: (r[0], r[1])):
        for number, (signal, pattern, anti) in enumerate(R.PATTERNS):
            for m in regex.finditer(pattern, text or "", regex.I | regex.A):
                quote = regex.sub(r"\s+", " ", text[max(0, m.start() - 90) : m.end() + 90], flags=regex.A).strip(" ")[:250]
                if anti and regex.search(anti, quote, regex.I | regex.A):
                    continue
                out.append((company, seg_no, number, m.start(), quote))
                taken[company, signal, url] = taken.get((company, signal, url), 0) + 1
                if taken[company, signal, url] >= 3:
                    break
    return sorted(out)


def test_shared_cap_and_anti_patterns(spark):
    many = "A new plant. A new campus! A new hub? A new factory; opening a plant. Expanding globally. " * 3
    rows = [
        ("a", 0, "u", "/about", many, "Acme Works", False), ("a", 1, "u", "/about", many, "Acme Works", False), ("a", 2, "v", "/", many, "Acme Works", False),
        ("b", 0, "u", None, "entering the capital market now", None, None), ("b", 1, "u", "", "", None, None), ("b", 2, "u", "/x", None, None, None),
        ("c", 0, "u", "/x", "émès MES éMES x " + "y" * 5000 + " smart factory", "C", True), ("c", 0, "u", "/x", "smart factory", "C", True)]
    got = signals.evidence(spark.createDataFrame(rows, SEGMENTS).withColumn("signal", F.lit("clash")).withColumn("rule", F.lit(1)), "company")
    own = [tuple(r) for r in got.where("company <> 'c'").select("company", "seg_no", "rule", "pos", "quote").collect()]
    assert sorted(own) == plain_evidence(rows[:6]) and len(own) > 10
    assert got.where("company = 'c'").groupBy("signal").count().orderBy("signal").collect()[0][1] >= 2
    assert signals.evidence(spark.createDataFrame([], SEGMENTS), "company").count() == 0


def test_subjects(spark):
    cases = [
        ("Our customers can save", "about", "Acme Works", False, "customer_use_case"), ("read the case study", "careers", None, False, "partner_story"), ("anything", "careers", None, None, "company_operations"),
        ("new welding lines", "about", None, True, "company_strategy"), ("for your welding lines", "about", None, True, "generic_marketing"), ("we build pumps", "homepage", None, False, "company_operations"),
        ("Acme runs two plants", "products", "Acme Works Ltd", False, "company_strategy"), ("Acmes runs two plants", "products", "Acme Works Ltd", False, "generic_marketing"), ("Global runs two plants", "other", "Global Works", False, "generic_marketing"),
        ("École+ opens", "other", "École+", False, "company_strategy"), ("the market is growing", "other", None, False, "industry_trend"), ("the market is growing", "homepage", None, False, "generic_marketing"), ("", "other", "", False, "generic_marketing")]
    rows = spark.createDataFrame([c[:4] for c in cases], "quote string, page_type string, name string, is_vendor boolean")
    assert [r["subject"] for r in signals.with_subject(rows).collect()] == [c[4] for c in cases]


def test_floor_only_without_own_quotes(spark):
    rows = [("a", s, 0, i, 0, f"q{i}", tier, subject) for i, (s, tier, subject) in enumerate([("x", 3, "industry_trend"), ("x", 2, "industry_trend"), ("x", 1, "industry_trend"), ("y", 1, "customer_use_case")])]
    rows += [("b", "x", 0, 0, 0, "q", 1, "industry_trend"), ("b", "y", 0, 1, 0, "r", 2, "internal_technology")]
    got = signals.signals(spark.createDataFrame(rows, "company string, signal string, seg_no int, rule int, pos int, quote string, tier int, subject string"), "company")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", "weak", 2, False, False, 2, "q1"), ("b", "y", "moderate", 1, False, True, 2, "r")]


def test_profile_context_and_null(spark):
    texts = ["consumer goods", "consumer goods and forging", "a food bank", "the bank", "we manufacture welding equipment", None, ""]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(signals.profile(F.col("t")).alias("p")).select("p.primary_type").collect()
    assert [r[0] for r in got] == ["retailer", "unknown", "unknown", "financial_institution", "industrial_vendor_manufacturer", "unknown", "unknown"]


def test_needs_masks_and_claims(spark):
    row = spark.createDataFrame([(None, None)], "t string, n int").select(services.needs(F.col("t"), F.lit(False), F.lit(True), F.col("n"), F.col("n"), F.lit(False)).alias("x")).first()[0]
    assert len(row) == 8 and {(x["threshold"], x["disqualified"]) for x in row} == {("none", False)}
    masked = spark.range(1).select(services.meaningful(F.array(F.lit("growth_signal"), F.lit("automation_keywords")), F.lit("Software/SaaS")).alias("x"), services.meaningful(F.array(F.lit("automation_keywords")), F.lit(None).cast("string")).alias("y")).first()
    assert masked["x"] == ["growth_signal"] and masked["y"] == ["automation_keywords"]
    said = "the plant lost a third of its orders in one year"
    claims = [("a", "observed", "high", said, "We know that " + said, False), ("b", "observed", "high", said, "Nothing of that kind", False), ("c", "inferred", "odd", None, None, False), ("d", "observed", "low", None, None, None), ("", "inferred", "low", None, None, False), ("e", "inferred", "low", None, None, True)]
    kept = grounding.grounded_claims(spark.createDataFrame(claims, "title string, claim_type string, confidence string, evidence string, content string, is_thin boolean")).select("title", "confidence").collect()
    assert [tuple(r) for r in kept] == [("a", "high"), ("c", "low")]


def test_site_identity(spark):
    far = " x" * 100 + " "
    cases = [
        (["acme", "works"], "ACME Works Inc", None, None, "high"), (["acme"], "home", "acme", "acme", "none"), (["acme", "works"], "acmes works", None, None, "medium"), (["acme", "works"], None, "works by acme", "", "medium"),
        (["acme", "works"], "", None, "acme" + far + "works", "none"), (["acme", "works"], "", None, "acme" + far + "works of Acme", "medium"), (["a.b", "works"], "", None, "aXb works", "none"), ([], "acme", None, None, "none"), (["acme", "works"], None, None, None, "none")]
    rows = spark.createDataFrame([c[:4] for c in cases], "w array<string>, title string, description string, body string")
    got = rows.select(grounding.site_identity(F.col("w"), F.col("title"), F.col("description"), F.col("body")).alias("x")).collect()
    assert [r["x"] for r in got] == [c[4] for c in cases]


def test_literals_of_patterns():
    """Every match of a pattern holds one of its literals."""
    from granary.functions import literals as L
    from granary.functions import signal_rules as R

    assert L.required(r"\b(?:new|brand\s+new)\s+(?:plant|campus)s?\b") == {"plant", "campus"} and L.required(r"a{2}b?|x") is None and L.required(r"(?:abc)?d*") is None
    assert L.required(r"(?:ABC|de+fgh)+") is None or min(map(len, L.required(r"(?:ABC|de+fgh)+"))) >= L.LEAST
    texts = list(plans_said()) + ["Our SMART   Factory runs an IIoT platform; the MES and a new campus", "capacity expansion of 25% in three years"]
    tried = 0
    for _, pattern, _ in R.PATTERNS:
        for text in texts:
            if regex.search(pattern, text, regex.I | regex.A):
                tried += 1
                assert L.required(pattern) is None or any(x in text.lower() for x in L.required(pattern)), (pattern, text)
    assert tried > 30


def plans_said():
    from granary.plans import signals as plans

    return plans._SAID


def test_patterns_met_are_those_that_a_search_finds(spark):
    from granary.functions import literals as L

    patterns = [p for _, p, _ in R.PATTERNS] + [p for _, some in R.PROFILE for p in some] + list(services.NEEDED)
    parts = ["new plant", "new  PLANT", "newplant", "multi-plant", "digitally digital twin", "the COO said", "mes", "Mes and SAP (MM)", "our operations platform works well", "Kelvin capacity expansion İndia", "", "data bank", "bank\n", "AI-powered ai", "\U0001f600 industry 4.0"]
    texts = [a + " " + b for a in parts for b in parts] + [" ".join(parts * 9), "site plant new " * 60 + "capacity expansion", None]
    assert not L.Finder(patterns).always or all(L.required(patterns[i]) is None for i in L.Finder(patterns).always)
    # alternatives with the same beginning need whole words, not what is left of them
    assert L.required(r"\b(?:coo|cto|chief\s+officer)\b") == {"coo", "cto", "officer"} and L.Finder(patterns[:131]).always == []
    got = {r.i: r.met for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.patterns_met(F.col("t"), patterns).alias("met")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [k for k, p in enumerate(patterns) if text and regex.search(p, text, regex.I | regex.A)], text
