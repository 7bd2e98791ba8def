"""Answers of models and vendors by hand: wrapped sections, wrong kinds, malformed JSON, ties of filings."""

import json

from pyspark.sql import functions as F

from granary.operators import responses as O


def test_sections(spark):
    raw = [
        {"PROFILE": {"a": 1, "b": "in"}, "company_profile": {"a": 2, "c": [1]}, "a": "out", "SIGNALS": [1], "d": None},
        {"SIGNALS": [1], "METADATA": "text", "x": True}, {"Scoring": {}, "y": 1.5}, [1], "text", None,
    ]
    rows = [(k, json.dumps(r) if r is not None else None, "v") for k, r in enumerate(raw)] + [(6, "{broken", "v"), (7, '{"a": 1, "a": 2}', "v"), (8, "", "v")]
    got = {}
    for r in O.fields(spark.createDataFrame(rows, "k long, raw string, value string"), "k", "raw").select("k", "name", O.kind_of(F.col("value")).alias("kind"), F.to_json("value").alias("j")).collect():
        got.setdefault(r.k, {})[r.name] = (r.kind, r.j)
    # the field outside counts before those of sections, and of these the later section's; a section that is a list goes beside one that isn't
    assert got == {0: {"a": ("string", '"out"'), "b": ("string", '"in"'), "c": ("array", "[1]"), "d": ("null", "null")}, 1: {"SIGNALS": ("array", "[1]"), "METADATA": ("string", '"text"'), "x": ("boolean", "true")}, 2: {"y": ("number", "1.5")}}


def test_profiles(spark):
    full = {"services": [" a ", "", 3, None, "b"], "market_positioning": " first ", "ideal_customers": 7, "business_outcomes": "no list"}
    rows = [(1, json.dumps(full)), (2, json.dumps({"services": [" "], "target_company_size": "  "})), (3, None), (4, "["), (5, json.dumps({"problems_solved": ["x"]}))]
    got = {r.k: r for r in O.profiles(spark.createDataFrame(rows, "k long, raw string"), "k", "raw").collect()}
    assert (got[1].services, got[1].market_positioning, got[1].ideal_customers, got[1].business_outcomes) == (["a", "b"], "first", "", [])
    assert {k: r.is_empty for k, r in got.items()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_contacts(spark):
    person = {"email": {"email": "a@x", "status": "Verified"}, "job_history": [{"title": "old", "current": False, "seniority": "s0"}, {"title": "new", "current": True, "seniority": "head", "departments": ["d"]}], "location": {"city": "A", "state": "", "country": "C"}}
    answers = [{"person": person, "company": {"industry": "steel"}}, {"error": True, "error_code": "NO_MATCH"}, {"error": True}, {"person": {"email": {"email": "b@x", "revealed": False}}}, {"person": {"email": {"email": "c@x"}}}, None, "broken"]
    rows = spark.createDataFrame([(k, a if a == "broken" else json.dumps(a) if a else None, "11-50" if k == 4 else None) for k, a in enumerate(answers)], "k int, raw string, size string")
    got = rows.select("k", O.contact_email(F.col("raw")).alias("m"), O.contact_details(F.col("raw"), F.col("size"), F.lit(None).cast("string")).alias("d")).orderBy("k").collect()
    assert [tuple(r.m) for r in got] == [("found", "a@x", "high"), ("not_found", None, "none"), ("error", None, "none"), ("not_found", None, "none"), ("found", "c@x", "medium"), ("error", None, "none"), ("error", None, "none")]
    assert tuple(got[0].d) == ("enriched", "d", "head", "A, C", "new", None, None, "steel", "high")
    assert [r.d.status for r in got] == ["enriched", "not_found", "not_found", "partial", "partial", "not_found", "not_found"] and got[4].d.company_size == "11-50"


def test_filings(spark):
    rows = [(1, "4", f"2024-{12 - k:02}", k) for k in range(7)] + [(1, "8-K", "2024-05", 7), (1, "S-1", "2024-04", 8), (2, "8-K", "2024-01", 0), (2, "8-K/A", "2024-01", 1), (2, None, "2024-02", 2)]
    got = [(r.k, r.form, r.place, r.nth) for r in O.ranked_filings(spark.createDataFrame(rows, "k int, form string, filed string, place int"), "k").orderBy("k", "nth").collect()]
    assert got == [(1, "8-K", 7, 1), *[(1, "4", k, k + 2) for k in range(7)], (2, "8-K", 0, 1), (2, "8-K/A", 1, 2), (2, None, 2, 3)]
