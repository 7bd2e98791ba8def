"""Summaries, bullets and pages of a brief by hand; proofs and tickers with ties and shared words."""

from granary.operators import brief as B
from granary.operators import grounding, services
from pyspark.sql import functions as F


def test_summaries(spark):
    profiles = spark.createDataFrame([(1, ["manufacturer", "retailer"], "manufacturer"), (2, [], "unknown")], "k int, types array<string>, primary_type string")
    signals = spark.createDataFrame([(1, n, f"s{n}", "weak", ("x" * 130 if n == 0 else None if n == 1 else "q")) for n in range(14)], "k int, place int, signal string, strength string, best_quote string")
    factors = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "k int, factor string")
    drafts = spark.createDataFrame([(1, 2, "late", "Low", "low"), (1, 1, "first", "High", "high")], "k int, place int, service string, fit string, confidence string")
    got = {r.k: r.summary for r in B.summaries(profiles, signals, factors, drafts, "k").collect()}
    lines = ["COMPANY PROFILE: manufacturer, retailer | primary: manufacturer", "", "SIGNALS (14):", f'  [weak] s0 — "{"x" * 120}…"', '  [weak] s1 — ""', *[f'  [weak] s{n} — "q"' for n in range(2, 12)], "", "FACTORS: a, b", "", "OPPORTUNITY CANDIDATES:", "  first [fit:High | confidence:high]", "  late [fit:Low | confidence:low]"]
    assert got == {1: "\n".join(lines), 2: "COMPANY PROFILE: unknown | primary: unknown"}


def test_bullets_and_pages(spark, tmp_path):
    companies = spark.createDataFrame([(1, "A & B"), (2, "None <x>")], "k int, name string")
    themes = spark.createDataFrame([(1, 1, "very sure", "very_high", ["sig"]), (1, 2, "Supply chain", "high", ["s"]), (1, 3, "odd", "low", ["sig", "t"]), (1, 4, "odder", "low", [])], "k int, place int, theme string, confidence string, signals array<string>")
    signals = spark.createDataFrame([(1, 1, "a", "q" * 111, True), (1, 2, "b", "not own", False), (1, 3, "c", None, True), (1, 4, "d", "third", True)], "k int, place int, signal string, best_quote string, is_own boolean")
    rows = B.bullets(companies, themes, signals, "k", "us")
    got = {r.k: r.observed for r in rows.collect()}
    # "Supply chain" holds "ai", which comes before the supply chain's own entry
    assert got[1][0].startswith("A & B shows active Supply chain — us delivers AI Strategy & Deployment: ") and got[1][1:3] == ["A & B has confirmed sig activity — us can accelerate with targeted AI/automation solutions.", "A & B has confirmed odder activity — us can accelerate with targeted AI/automation solutions."]
    assert got[1][3:] == [f'Evidence: "{"q" * 107}…"', 'Evidence: ""'] and got[2] == []
    B.write_pages(rows.join(companies, "k").select("name", B.page(F.col("name"), F.col("observed"), F.lit("x > y")).alias("html")), str(tmp_path / "p"))
    pages = {r.file: r.html for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert set(pages) == {"a-b.html", "none-x.html"} and "<h1>None &lt;x&gt;</h1>" in pages["none-x.html"] and "<ul></ul>" in pages["none-x.html"] and pages["a-b.html"].count("<li>") == 5


def test_proofs_by_sets_of_tags(spark):
    companies = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "a"]), (3, ["z"]), (4, None)], "k int, tags array<string>")
    proofs = spark.createDataFrame([("p", ["a"], 1, 1), ("q", ["a", "b"], 2, 2), ("r", ["b"], 0, 3), ("s", ["b", "b"], 0, 4)], "proof string, tags array<string>, provenance int, place int")
    got = sorted((r.k, r["rank"], r.proof, r.score) for r in services.best_proofs(companies, proofs, "k").collect())
    assert got == [(k, *x) for k in (1, 2) for x in ((1, "q", 2), (2, "r", 1))]


def test_tickers_by_the_rarest_word(spark):
    names = spark.createDataFrame([(1, "Acme Steel"), (2, "steel works"), (3, "global steel works"), (4, "unknown words here"), (5, "Steel"), (6, "acme acme steel")], "id int, name string")
    tickers = spark.createDataFrame([(1, "AS", "acme steel company"), (2, "GSW", "global steel works of north east"), (3, "S1", "steel one"), (4, "SWN", "steel works north")], "pos int, ticker string, title string")
    got = {r.id: r.ticker for r in grounding.match_tickers(names, tickers).collect()}
    assert got[1] == "AS" and got[3] == "GSW" and got[4] is None and got[5] is None
