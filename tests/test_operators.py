import math

import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import url as U
from granary.operators import content, entity, events, scoring, web
from granary.sources import leads


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


@pytest.mark.parametrize("path,expected", [("/about-us", "corporate"), ("/wire", "other"), ("/ir", "investor"), ("/ai/x", "technology"), ("/blog/one", "article"), ("/news/2024", "media"), ("/press/press-releases", "media"), ("/email", "other"), ("/dealer", "dealer")])
def test_category(spark, path, expected):
    assert value(spark, U.category(F.col("p")), p=path) == expected


def test_locales_and_rank(spark):
    paths = ["/de/a", "/de/b", "/de/c", "/nl/a", "/nl/b", "/ir/a", "/ir/b", "/ir/c", "/about-us", "/de/company"]
    pages = spark.createDataFrame([("https://www.x.com" + p,) for p in paths], ["url"])
    rows = {r.path: r for r in web.scored(pages).collect()}
    assert rows["/about-us"].score == 90 and rows["/de/company"].score == 50 and rows["/nl/a"].score == 30 and rows["/ir/a"].score == 100
    assert {r.site for r in rows.values()} == {"x.com"}
    assert [r.path for r in web.rank_pages(pages, 1).collect()] == ["/ir/a"]


def test_domain_like(spark):
    assert [value(spark, U.is_domain_like(F.col("x")), x=x) for x in ("tcs.com", "oil and gas", "SaaS")] == [True, False, False]


def test_names(spark):
    assert value(spark, X.name_key(F.col("x")), x="Möller, Inc.!!") == "möller"
    assert value(spark, X.ascii_name_key(F.col("x")), x="Möller") == "m ller"
    same = lambda a, b: value(spark, entity.same_company(F.col("a"), F.col("b")), a=a, b=b)
    assert same("Ador Welding Ltd.", "ador welding") and same("Ace Pipeline", "Acepipeline") and not same("Ace Hardware", "Ace Pipeline")


def test_fnv1a(spark):
    h = 2166136261
    for c in b"granary":
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    assert value(spark, X.fnv1a(F.col("x")), x="granary") == h


def test_text(spark):
    assert value(spark, X.reply_subject(F.col("x")), x="RE: hi") == "RE: hi" and value(spark, X.reply_subject(F.col("x")), x="hi") == "Re: hi"
    assert value(spark, X.local_part(F.col("x")), x="Ada B. Lovelace") == "ada.lovelace"
    assert value(spark, X.json_object(F.col("x")), x='so: ```{"a": {"b": 1}}``` end') == '{"a": {"b": 1}}'
    assert value(spark, X.sentences(F.col("x")), x="One two. Three! Four") == ["One two.", "Three!", "Four"]
    assert value(spark, X.stat_tokens(F.col("x")), x="up +40% in 3 days") == ["40%", "3 days"]
    assert value(spark, X.html_escape(F.col("x")), x="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"


def test_quotes(spark):
    text = "The plant in Pune makes heavy valves for water works and it will add two lines next year to meet demand"
    said = lambda q: value(spark, content.verify_quote(F.col("q"), F.col("c")), q=q, c=text)
    assert said("makes heavy valves") == "none"
    assert said("the plant in Pune  makes heavy valves for water works") == "exact"
    assert said("heavy valves for water works plant pune makes lines next year meet demand") == "close"
    assert said("completely different words that nobody here has ever written down at all") == "none"


def test_content_quality(spark):
    docs = spark.createDataFrame([(1, "We use cookies\nAccept cookies\nHome"), (2, "Our plant will expand production and automation with new digital lines"), (3, None)], "id int, text string")
    got = {r.id: r for r in content.content_quality(docs, "id").collect()}
    assert (got[1].flags, got[1].recommendation, got[1].score) == ("cookie_heavy,no_operational_content", "low_confidence", 20)
    assert got[2].score == 100 and got[2].recommendation == "proceed"
    assert got[3].score == 0 and got[3].recommendation == "low_confidence"


def test_market_category(spark):
    said = [value(spark, content.market_category(F.col("x")), x=x) for x in ("a trend of 8% CAGR", "a shortage of staff", "buyers are shifting toward rent", "it is in fashion")]
    assert said == ["growth_indicator", "challenge", "shift", "trend"]


def test_scores(spark):
    row = spark.createDataFrame([("medium", 12.0)], ["conf", "w"]).select(scoring.capped(F.lit(100), F.col("conf")).alias("a"), scoring.why_now(F.col("w"), F.col("conf")).alias("b"), scoring.priority(F.lit(82), F.lit(82), F.lit(10.0), F.col("conf")).alias("c"), scoring.score_label(F.lit(79)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (82, 10.0, 82, "Good")


def test_rate_limit(spark):
    times = [0, 10, 20, 59, 60, 61, 62]
    r = spark.createDataFrame([(1, float(t), i) for i, t in enumerate(times)], "key long, s double, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id")
    got = {x.event_id: (x.allowed, x.retry_s) for x in events.rate_limited(r, 2, 60).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 40), 3: (False, 1), 4: (True, None), 5: (True, None), 6: (False, 58)}


def test_streaks_and_due(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([1, 1, 1, 0, 1])], "k int, i int, h int")
    assert [r.streak for r in events.streaks(rows, "k", ["i"], F.col("h") == 1).orderBy("i").collect()] == [1, 2, 3, 0, 1]
    due = lambda s, days: value(spark, events.due_at(F.col("s"), F.lit("2024-01-01").cast("timestamp")) <= F.expr(f"timestamp'2024-01-01' + interval {days} days"), s=s)
    assert [due("sent", 2), due("sent", 3), due("followup_1", 3), due("followup_1", 4), due("followup_3", 99)] == [False, True, False, True, None]


def test_leader_clusters(spark):
    rows = [(0, "a.com", "Alpha Inc"), (1, None, "alpha"), (2, "b.com", "Alpha"), (3, "a.com", "Other name"), (4, None, "Beta Works"), (5, None, "betaworks"), (6, "b.com", "Gamma")]
    got = {r.pos: r.leader_pos for r in entity.leader_clusters(spark.createDataFrame(rows, "pos long, domain string, name string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}


def test_leads(spark):
    assert leads.resolve_headers(["Name", "Company Name", "LinkedIn URL", "Website"]) == {"person_linkedin": "LinkedIn URL", "company_website": "Website", "company_name": "Company Name", "person_name": "Name"}
    rows = spark.createDataFrame([(0, "Ada", "X Ltd "), (1, "Bob", " ")], ["pos", "Name", "Company"])
    good, bad = leads.project(rows)
    assert [r.company_name for r in good.collect()] == ["X Ltd"] and [r.warning for r in bad.collect()] == ["Row 3: no company name"]
    assert value(spark, leads.html_rows(F.col("x")), x="<table><tr><th>A</th><td><b>b</b></td></tr></table>") == [["A", "b"]]
    assert value(spark, leads.sitemap_urls(F.col("x")), x="<loc> http://a/b </loc><LOC>c</LOC>") == ["http://a/b", "c"]


def test_stream_matches_batch(spark, tmp_path):
    from granary.streaming import events as S

    r = spark.createDataFrame([(k, float(t), 10 * k + i) for k in (1, 2) for i, t in enumerate([0, 1, 2, 70, 71, 72])], "key long, t double, event_id long")
    r.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.rate_limited(spark.readStream.schema(r.schema).parquet(str(tmp_path / "in")), 2, 60).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {x.event_id: x.allowed for x in spark.sql("select * from limited").collect()}
    batch = {x.event_id: x.allowed for x in events.rate_limited(r.select("key", F.timestamp_seconds("t").alias("ts"), "event_id"), 2, 60).collect()}
    assert got == batch and len(got) == 12


def test_entry_and_registry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_evidence(spark):
    from granary.operators import evidence

    blob = "--- PAGE: /careers (https://x/careers) ---\nWe hire 1234 people. We hire more. hire hire\n--- PAGE: / (https://x/) ---\nhome"
    seg = evidence.segments(spark.createDataFrame([(1, blob), (2, "no marker")], "id int, content string"), "id").orderBy("id", "seg_no").collect()
    assert [(r.id, r.path, r.url) for r in seg] == [(1, "/careers", "https://x/careers"), (1, "/", "https://x/"), (2, "/", None)]
    rows = spark.createDataFrame([(1, seg[0].text), (2, None)], "id int, text string")
    got = evidence.extract(rows, ["id"], [("hiring", "hire"), ("hiring", "people"), ("number", "[0-9]+")]).orderBy("seq").collect()
    assert [(r.signal, r.rule, r.match) for r in got] == [("hiring", 0, "hire")] * 3 + [("hiring", 1, "people"), ("number", 2, "1234")]
    assert all(seg[0].text[r.pos : r.pos + len(r.match)] == r.match for r in got)
    worst = spark.createDataFrame([("PASS",), ("WARN",), ("PARTIAL",)], ["s"]).agg(evidence.worst(F.col("s")).alias("w")).first().w
    assert worst == "PARTIAL"


def test_rate_limit_batches(spark):
    r = spark.range(30_000).select((F.col("id") % 100 == 0).cast("long").alias("key"), F.timestamp_seconds(F.col("id") / 2).alias("ts"), F.col("id").alias("event_id"))
    limited = events.rate_limited(r, 2, 60)
    assert "collect_list" not in limited._jdf.queryExecution().toString()
    got = {x.event_id: (x.allowed, x.retry_s) for x in limited.collect()}
    state, expected = {}, {}
    for i in range(30_000):
        start, n = state.get(i % 100 == 0, (-1e18, 0))
        if i / 2 - start >= 60:
            start, n = i / 2, 0
        expected[i] = (n < 2, None if n < 2 else math.ceil(start + 60 - i / 2))
        state[i % 100 == 0] = (start, min(2, n + 1))
    assert got == expected


def test_leader_clusters_long_chain(spark):
    # a chain by domain and name in turn, in an order that takes labels many rounds
    names = ["".join(chr(97 + int(d)) for d in f"{i:05d}") for i in range(60)]
    links = [(f"d{i // 2}.com", names[(i + 1) // 2]) for i in range(60)]
    order = list(range(59, -1, -2)) + list(range(0, 60, 2))
    rows = [(pos, *links[i]) for pos, i in enumerate(order)]
    got = {r.pos: r.leader_pos for r in entity.leader_clusters(spark.createDataFrame(rows, "pos long, domain string, name string")).collect()}
    seen, expected = [], {}
    for pos, domain, name in rows:
        lead = next((p for p, d, _ in seen if d == domain), None)
        lead = next((p for p, _, n in seen if n == name), None) if lead is None else lead
        if lead is None:
            seen.append((pos, domain, name))
        expected[pos] = pos if lead is None else lead
    assert got == expected


def test_statements_of_all_languages(spark, tmp_path):
    import collections

    from granary.plans import queries

    lines = ["ALL CAPITALS ARE A HEADING AND NO STATEMENT", "Die Nachfrage wächst jedes Jahr um zehn Prozent", "short", "12345678 12345678 12345678 12345678 5678", "zusammengesetztewörter sind hier vereinigt", "a growing trend of 8% CAGR in this market"]
    docs = [(1, "\n".join(lines), "en"), (2, "There is a shortage of skilled staff in this market.", "fr"), (3, "There is a shortage of skilled staff in this market.", None), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def reason(line):
        letters = [c for c in line if c.isascii() and c.isalpha()]
        return "length" if not 30 <= len(line) <= 280 else "words" if len(line.split()) < 5 else "capitals" if len(letters) > 8 and "".join(letters).isupper() else "kept"

    expected = collections.Counter(reason(x) for _, text, _ in docs if text for x in text.split("\n"))
    got = {r.reason: r.n for r in queries()["CLS_12_all_statements"](spark, str(tmp_path)).collect()}
    assert got == expected and got["capitals"] == 1
    assert {2, 3} <= {r.doc_id for r in queries()["EXT_17_market_statements"](spark, str(tmp_path)).collect()}
