"""Joins on common keys make no more rows than their inputs have, and what comes out is as before."""

from granary.operators import grounding, services
from granary.plans import more, registry  # noqa: F401

N = 300


def most_rows(df):
    """The result, and the rows that the largest step of its plan put out."""
    rows = df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        own = plan.metrics().get("numOutputRows")
        kids = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *map(walk, kids)])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_people_of_one_company_with_one_name(spark):
    people = spark.createDataFrame([(i, "a", "Blue Ring" if i % 2 else "blue ring x", "CEO") for i in range(N)] + [(N, "a", None, "CEO"), (N + 1, "b", "Blue Ring", "CEO"), (N + 2, "a", "Old Bolt", None)], "id int, company string, name string, title string")
    contacts = spark.createDataFrame([("a", i, "blue ring" if i else "Old Bolt", "Chief Executive Officer" if i < 3 else "Clerk") for i in range(N)], "company string, pos int, name string, title string")
    rows, most = most_rows(grounding.ground_people(people, contacts))
    got = {r["id"]: (r["status"], r["listed_title"]) for r in rows}
    assert all(got[i] == ("confirmed", "Chief Executive Officer") for i in range(N)) and len(rows) == N + 3
    assert got[N] == ("not_found", None) and got[N + 1] == (None, None) and got[N + 2] == ("conflict", "Chief Executive Officer")
    assert most < 4 * N


def test_titles_that_share_one_word(spark):
    rows, titles = (spark.createDataFrame([("k", i, "the common word") for i in range(N)], f"key string, {c} int, text string") for c in ("id", "pos"))
    found, most = most_rows(grounding.first_shared_word(rows, titles))
    assert sorted((r["id"], r["pos"]) for r in found) == [(i, 0) for i in range(N)] and most < 4 * N


def test_proofs_with_the_same_tags(spark):
    companies = spark.createDataFrame([(i, ["x", f"y{i % 50}", None]) for i in range(N)], "c int, tags array<string>")
    proofs = spark.createDataFrame([(i, N - i, i % 2, ["x", "x"] if i else ["y7", "x"]) for i in range(N)], "proof int, place int, provenance int, tags array<string>")
    rows, most = most_rows(services.best_proofs(companies, proofs, "c"))
    got = {(r["c"], r["rank"]): (r["proof"], r["score"]) for r in rows}
    assert len(rows) == 2 * N and all(got[i, 1] == ((0, 2) if i % 50 == 7 else (N - 2, 1)) and got[i, 2] == ((N - 2, 1) if i % 50 == 7 else (N - 4, 1)) for i in range(N))
    assert most < 4 * N


def test_parts_of_one_nation(spark, tmp_path):
    spark.createDataFrame([(i, 3, "BUILDING" if i % 2 else "X") for i in range(N)], "c_custkey int, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10 * i, 3, "blue" if i > 9 else "red") for i in range(N)], "p_partkey int, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows, most = most_rows(registry.REGISTRY["SORT_9_best_two"][0](spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == sorted((i, p, r) for i in range(N) for p, r in zip((100, 110) if i % 2 else (0, 10), (1, 2))) and most < 4 * N


def test_best_of_all_parts(spark, tmp_path):
    """Every part is scored, and keys of either provenance count, as a plain scan over all pairs finds them."""
    customers = [(i, i % 4, ("BUILDING", "MACHINERY", "", None)[i % 5 % 4]) for i in range(60)]
    parts = [(i, i % 5, ("blue", "mint", "red", "", None)[i // 7 % 5]) for i in range(1, N) if i % 10] + [(N, 3, "zinc")]
    spark.createDataFrame(customers, "c_custkey int, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(parts, "p_partkey int, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = []
    for c, nation, segment in customers:
        found = [((nation % 3 == size % 3) + (segment[:1] == name[:1].upper()), key) for key, size, name in parts if size == nation and segment is not None and name is not None]
        want += [(c, key, r) for r, (s, key) in enumerate(sorted(found, key=lambda x: (-x[0], x[1] % 2, x[1]))[:2], 1) if s]
    rows, most = most_rows(registry.REGISTRY["SORT_9_best_two_of_all"][0](spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) > 60 and most < 4 * N


def patterns_in_plan(df, words):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [plan.count(w) for w in words]


def test_dear_patterns_are_read_once(spark):
    """Each trigger stands in the plan once, so no text is searched again for each use of what was found."""
    from pyspark.sql import functions as F

    from granary.functions import extraction as E
    from granary.operators import segments as P

    texts = spark.createDataFrame([(1, "We offer A1. We offer a1! We provide B2 lines.\nIndustries we serve. Steel. Tin mills.")], "k int, text string")
    sold, served = texts.select(E.offerings(F.col("text")).alias("x")), texts.select(E.segment_list(F.col("text")).alias("x"))
    assert sold.first()["x"] == ["B2 lines"] and served.first()["x"] == ["Steel", "Tin mills"]
    assert patterns_in_plan(sold, ["specialize"]) == [1] and patterns_in_plan(served, ["spanning)"]) == [1]
    blobs = spark.createDataFrame([(1, "--- PAGE: / ---\n# Anna Lee\nCEO\nAnna Lee heads the Global Team now.\n\nJohn Smith | CFO\nAnna Lee, CEO")], "k int, content string")
    found = P.leaders(P.segments(blobs, "k"), "k")
    assert sorted((r["name"], r["title"], r["portfolio"], r["confidence"]) for r in found.collect()) == [("Anna Lee", "CEO", "Global Team now", "high"), ("John Smith", "CFO", "", "medium")]
    assert patterns_in_plan(found, ["LogicalRDD"]) == [1]


def test_places_are_found_once(spark):
    """No filter on what was found, which would find it once more."""
    from granary.operators import signals

    texts = spark.createDataFrame([("a", 0, "u", "/x", x, "A", False) for x in ("A new plant. Smart factory!", "nothing", "", None)], "company string, seg_no int, url string, path string, text string, name string, is_vendor boolean")
    found = signals.evidence(texts, "company")
    assert sorted((r["signal"], r["pos"]) for r in found.collect()) == [("industry40_initiative", 13), ("new_facility", 2)]
    assert patterns_in_plan(found, ["EvalPython"]) == [1]


def test_signals_read_their_quotes_once(spark):
    """Own quotes and the floor come from one pass."""
    from granary.operators import signals

    rows = [("a", "x", 0, 0, i, f"q{i}", 3 - i % 2, s) for i, s in enumerate(["industry_trend"] * 3 + ["generic_marketing", None])]
    rows += [("b", s, 0, 0, i, f"q{i}", 2, "company_strategy" if i % 2 else "industry_trend") for i, s in enumerate("xxxyy")] + [("c", "x", 0, 0, 0, "q", 1, "generic_marketing")]
    got = signals.signals(spark.createDataFrame(rows, "company string, signal string, seg_no int, rule int, pos int, quote string, tier int, subject string"), "company")
    assert sorted((r["company"], r["signal"], r["n"], r["is_own"], r["best_quote"]) for r in got.collect()) == [("a", "x", 2, False, "q1"), ("b", "x", 1, True, "q1"), ("b", "y", 1, True, "q3")]
    assert patterns_in_plan(got, ["LogicalRDD"]) == [1]


def test_texts_are_cut_at_marks_not_walked(spark):
    """A page ends at the next mark, with a head or not; a head may hold a mark; no place is tried by looking ahead."""
    from granary.operators import segments as P

    blobs = [
        "ante --- PAGE: /a (u) ---\none\n--- PAGE: no head\ntwo --- page: /b ---\n\n three ", "--- PAGE: x --- PAGE: /c ---\nfour", "--- PAGE: a ---\nPAGE: /d ---\nfive --- PAGE:",
        "[SOURCE: jobs | tier1 | v]\n \nsix [source: no head] seven [SOURCE: blog|Tier2|w]", "--- PAGE: / ---\n" + "- " * 100_000 + "[SOURCE:", " \n", None]
    got = P.segments(spark.createDataFrame(list(enumerate(blobs)), "k int, content string"), "k")
    rows = sorted((r["k"], r["seg_no"], r["url"], r["path"], r["text"], r["tier"]) for r in got.collect())
    assert rows == [
        (0, 0, "u", "/a", "one", 3), (0, 1, "/b", "/b", "three", 3), (1, 0, "x --- PAGE: /c", "x --- PAGE: /c", "four", 3), (2, 0, "a", "a", "PAGE: /d ---\nfive", 3),
        (3, 0, "v", None, "six", 1), (4, 0, "/", "/", ("- " * 100_000 + "[SOURCE:").strip(), 3)]
    assert patterns_in_plan(got, ["*?(?="]) == [0]
