"""Histories in slices and in one go, sitemap rounds, state machines and late arrivals, in batches and as streams."""

import datetime
import random

import pytest

from granary.operators import frontier, history

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, seq long, op string, v int, w string, piece string"


def feed(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), T0 + datetime.timedelta(hours=rng.randint(0, 200)), k, rng.choice(["insert", "update", "update", "delete", "odd", None]), rng.choice([None, rng.randint(0, 9)]), rng.choice([None, "x", "y"]), "z") for k in range(n)]
    return rows + [rows[3], ("a", None, 5, "insert", 1, "x", "z")]


def by_hand(rows):
    out, live = [], {}
    for key, at, seq, op, v, w in sorted({r[:6] for r in rows if None not in (r[0], r[1]) and r[3] in history.KINDS}, key=lambda r: r[:3]):
        now = live.get(key)
        if (op == "insert") != (now is None):
            continue
        if now:
            now[4] = at
        if op == "delete":
            live[key] = None
            continue
        old = (None, None) if op == "insert" else now[1:3]
        live[key] = [key, v if v is not None else old[0], w if w is not None else old[1], at, None]
        out.append(live[key])
    return sorted((tuple(r) + (r[4] is None,) for r in out), key=repr)


@pytest.mark.parametrize("span", [3600, 86_400, 10**9])
def test_history(spark, span):
    rows = feed()
    got = history.versions(spark.createDataFrame(rows, SCHEMA), ["v", "w"], span).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows) and got
    assert history.versions(spark.createDataFrame([], SCHEMA), ["v", "w"]).count() == 0


def test_history_in_slices(spark, tmp_path):
    """Slices in any order, one of them twice, leave what one go leaves."""
    rows = feed(120, 2)
    slices = [rows[k::3] for k in range(3)]
    for part in (slices[2], slices[0], slices[0], slices[1]):
        history.apply_changes(spark, str(tmp_path / "h"), spark.createDataFrame(part, SCHEMA), ["v", "w"], buckets=4)
    assert sorted(map(tuple, history.history(spark, str(tmp_path / "h")).select("key", "v", "w", "valid_from", "valid_to", "is_current").collect()), key=repr) == by_hand(rows)


def test_sitemaps(spark):
    pad = " " * 100
    loc = lambda *urls: "".join(f"<loc> {u} </loc>" for u in urls)
    fetched = [
        ("http://a/sitemap.xml", "<sitemapindex>" + pad + loc("http://a/press.xml", "http://a/press.xml", "http://a/shop.xml", "http://a/sitemap.xml", *[f"http://a/esg{k}.xml" for k in range(5)], "http://a/page")),
        ("http://a/press.xml", "<urlset>" + pad + loc("http://a/1", "http://a/2", "http://a/careers.xml")), ("http://a/esg0.xml", "<sitemap>" + pad + loc("http://a/3", "http://a/press.xml", "http://a/esg4.xml", "ftp://no")),
        ("http://a/esg4.xml", "<urlset>" + pad + loc("http://a/4")), ("http://a/esg1.xml", loc("http://a/short")), ("http://b/sitemap.xml", "<urlset>" + pad + loc("http://b/1", "http://b/1", "http://b/x.xml")), ("http://c/sitemap.xml", None)]
    sites = spark.createDataFrame([("a", "http://a/sitemap.xml"), ("a", "http://a/sitemap.xml"), ("b", "http://b/sitemap.xml"), ("c", "http://c/sitemap.xml"), ("d", "http://missing"), ("e", None)], "site string, url string")
    table = spark.createDataFrame(fetched, "url string, xml string")
    rows = lambda n: sorted(map(tuple, frontier.sitemap_pages(sites, table, n).collect()))
    # of the five candidates of a round two are the same and esg3, esg4 are beyond them
    assert rows(1) == [("a", "http://a/1", 1), ("a", "http://a/2", 1), ("a", "http://a/3", 1), ("b", "http://b/1", 0)]
    assert rows(4) == sorted([*rows(1), ("a", "http://a/4", 2)])
    assert frontier.sitemap_pages(sites.limit(0), table).count() == 0


KINDS = ["sent", "followup", "opened", "followup", "followup", "sent", "replied", "followup", "bounced", "stopped", None]
EVENTS = "key long, at timestamp, seq long, kind string, state string"


def moves(n=240, seed=4):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, *range(2, 30)]), T0 + datetime.timedelta(minutes=rng.randint(0, 5000)), k, rng.choice(KINDS[:3] if rng.random() < 0.5 else KINDS), "x") for k in range(n)]
    return rows + [(None, T0, 1, "sent", "x"), (1, None, 2, "sent", "x")]


def moves_by_hand(rows):
    from granary.operators import states as S

    out, now = {}, {}
    for key, at, seq, kind, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:3]):
        before = now.get(key, "queued")
        after = S.MOVES.get(kind, {}).get(before)
        now[key] = after or before
        out[seq] = (key, kind, before, now[key], after is not None)
    return out


@pytest.mark.parametrize("span", [3600, 86_400, 10**9])
def test_transitions(spark, span):
    from granary.operators import states as S

    rows = moves()
    got = {r.seq: (r.key, r.kind, r.before, r.state, r.accepted) for r in S.transitions(spark.createDataFrame(rows, EVENTS).repartition(3), span).collect()}
    assert got == moves_by_hand(rows) and {s for *_, s, _ in got.values()} >= {"followup_2", "stopped"}
    assert S.transitions(spark.createDataFrame([], EVENTS)).count() == 0


def streamed(spark, tmp_path, rows, schema, make, name, parts=4):
    """The rows as files of a stream, a trigger each, in order of time but for what the watermark's delay allows."""
    frame = spark.createDataFrame(rows, schema)
    (tmp_path / "in").mkdir()
    query = make(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    ordered = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]) + [r for r in rows if r[1] is None]
    size = -(-len(ordered) // parts)
    try:
        for k in range(parts):
            part = ordered[k * size : (k + 1) * size]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        # time goes on, so that all rows and timers are passed
        for days in (1000, 2000):
            spark.createDataFrame([(-1, T0 + datetime.timedelta(days=days), -days, "end", "x")], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    return [r for r in spark.table(name).collect() if r.key != -1], kept


def test_transitions_as_a_stream(spark, tmp_path):
    """A stream in several triggers decides what the batch decides, and its state ends."""
    from granary.streaming import ordered

    rows = moves()
    got, kept = streamed(spark, tmp_path, rows, EVENTS, lambda s: ordered.transitions(s, "1 minute"), "moves")
    assert {r.seq: (r.key, r.kind, r.before, r.state, r.accepted) for r in got} == moves_by_hand(rows)
    assert kept <= 1


def test_arrivals(spark, tmp_path):
    from granary.operators import states as S
    from granary.streaming import ordered

    rng = random.Random(6)
    rows = []
    for key in range(12):
        if key % 5:
            rows.append((key, T0 + datetime.timedelta(seconds=key * 300), len(rows), "start", "x"))
        for _ in range(4):
            rows.append((key, T0 + datetime.timedelta(seconds=key * 300 + rng.choice([-3, 0, 2, 8, 9, 40, 70, 71, 90])), len(rows), "result", "x"))
    batch = {r.seq: (r.key, r.waited_ms, r.arrived) for r in S.arrivals(spark.createDataFrame(rows, EVENTS)).collect()}
    starts = {r[0]: r[1] for r in rows if r[3] == "start"}
    for key, at, seq, kind, _ in rows:
        if kind == "result":
            waited = (at - starts[key]).total_seconds() if key in starts else -1
            assert batch[seq][2] == ("dropped" if waited < 0 or waited > 70 else "prompt" if waited <= 8 else "late")
    got, kept = streamed(spark, tmp_path, rows, EVENTS, lambda s: ordered.arrivals(s, delay="2 minutes"), "arrived", parts=3)
    assert {r.seq: (r.key, r.waited_ms, r.arrived) for r in got} == batch and kept <= 1
    prompt, late = ordered.prompt_and_late(spark.table("arrived"))
    assert prompt.count() + late.count() == sum(x[2] != "dropped" for x in batch.values())
    told = {r.key: (r.n_prompt, r.n_late, r.prompt_enriched, r.reextract) for r in S.enriched(S.arrivals(spark.createDataFrame(rows, EVENTS))).collect()}
    assert len(told) == 12 and all(p == (a > 0) and q == (b > 0) for a, b, p, q in told.values())


def test_rate_limit_in_order(spark, tmp_path):
    from granary.operators import events
    from granary.streaming import ordered

    rng = random.Random(7)
    rows = [(rng.randint(1, 4), T0 + datetime.timedelta(seconds=rng.randint(0, 3000)), k, "r", "x") for k in range(150)]
    batch = {r.event_id: r.allowed for r in events.rate_limited(spark.createDataFrame(rows, EVENTS).selectExpr("key", "at AS ts", "seq AS event_id"), 2, 120).collect()}
    got, kept = streamed(spark, tmp_path, rows, EVENTS, lambda s: ordered.rate_limited(s, 2, 120, "1 minute"), "limited_in_order")
    assert {r.seq: r.allowed for r in got} == batch and kept <= 1
