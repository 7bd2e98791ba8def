"""The smaller rules by hand."""

import datetime

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import events, history


def values(spark, column, texts, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"k int, x {kind}")
    return [r.v for r in rows.select("k", column.alias("v")).orderBy("k").collect()]


def test_names_answers_values(spark):
    x = F.col("x")
    assert values(spark, X.name_from_domain(x), ["big-steel.co.in", "acmeWorks.com", "plain", "", None, "a_b.example"]) == ["Big steel", "Acme Works", "Plain", "", None, "A b.example"]
    assert values(spark, X.json_from_answer(x), ["```json\n{\"a\": 1}\n```", " no json ", "x {1} y {2} z", "} {", "```\n[1]\n```", "", None]) == ['{"a": 1}', "no json", "{1} y {2}", "} {", "[1]", "", None]
    assert values(spark, X.text_or(x, "-"), [" a ", " \t", None]) == ["a", "-", "-"]
    assert values(spark, X.number_or(x, 9.0), [" 12.5kg", "-3e2", ".5", "0", "x1", None, "7."]) == [12.5, -300.0, 0.5, 9.0, 9.0, 9.0, 7.0]
    assert values(spark, X.mail_local(x), ["Mary-Jane O'Neil", " Bo ", "42", "", None, "a B c"]) == ["mary-jane.o'neil", "bo", None, None, None, "a.c"]


def test_seeds(spark):
    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    seeds = ["", "a", "seed 7", "Ünïcode", "x" * 50]
    options = ["p", "q", "r"]
    assert values(spark, X.seeded_ratio(F.col("x")), seeds) == [fnv(s) / 0xFFFFFFFF for s in seeds]
    assert values(spark, X.seeded_pick(F.col("x"), F.array(*[F.lit(o) for o in options])), seeds) == [options[int(fnv(s) / 0xFFFFFFFF * 3) % 3] for s in seeds]


def test_replies(spark):
    rows = [(1, 1, "a", "Me <u@x>", None), (1, 3, "c", "U@X", "failure notice"), (1, 2, "b", "MAILER-DAEMON@z", None), (2, 1, "d", None, "x"), (3, 1, "e", "p@z", "Delivery status notification (failure)"), (4, 1, "f", "postmasters@z", "Re: failure noticed"), (4, 1, "g", "q@z", None)]
    frame = spark.createDataFrame([(*r, "u@x") for r in rows], "k int, place int, message_id string, sender string, subject string, connected string")
    assert sorted((r.k, r.message_id, r.is_bounce) for r in events.last_reply(frame, "k").collect()) == [(1, "b", True), (3, "e", True), (4, "g", False)]


def test_cache_with_ttl(spark):
    now = datetime.datetime(2024, 5, 2, 12)
    hours = lambda h: now - datetime.timedelta(hours=h)
    cache = spark.createDataFrame([("a", hours(24), "v"), ("a", hours(30), "old"), ("b", hours(24) - datetime.timedelta(milliseconds=1), "v"), (None, now, "v"), ("c", None, "v")], "url string, at timestamp, value string")
    asked = spark.createDataFrame([(k, u, now) for k, u in enumerate(["a", "b", "c", None, "d"])], "id int, url string, now timestamp")
    assert sorted((r.id, r.value, r.is_hit) for r in history.cache_hits(asked, cache, 24).collect()) == [(0, "v", True), (1, None, False), (2, None, False), (3, None, False), (4, None, False)]
