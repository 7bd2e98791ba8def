"""Segment lists against plain regular expressions, and numbered rows of CSV files in several splits."""

import random
import re

from pyspark.sql import functions as F

from granary.functions import extraction as E
from granary.plans import lists as plans
from granary.sources import leads


def by_hand(text):
    m = re.search(E.SEGMENT_TRIGGER, text or "", re.I | re.A)
    if not m:
        return []
    after = re.sub(E.ADDRESS, " ", text[m.end() : m.end() + 200], flags=re.A)
    lead = re.match(r"\s*[.!?]+\s*", after)
    if lead:
        items = []
        for raw in re.split(r"[.!?]+", after[lead.end() :]):
            item = raw.strip()
            if not item:
                continue
            if re.search(E.BOILERPLATE, item, re.I) or len(item.split()) > 6:
                break
            items.append(item)
            if len(items) == 8:
                break
        return [s for s in items if 3 <= len(s) <= 50]
    window = re.sub(E.LEFTOVER, "", re.split(r"[.!?]", after)[0], flags=re.I)
    kept = []

    def mask(m):
        kept.append(m[0])
        return f"IDIOM{len(kept) - 1}#"

    for idiom in E.IDIOMS:
        window = re.sub(r"\b" + idiom.replace(" ", r"\s+") + r"\b", mask, window, flags=re.I)
    out = []
    for part in re.split(r",|;|\band\b|&", window, flags=re.I):
        part = re.sub(r"^(?:the|a|an)\s+", "", part, flags=re.I).strip()
        for k, original in enumerate(kept):
            part = part.replace(f"IDIOM{k}#", original)
        out.append(part.strip())
    return [s for s in out if 3 <= len(s) <= 50]


def test_segment_lists(spark):
    rng = random.Random(3)
    words = [*E.IDIOMS, "Oil and  Gas", "OIL AND GAS lines", "the rail", "a mine", "banks", "and", ",", ";", "&", ".", "x@y.example.com", "©", "hand in hand", "band and gas", "xy"]
    texts = [None, "", *plans._SEGMENTS]
    texts += [rng.choice(["Industries we serve", "customers include", "Serving the ", "clients range from", "sectors: "]) + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", E.segment_list(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.s == by_hand(texts[r.k]), texts[r.k]
    assert sum(len(r.s) for r in rows) > 300


def test_rows_of_many_splits(spark, tmp_path):
    """Numbers are those of a file's lines, however many splits a file is read in and files a task reads."""
    for name, n in (("a", 2000), ("b", 3), ("c", 700), ("d", 0)):
        lines = ["Account Name,pay,Location"] + [f"{name}{k}," + "x" * (k % 40) + "," if k % 10 else f" ,{name}," for k in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = leads.read_csv(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 1
        got = [(r.file.rsplit("/", 1)[1], r.pos, r["Account Name"]) for r in rows.collect()]
        good, bad = leads.project(rows)
        warned = sorted((r.file.rsplit("/", 1)[1], r.warning) for r in bad.collect())
        assert good.count() + len(warned) == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(f"{name}.csv", k, f"{name}{k}" if k % 10 else " ") for name, n in (("a", 2000), ("b", 3), ("c", 700)) for k in range(n)]
    assert sorted(got) == sorted(want)
    assert warned == sorted((f, f"Row {k + 2}: no company name") for f, k, _ in want if k % 10 == 0)


def test_cells_of_several_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,company\n"a ""quoted""\nline",b\n,\nz,c\n')
    assert [(r.pos, r.name, r.company) for r in leads.read_any(spark, str(tmp_path / "x.csv")).orderBy("pos").collect()] == [(0, 'a "quoted"\nline', "b"), (1, None, None), (2, "z", "c")]


def test_quotes_of_few_words(spark):
    """Quotes are found wherever a text holds them, though their first and last words stand inside longer ones."""
    from granary.operators import content

    quotes = [(1, "internationalisation considerations notwithstanding everywhere"), (2, "internationalisation considerations"), (3, "donaudampfschifffahrtsgesellschaft"), (4, "counterrevolutionaries and others too often"), (5, "too short"), (6, "a quote of six words or more, which stands in a text"), (7, "x" + " " * 40 + "y")]
    texts = ["internationalisation considerations notwithstanding everywhere", "so internationalisation  Considerations notwithstanding everywhere.", "(internationalisation considerations)", "die Donaudampfschifffahrtsgesellschaften", "of counterrevolutionaries and others\ntoo oftentimes", "xa quote of six words or more, which stands in a texts", "nothing", "", "max yes"]
    docs = [*enumerate(texts), (99, None)]
    squeeze = lambda s: " ".join(s.lower().split())
    want = sorted((i, d) for i, quote in quotes for d, t in docs if len(quote.strip()) >= 30 and squeeze(quote) in squeeze(t or ""))
    got = content.quote_tiers(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.item_id, r.doc_id) for r in got.where("tier = 'exact'").collect()) == want and len(want) == 9


def test_offerings_and_statements(spark):
    from granary.functions import text as X

    told = lambda t: spark.createDataFrame([(t,)], "t string").select(E.offerings(F.col("t"))).first()[0]
    assert told(None) == [] and told("We offer pumps. We provide Pumps! we deliver of valves, bolts\nmore") == ["pumps", "valves, bolts"]
    # a trigger inside another's window is found too, and the outer one is a fragment
    assert told("We provide gears. Our products include belts and we design lines") == ["gears", "belts and we design lines", "lines"]
    assert len(told(" ".join(f"We offer item {k}." for k in range(40)))) == 8
    parts = spark.createDataFrame([("One two. Three! Four",)], "t string").select(X.bare_sentences(F.col("t"))).first()[0]
    assert parts == ["One two", "Three", "Four"]
