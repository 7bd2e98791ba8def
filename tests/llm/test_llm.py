"""The operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies, shared passages; extra columns with clashing names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = make(60), make(120).split(" ")
    texts = [None, "", "   \n\t", "Äö ü", "one two", "one two", "ONE two", "x" * 5000, make(4000), "aaaa " * 300, shared, make(30) + " " + shared + " " + make(30), make(20) + "\n" + shared + "é" + make(10)]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [make(80) for _ in range(10)] + [shared + shared]
    rows = [(i, t, None if i % 7 == 0 else "en", None, None, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(frame):
    return sorted((r.doc_id, r.text or "") for r in frame.collect())


def test_quality_rules(odd, empty):
    from granary.llm import quality_rules as q

    got = {r.doc_id: r for r in q.judge(odd).collect()}
    for i, t in texts_of(odd):
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        cover = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert q.judge(empty).count() == 0 and q.keep_good(odd).columns == odd.columns


def test_minhash(odd, empty):
    from granary.llm import minhash as q

    sets = {}
    for i, t in texts_of(odd):
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in q.components(odd).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert q.components(empty).count() == 0


def test_suffix_dedup(odd, empty):
    from granary.llm import suffix_dedup as q

    got = {r.doc_id: r for r in q.stripped(odd).collect()}
    seen = set()
    for i, t in texts_of(odd):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert q.stripped(empty).count() == 0


def test_multikey_quicksort():
    import numpy as np

    from granary.llm.suffix_dedup import multikey_quicksort

    keys = np.random.default_rng(1).integers(0, 3, size=(5000, 6)).astype(np.uint64)
    order = multikey_quicksort(keys)
    assert [tuple(r) for r in keys[order]] == sorted(map(tuple, keys))


def test_byte_bpe(odd, empty):
    tiktoken = pytest.importorskip("tiktoken")
    from granary.llm import byte_bpe as q

    path, pattern = q.default_files()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=q.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in q.encode_documents(odd, path, pattern, ["doc_id"], with_ids=True).collect()}
    for i, t in texts_of(odd):
        assert list(got[i].ids) == theirs.encode_ordinary(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    table = q.PrefixTable(q.codec(path, pattern).vocabulary, b"internationalisation of everything" * 3)
    assert table.replace(10, 13, b"qq") < len(table.data)
    assert table.last == q.PrefixTable(table.vocabulary, table.data).last
    assert q.encode_documents(empty, path, pattern, ["doc_id"]).count() == 0


def test_lattice_lm(odd, empty):
    import math

    import numpy as np

    from granary.llm import lattice_lm as q

    pieces, scores = [b" a", b" ab", b"b", b"c", b"bc", b"a"], np.log([0.3, 0.2, 0.1, 0.1, 0.2, 0.1])

    def brute(rest):
        return 1.0 if not rest else sum(math.exp(s) * brute(rest[len(p) :]) for p, s in zip(pieces, scores) if rest.startswith(p))

    words = [b"abc", b"ab", b"abcbc", b"cab", b"a"]
    got = np.exp(q.Lattice(pieces).log_probabilities(words, scores))
    assert np.allclose(got, [brute(b" " + w) for w in words])
    rows = {r.doc_id: r for r in q.score(odd, q.default_path(), max_words=50).collect()}
    count = collections.Counter()
    for i, t in texts_of(odd):
        if zlib.crc32(str(i).encode()) % 10:
            count.update(WORD.findall(t.translate(LOWER)) + ["\0"])
    n, v = sum(count.values()), len(count)
    for i, t in texts_of(odd):
        w = WORD.findall(t.translate(LOWER)) + ["\0"]
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert rows[i].score < 0
    assert q.score(empty, q.default_path()).count() == 0


def test_decontamination(spark, odd):
    from granary.llm import decontaminate as q

    bench = spark.createDataFrame([(1, "Train A from Boston travels 120 km in 3 hours while Alice waits for Bob at 5 dollars an hour today"), (2, None), (3, "short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so train A from Denver travels 80 km in 2 hours while Mary waits for John at 7 dollars an hour today ok"), (2, "train A from Denver travels 80 km in 2 hours while Mary waits for Mary at 7 dollars an hour today"), (3, None), (4, ""), (5, "nothing of the kind is said here at all in this text")], "doc_id long, text string")
    assert {r.doc_id: r.verbatim for r in q.judged(docs, bench).collect()} == {1: False, 2: False}
    assert q.hits(docs, bench).where("doc_id = 2").first().n_windows < q.hits(docs, bench).where("doc_id = 1").first().n_windows
    assert q.hits(docs, bench, broadcast_chars=1).count() == q.hits(docs, bench).count()
    assert q.drop_contaminated(odd, bench).count() == odd.count()


def test_language(spark, odd, empty):
    from granary.llm import ppm_language as q

    trees = q.ContextTrees.learn({"en": [b"the cat sat on the mat and the dog " * 5], "de": ["die Katze saß auf der Matte und der Hund ".encode() * 5]})
    docs = spark.createDataFrame([(1, "the dog sat"), (2, "der Hund saß"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in q.predict(docs, trees).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    text = b"the den"
    direct = sum(trees.code_lengths(q.grams(__import__("numpy").frombuffer(b"   " + text, dtype="uint8"), 4)))
    assert trees.score([text])[0] == pytest.approx(direct, rel=1e-5)
    assert {r.lang_pred for r in q.predict(docs, None).collect()} == {"und"} and q.predict(empty, trees).count() == 0


def test_toxicity(spark, empty):
    from granary.llm import toxicity as q

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + ["nastyword, vile!"] * bad)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in q.score(docs, q.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert min(got[i] for i in held if i % 5 == 0) > max(got[i] for i in held if i % 5) and got[1000] == got[1001] < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in q.score(docs, q.fit(docs, none)).collect()} == {0.0} and q.score(empty, None).count() == 0


def test_url_filter(spark):
    from granary.llm import url_filter as q

    urls = ["http://www.casinobets.example.org/en/1", "http://a.net", "http://a.net/x", "https://b.example.net/en/5?q#f", "http://example.com/de/1", "http://x.org/fr/2", None, "nothing", "HTTP://Q.ORG?x"] + [f"http://blog{i}.example.org/en/{i}" for i in range(20)]
    got = {r.page_id: r for r in q.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4, 5, 6, 8)] == [("a.net", "", None), ("a.net", "/x", "net/"), ("b.example.net", "/en/5", "example.net/en/"), ("example.com", "/de/1", "example.com/de/"), ("x.org", "/fr/2", "org/fr/"), ("", "", None), ("q.org", "", None)]
    assert [got[i].verdict for i in (0, 2, 3, 4, 5, 6, 7)] == ["block", "block", "allow", "block", "allow", "allow", "allow"]
    assert q.Splitter({"casino": 9, "bets": 9}).split("casinobets") == ["casino", "bets"]


def test_warc(spark, tmp_path):
    import zstandard

    from granary.llm import warc as q

    pages = spark.createDataFrame([(1, "http://a/1", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (3, "http://a\n/3", None, "x"), (4, "u", "", "x"), (5, "u", "other " * 5000, "x")], "page_id long, url string, html string, digest string")
    q.write_archives(pages, str(tmp_path / "w"))
    back = q.read_archives(spark, str(tmp_path / "w"))
    got = {r.page_id: r for r in q.resolved(back).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {1: ("revisit", 2, 9), 2: ("response", None, 9), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 30000)}
    assert {r.page_id: r.html for r in back.collect()}[5] == "other " * 5000
    record = q.make_record(1, "u", "hello", None, q.base32_sha1(hashlib.sha1(b"hello").hexdigest()))
    assert q.parse_record(record)[0]["warc-type"] == "response"
    for broken in (record[:-1], record.replace(b"hello", b"hellO"), record.replace(b"WARC/1.1", b"XXXX/1.1")):
        with pytest.raises(ValueError):
            q.parse_record(broken)
    data = zstandard.ZstdCompressor().compress(record)
    assert [c for _, c in q.frames(data + q.SEPARATOR + data)] == [record, record]
    with pytest.raises(ValueError):
        list(q.frames(data[:-3]))


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small)
        assert docs.columns == before.columns, name


def test_url_filter_joined_hosts(spark):
    from granary.llm import url_filter as q

    names = ["casinobets"] * 60 + ["casinoroyal"] * 30 + ["better"] * 30 + ["best-casino"] * 5
    urls = [f"http://www.{n}.example.edu/en/w{chr(97 + i % 26)}x/{i}" for i, n in enumerate(names)] + [f"http://blog{i}.example.edu/en/w{chr(97 + i % 26)}x/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in q.judge(pages).collect()}
    assert [{got[i].verdict for i in part} for part in (range(60), range(60, 90), range(90, 120), range(120, 125), range(125, 425))] == [{"block"}, {"block"}, {"allow"}, {"block"}, {"allow"}]
    for bound in (1, 4):
        few = {r.page_id: r for r in q.judge(pages, max_words=bound).collect()}
        assert all(few[i].verdict == got[i].verdict and few[i].score == pytest.approx(got[i].score) for i in got) and len(few) == len(got)


def test_near_duplicates_stage(spark):
    import corpus_pipeline

    rng = random.Random(9)
    make = lambda: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
    base, other = make(), " ".join(make())
    copy = base[:30] + ["new"] + base[31:70] + ["other"] + base[71:]  # 86 of 106 shingles: 0.811
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (None, "a clean text"), (None, "a clean text"), (5, other), (5, other), (6, None), (7, "once"), (7, None), (8, other)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, "a clean text")] * 2 + [(1, " ".join(base)), (5, other), (6, ""), (7, "once")])


def test_lattice_lm_bound_changes_no_score(odd):
    from granary.llm import lattice_lm as q

    few, all_ = ({r.doc_id: r.score for r in q.score(odd, q.default_path(), max_words=n).collect()} for n in (5, q.MAX_WORDS))
    assert few == pytest.approx(all_, rel=1e-9) and len(few) == odd.count()


def test_suffix_dedup_long_runs(spark, odd, monkeypatch):
    from granary.llm import suffix_dedup as q

    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = make(400)
    rows = [(i, make(rng.randint(70, 120)) + shared[: rng.randint(250, 400)] + make(90)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.unionByName(odd.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    monkeypatch.setattr(q, "RUN_ROWS", 8)
    places = q.sort_out(q.scan(q.numbered(docs))).agg(F.sum(F.size("open")).alias("open"), F.sum(F.size("long")).alias("long")).first()
    assert places.long > 60 and places.open < places.long
    got = {r.doc_id: r for r in q.stripped(both).collect()}
    keyed = q.numbered(docs)
    long = q.sort_out(q.scan(keyed)).where(F.size("long") > 0).select("key", "long")
    shipped, joined = (sorted(map(tuple, q.compare_long(keyed, long, n).collect())) for n in (10**6, 0))
    assert shipped == joined and len(shipped) > 60
    seen = set()
    for i, t in texts_of(both):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())


def removed_by_brute_force(texts):
    """(bytes removed, digest of the others) of texts in order."""
    seen, out = set(), []
    for data in (t.encode() for t in texts):
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        out.append((sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_repeated_and_missing_ids(spark, odd):
    from granary.llm import suffix_dedup as q

    extra = odd.where("doc_id in (8, 11, 12)").select(F.lit(8).cast("long").alias("doc_id"), "text")
    lost = odd.where("doc_id in (8, 9, 0)").select(F.lit(None).cast("long").alias("doc_id"), "text")
    docs = odd.select("doc_id", "text").unionByName(extra).unionByName(lost)
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    want = sorted(zip([None if r[0] else r[1] for r in rows], removed_by_brute_force([r[3] for r in rows])), key=str)
    got = [(r.doc_id, (r.n_removed, r.kept_sha256)) for r in q.stripped(docs).collect()]
    assert sorted(got, key=str) == want
    whole = q.cut(odd.unionByName(odd.where("doc_id = 8")), lambda b: b.cast("string"), sizes=("n_chars",))
    assert whole.columns == odd.columns and whole.count() == odd.count() + 1
    assert sorted(r.text for r in whole.where("doc_id = 8").collect())[0] == ""


@pytest.mark.parametrize("size", [1, 30, 700])
def test_suffix_orders_find_what_windows_share(size):
    import numpy as np

    from granary.llm import suffix_dedup as q

    rng = np.random.default_rng(size)
    parts = rng.integers(97, 100, size=(3, q.BEFORE + q.LENGTH), dtype=np.uint8)
    rows = parts[rng.integers(0, 3, size=size)].copy()
    rows[np.arange(size), rng.integers(0, rows.shape[1], size=size)] = 120
    left, right = rng.integers(0, q.BEFORE + 1, size=size), rng.integers(q.LEAD, q.LENGTH + 1, size=size)
    doc, pos = rng.permutation(size), np.zeros(size, dtype=np.int64)
    for i in range(size):
        rows[i, : q.BEFORE - left[i]] = 0
        rows[i, q.BEFORE + right[i] :] = 0
    least, most = q.repeated_windows(rows, left, right, doc, pos)
    seen = [{} for _ in range(q.BEFORE + 1)]
    for i in np.argsort(doc):
        hits = []
        for offset in range(q.BEFORE + 1):
            if left[i] >= offset and right[i] >= q.LENGTH - offset:
                window = rows[i, q.BEFORE - offset : q.BEFORE - offset + q.LENGTH].tobytes()
                hits += [offset] * (window in seen[offset])
                seen[offset][window] = True
        assert (least[i], most[i]) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_suffix_dedup_frequent_leads(spark, odd, monkeypatch):
    from granary.llm import suffix_dedup as q

    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = make(300)
    docs = spark.createDataFrame([(i, make(rng.randint(0, 150)) + shared + (make(60) if i % 3 else "")) for i in range(90)], "doc_id long, text string")
    keyed = q.numbered(docs)
    assert len(q.sample(keyed)[1]) > 0
    places = q.sort_out(q.scan(keyed, q.sample(keyed)[1]))
    assert places.agg(F.sum(F.size("hot"))).first()[0] > 0
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in q.stripped(docs).collect()}
    assert [got[i] for i in range(90)] == removed_by_brute_force([r.text for r in docs.orderBy("doc_id").collect()])


def test_decontamination_of_short_and_long_items(spark, odd, empty):
    from granary.llm import decontaminate as q

    rng = random.Random(3)
    long_item = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200))
    passage = " ".join(long_item.split(" ")[90:103])
    items = [("b", "What is the capital of France?"), ("a", "Paris"), ("c", long_item), ("d", ""), ("e", None), ("f", "12 km in 3 hours"), ("f", "12 km in 3 hours")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["so what is the CAPITAL of France then", "what is the capital of Spain", "paris", "Paris is nice", "x y " + passage + " z", "x y " + " ".join(passage.split(" ")[:12]) + " z", "it took 12 km in 3 hours", "it took 15 km in 4 hours", None, "", "Paris"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    assert {r.doc_id: (r.n_items, r.best_item, r.verbatim) for r in q.judged(docs, bench).collect()} == {0: (1, "b", True), 2: (1, "a", True), 4: (1, "c", True), 6: (1, "f", True), 10: (1, "a", True)}
    twice = docs.unionByName(docs)
    kept = q.drop_contaminated(twice, bench)
    assert kept.columns == docs.columns and kept.count() == 12
    assert {r.doc_id for r in q.judged(twice, bench).collect()} == {0, 2, 4, 6, 10}
    assert q.judged(docs, bench.where("false")).count() == 0 and q.judged(empty, bench).count() == 0
    assert q.drop_contaminated(docs, bench.where("false")).count() == len(texts)


def test_decontamination_against_containment(spark, small):
    from granary.llm import decontaminate as q

    read = lambda name: spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/{name}.parquet")
    docs, bench = read("documents"), read("benchmark")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.select("doc_id", "text").collect() if any(x in plain(r.text or "") for x in items)}
    assert len(want) > 10 and {r.doc_id for r in q.judged(docs, bench).collect()} == want


def test_language_by_its_definition(spark, odd, monkeypatch):
    """Code lengths against PPM written out in plain Python; blocks, odd rows and ties."""
    import math

    from granary.llm import ppm_language as q

    rows = [(i, ("the cat sat on the mat " if i % 2 else "die Katze saß auf der Matte ") * (1 + i % 3), "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(40, None, "en", "x"), (41, "", "de", "x"), (42, "12 34", "en", "x"), (43, "some text", None, "x"), (1, "the cat sat on the mat " * 2, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    trees = q.training_counts(docs)
    learnt = {"en": [], "de": []}
    for i, t, lang, _ in rows:
        if lang and t and re.search("[a-zA-Z]", t) and zlib.crc32(str(i).encode()) % 5:
            learnt[lang].append(t.encode())

    def bits(lang, text):
        total, data = 0.0, b"   " + text
        for at in range(3, len(data)):
            for k in (3, 2, 1, 0):
                after = collections.Counter()
                for x in learnt[lang]:
                    padded = b" " * k + x
                    for p in range(k, len(padded)):
                        if padded[p - k : p] == data[at - k : at]:
                            after[padded[p]] += 1
                size = sum(after.values()) + len(after)
                if after[data[at]]:
                    total += math.log2(size / after[data[at]])
                    break
                if after:
                    total += math.log2(size / len(after))
            else:
                total += 8
        return total

    texts = ["the mat", "Matte saß", "zq the q"]
    for text, got in zip(texts, trees.score([t.encode() for t in texts])):
        assert list(got) == pytest.approx([bits(x, text.encode()) for x in trees.languages], rel=1e-4)
    long = ("the cat saß on " * 400).encode()
    whole = trees.score([long, b"mat"])
    monkeypatch.setattr(q, "BLOCK", 50)
    assert trees.score([long, b"mat"]).ravel().tolist() == pytest.approx(whole.ravel().tolist(), rel=1e-6)
    got = q.predict(docs, trees).collect()
    assert len(got) == len(rows) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    same = q.ContextTrees.learn({"b": [b"abc abc"], "a": [b"abc abc"]})
    assert q.predict(docs.where("doc_id = 3"), same).first().lang_pred == "a"
    assert q.training_counts(docs.where("lang IS NULL")) is None


def test_language_accuracy_on_held_out_rows(spark, small):
    from granary.llm import ppm_language as q

    d = small.replace("sf0.001", "sf0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in q.query(spark, d).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(got) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)


def test_warc_odd_rows(spark, tmp_path):
    from granary.llm import warc as q

    big = 2**62 + 1
    rows = [(None, "u", "same"), (None, "u", "none but this"), (big, "u", "same"), (big - 1, None, "same"), (7, "u", "alone"), (7, "u", "alone"), (8, "u", "é" * 200_000), (9, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    q.write_archives(pages, str(tmp_path / "odd"))
    got = q.resolved(q.read_archives(spark, str(tmp_path / "odd"))).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=key) == sorted(
        [(None, "response", None, 4), (None, "response", None, 13), (big, "response", None, 4), (big - 1, "revisit", big, 4), (7, "response", None, 5), (7, "response", None, 5), (8, "response", None, 400_000), (9, "response", None, 0)], key=key)
    q.write_archives(pages, str(tmp_path / "least"), min_bytes=5)
    assert {r.record_type for r in q.read_archives(spark, str(tmp_path / "least")).where("payload_bytes = 4").collect()} == {"response"}
    q.write_archives(pages.where("false"), str(tmp_path / "empty"))
    assert q.resolved(q.read_archives(spark, str(tmp_path / "empty"))).count() == 0
    assert len(q.train_dictionary(pages, n_pages=2)) <= 4 * 4000


def test_toxicity_risk_and_its_descent():
    """The non-negative risk written out, against what training reaches; a small sample and every direction of a feature."""
    import numpy as np

    from granary.llm import toxicity as q

    rng = np.random.default_rng(1)
    width, prior = 6, 0.3
    draw = lambda n, odds: [np.flatnonzero(rng.random(width) < odds) for _ in range(n)]
    toxic, clean = np.array([0.9, 0.6, 0.5, 0.5, 0.1, 0.5]), np.array([0.1, 0.3, 0.5, 0.5, 0.7, 0.5])
    positive = draw(200, toxic)
    unlabelled = draw(180, toxic) + draw(420, clean)

    def risk(w, bias):
        z = lambda rows: np.array([bias + w[r].sum() for r in rows])
        loss = lambda z, y: np.mean(np.log1p(np.exp(-y * z)))
        return prior * loss(z(positive), 1) + max(0.0, loss(z(unlabelled), -1) - prior * loss(z(positive), -1))

    w, bias = q.train(positive, unlabelled, prior, width)
    assert w[0] > 1 and w[4] < -1 and abs(w[2]) < abs(w[4]) / 3
    start = risk(np.zeros(width), float(np.log(prior / (1 - prior))))
    assert risk(w, bias) < start - 0.1
    assert all(risk(w, bias) <= risk(w + step, bias) + 0.01 for step in 0.3 * np.vstack([np.eye(width), -np.eye(width)]))
    kept = q.telling([r.astype(np.int64) for r in positive], [r.astype(np.int64) for r in unlabelled])
    assert 0 in kept and 4 in kept and 2 not in kept


def test_toxicity_odd_rows(spark):
    from granary.llm import toxicity as q

    rows = [(i, ("vile words here " if i % 4 == 0 else "kind words there ") + f"number{i % 9}", 0.5) for i in range(200)]
    rows += [(3, rows[3][1], 0.5), (300, "kind " * 300_000, 0.5), (301, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(0, 200, 2)] + [(0, 1, "x"), (2, None, "x"), (999, 1, "x")], "doc_id long, toxic int, text string")
    got = q.score(docs, q.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    one = {r.doc_id: r.score for r in got}
    assert one[4] > one[5] and one[300] < one[4]
    assert q.fit(docs.where("false"), labels) is None


def test_toxicity_accuracy_on_held_out_rows(spark, small):
    from granary.llm import toxicity as q

    d = small.replace("sf0.001", "sf0.1")
    said = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").collect()}
    held = [r for r in q.query(spark, d).where("held_out").collect() if said.get(r.doc_id) is not None]
    caught = [r.predicted for r in held if said[r.doc_id] == 1]
    blamed = [r.predicted for r in held if said[r.doc_id] == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(blamed) <= 0.05 * len(blamed)


def test_url_filter_bayes_by_hand(spark):
    """Learning from rules: weights and posteriors worked out by hand; the rule's own host and path aren't learnt."""
    import math

    from granary.llm import url_filter as q

    urls = ["http://good-shop.a.org/fr/news", "http://good-shop.b.org/fr/news", "http://bad-shop.x.net/win", "http://good-club.y.edu/news", "http://bad-club.y.edu/win", "http://bad-club.y.edu/win"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in q.judge(pages, learn="rules", seeds=()).collect()}
    assert [got[i].rule for i in range(6)] == ["org/fr/", "org/fr/", "net/", None, None, None]
    tokens = {0: ["h:good", "h:shop", "h:a", "p:news"], 1: ["h:good", "h:shop", "h:b", "p:news"], 2: ["h:bad", "h:shop", "h:x", "p:win"]}
    good, bad = collections.Counter(tokens[0] + tokens[1]), collections.Counter(tokens[2])
    size = len({*good, *bad, "h:club", "h:y", "h:edu"}) + 1
    weight = lambda t: math.log((bad[t] + 1) / (sum(bad.values()) + size)) - math.log((good[t] + 1) / (sum(good.values()) + size))
    for i, words in ((3, ["h:good", "h:club", "h:y", "h:edu", "p:news"]), (4, ["h:bad", "h:club", "h:y", "h:edu", "p:win"])):
        odds = math.log(2 / 3) + sum(map(weight, words))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-odds)))
    assert [got[i].verdict for i in range(6)] == ["allow", "allow", "block", "allow", "block", "block"] and got[4].score == got[5].score
    seeded = {r.page_id: r.score for r in q.judge(pages, learn="rules", seeds=("club",)).collect()}
    assert math.log(seeded[3] / (1 - seeded[3])) == pytest.approx(math.log(got[3].score / (1 - got[3].score)) + q.SEED_LOG_ODDS)


def test_url_filter_odd_rows(spark):
    from granary.llm import url_filter as q

    long = "http://" + "casinobets" * 300 + ".example.edu/x"
    urls = [long, long, "http://a.example.net/en/1", "http://example.net/en", "://", "http://", None, "http://xexample.net/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in q.judge(pages, rules=q.RULES + (("block", "example.net/en/"), ("allow", "example.edu/x"))).collect()}
    assert [got[i].rule for i in range(8)] == ["example.edu/x", "example.edu/x", "example.net/en/", "net/", None, None, None, "net/"]
    assert got[0].verdict == "allow" and got[2].verdict == "block" == q.judge(pages, rules=(("block", "example.net/en/"),) + q.RULES).where("page_id = 2").first().verdict
    assert {r.verdict for r in q.judge(pages, rules=()).where("page_id < 2").collect()} == {"block"}
    assert q.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in q.judge(pages, seeds=(), rules=()).collect()} == {"allow"}


def test_score_is_the_sum_of_marginals(odd):
    """score against all segmentations under the fitted piece scores; EM never lowers the training likelihood."""
    import math

    import numpy as np

    from granary.llm import lattice_lm as q

    path = q.default_path()
    rare, model = q.fit(odd, path, 20)
    pieces = {x: s for x, s in zip(q.lattice(path)[0].pieces, model["scores"])}

    def brute(data):
        total = [1.0] + [0.0] * len(data)
        for end in range(1, len(data) + 1):
            total[end] = sum(total[start] * math.exp(pieces[data[start:end]]) for start in range(max(0, end - 30), end) if data[start:end] in pieces)
        return total[-1]

    rows = {r.doc_id: r for r in q.score(odd, path, 20).collect()}
    for i, t in texts_of(odd):
        words = WORD.findall(t.translate(LOWER))
        if len(words) < 200 and all(len(w) < 60 for w in words):
            want = sum(math.log10(brute(b" " + w.encode())) for w in words) + model["scores"][-1] / math.log(10)
            assert rows[i].score == pytest.approx(want, rel=1e-6)
    counts = q.stored(q.word_counts(odd), "test-words")
    words = {r.word.encode(): r.n for r in counts.collect()}
    lattice, first = q.lattice(path)
    likelihood = lambda scores: float(np.dot(lattice.log_probabilities(list(words), scores), list(words.values())))
    assert likelihood(model["scores"][:-1]) > likelihood(first)


def test_byte_bpe_keeps_other_names(odd):
    from granary.llm import byte_bpe as q

    got = q.encode_documents(odd.withColumn("n_tokens", F.lit("x")), *q.default_files(), keep=["doc_id", "n_tokens", "h"])
    assert got.columns == ["doc_id", "h", "n_tokens", "ids_sha256", "decoded_sha256"] and got.where("doc_id = 1").first().n_tokens == 0


def test_pipeline_against_stages_in_plain_python(spark, small):
    """run()'s rows against the five stages written out; the quality verdict's parts have a test and SQL of their own."""
    tiktoken = pytest.importorskip("tiktoken")
    import corpus_pipeline
    from granary.llm import byte_bpe, quality_rules

    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = {r.doc_id for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [i for i in sorted(sets) if find(i) == i]
    seen, cut = set(), {}
    for i in left:
        data = texts[i].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        cut[i] = bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [i for i in left if not any(x in plain(cut[i]) for x in items)]
    path, pattern = byte_bpe.default_files()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()}
    assert len(clean) > 50 and len(left) < len(good) and got == {i: (theirs.encode_ordinary(cut[i]), hashlib.sha256(cut[i].encode()).hexdigest()) for i in clean}


def test_pipeline_stages_with_odd_rows(spark, odd, empty, small):
    import corpus_pipeline

    docs = odd.unionByName(odd.where("doc_id IN (8, 11)")).unionByName(odd.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, empty):
            got = stage(spark, rows, small)
            assert (got.columns == docs.columns or name == "byte_bpe") and got.count() <= rows.count(), name
    assert corpus_pipeline.repeated_passages(spark, docs, small).count() == docs.count()
    assert corpus_pipeline.token_ids(spark, docs, small).count() == docs.count()
