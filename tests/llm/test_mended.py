"""Cases that earlier rounds got wrong."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F


def test_warc_pages_that_share_an_id(spark, tmp_path):
    """A revisit has the size of the response with its payload, whatever else has that page_id; record ids are unique."""
    from granary.llm import warc as q

    pages = spark.createDataFrame([(1, "u", "aaaa"), (7, "u", "aaaa"), (7, "u", "bbbbbbbbbbbb"), (7, "v", "aaaa"), (3, "u", "bbbbbbbbbbbb"), (None, "u", "aaaa"), (None, "u", "aaaa")], "page_id long, url string, html string")
    q.write_archives(pages, str(tmp_path / "w"))
    rows = q.resolved(q.read_archives(spark, str(tmp_path / "w"))).collect()
    digest = lambda x: q.base32_sha1(hashlib.sha1(x.encode()).hexdigest())
    a, b = digest("aaaa"), digest("bbbbbbbbbbbb")
    want = [(None, 4, a, "response", None)] * 2 + [(1, 4, a, "revisit", 7), (3, 12, b, "revisit", 7), (7, 4, a, "response", None), (7, 4, a, "response", None), (7, 12, b, "response", None)]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)
    ids = []
    for r in spark.read.format("binaryFile").load(str(tmp_path / "w")).select("content").collect():
        ids += [q.parse_record(data)[0]["warc-record-id"] for magic, data in q.frames(bytes(r.content)) if magic == q.FRAME_MAGIC]
    assert len(ids) == len(set(ids)) == 7


def tokens_by_hand(text):
    import regex

    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "")
    return [x for x in regex.split(r"[^\p{L}\p{N}%°]+", regex.sub(r"(?<=[0-9])(?=[\p{L}%°])", " ", text)) if x]


def forms_by_hand(tokens):
    import regex

    from granary.llm import decontaminate as q

    out = []
    for before, x in zip(["", *tokens], tokens):
        if x[0].isdigit():
            out.append("<num>")
        elif before[:1].isdigit() and regex.fullmatch(q.UNITS, x, regex.I):
            out.append("<unit>")
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+", x) and regex.match(r"\p{Ll}", before):
            out.append("<name>")
        else:
            out.append(x.lower())
    return out


def windows_by_hand(doc, item):
    """(matched places of the item, those word for word) by all pairs of windows and the binding of most windows."""
    d, i = tokens_by_hand(doc), tokens_by_hand(item)
    df, jf = forms_by_hand(d), forms_by_hand(i)
    met = {}
    for b in range(len(i) - 7):
        for a in range(len(d) - 7):
            x, y = tuple(v.lower() for v in d[a : a + 8]), tuple(v.lower() for v in i[b : b + 8])
            pairs = set(zip(y, x))
            if df[a : a + 8] == jf[b : b + 8] and len({p for p, _ in pairs}) == len(pairs) == len({p for _, p in pairs}):
                met.setdefault((b, x), (a, pairs, x == y))
    counts = {}
    for (b, _), (a, pairs, _) in met.items():
        for pair in pairs:
            n, first, place = counts.get(pair, (set(), 10**9, 10**9))
            counts[pair] = (n | {b}, min(first, a), min(place, b))
    rank = {pair: (-len(n), a, b) for pair, (n, a, b) in counts.items()}
    bound = {p for p in rank if p[1] == min((rank[o], o[1]) for o in rank if o[0] == p[0])[1] and p[0] == min((rank[o], o[0]) for o in rank if o[1] == p[1])[1]}
    good = [(b, same) for (b, _), (_, pairs, same) in met.items() if pairs <= bound]
    return len({b for b, _ in good}), len({b for b, same in good if same})


def test_template_windows_against_all_pairs(spark):
    """Windows, slots and bindings of random templates filled in differently, against all pairs of windows."""
    pytest.importorskip("regex")
    from granary.llm import decontaminate as q

    rng = random.Random(5)
    people, places = ["Alice", "Bob", "Mary", "Susan", "John"], ["Boston", "Denver", "Paris"]
    shape = ["so {a} from {p} walks {n} km in {m} hours while {b} waits for {a} at the gate of {p} with {n} apples and then {b} tells {a} that it is late", "the train of {a} leaves {p} at {n} and it meets {b} near {q} after {m} minutes when {a} sees {q} again and again in the rain"]
    # (names after lower-case words are the slots)
    fill = lambda s: s.format(a=rng.choice(people), b=rng.choice(people), p=rng.choice(places), q=rng.choice(places), n=rng.randint(2, 9), m=rng.randint(10, 99))
    items = [(k, fill(shape[k % 2])) for k in range(4)]

    def mixed(text):
        words = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k] = rng.choice(people) if words[k] in people else rng.choice(["3", "5"]) if words[k].isdigit() else words[k]
        return " ".join(words)

    docs = [(k, rng.choice(["well ", ""]) + " then ".join(mixed(rng.choice([fill(shape[k % 2]), items[k % 4][1]])) for _ in range(rng.randint(1, 2)))) for k in range(60)]
    alice = "as we saw Alice took a long walk over the old bridge and through the park and past the small church until at last Alice came home in time for tea"
    items.append((9, alice))
    docs.append((99, alice.replace("Alice", "Mary", 1).replace("Alice", "Susan", 1)))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_verbatim) for r in q.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): windows_by_hand(x, y) for d, x in docs for i, y in items}
    assert got == {k: v for k, v in want.items() if v[0]}
    assert want[99, 9][0] < len(tokens_by_hand(alice)) - 7


def test_decontamination_by_rows(spark):
    """Rows without a doc_id and rows that share one are judged each by itself."""
    from granary.llm import decontaminate as q

    item = "a question of many words that is held word for word by some of the texts that follow here"
    clean = "nothing of the kind is said in this text which goes on for a while about something else"
    docs = spark.createDataFrame([(1, item, "x"), (1, clean, "x"), (None, item, "x"), (None, clean, "x"), (2, clean, "x")], "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = q.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, clean), (1, clean), (2, clean)]
    assert sorted(r.doc_id or 0 for r in q.judged(docs, bench).collect()) == [0, 1]


def test_long_words_in_the_lattice(monkeypatch):
    """Words beyond the bound get the sums of all segmentations and the expected counts that short ones get."""
    import numpy as np

    from granary.llm import lattice_lm as q

    rng = random.Random(3)
    pieces = [b" a", b" ab", b" ", b"b", b"c", b"bc", b"a", b"cab"]
    scores = np.log(np.array([0.2, 0.2, 0.05, 0.15, 0.1, 0.1, 0.1, 0.1]))
    own = q.Lattice(pieces)
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 7, 50, 130)] + [b"xx"]
    plain, counts = own.log_probabilities(words, scores), own.expected(words[:-1], np.arange(1.0, 6.0), scores)

    def brute(rest):
        return 1.0 if not rest else sum(np.exp(s) * brute(rest[len(p) :]) for p, s in zip(pieces, scores) if rest.startswith(p))

    assert np.allclose(np.exp(plain[:3]), [brute(b" " + w) for w in words[:3]])
    monkeypatch.setattr(q, "LONG", 0)
    monkeypatch.setattr(q, "PLACES", 5)
    assert np.allclose(own.log_probabilities(words, scores)[:-1], plain[:-1]) and own.log_probabilities(words, scores)[-1] == -np.inf
    assert np.allclose(sum(own.long_expected(b" " + w, k + 1.0, scores) for k, w in enumerate(words[:-1])), counts)


def test_a_very_long_word_needs_little_memory():
    import tracemalloc

    import numpy as np

    from granary.llm import lattice_lm as q

    own, scores = q.lattice(q.default_path())
    word = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(200_000))
    tracemalloc.start()
    got = own.log_probabilities([word], scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got[0]) and peak < 60_000_000


def test_hosts_split_like_all_segmentations():
    """The best split is the cheapest of all, and words of any length are words."""
    from granary.llm import url_filter as q

    rng = random.Random(4)
    known = {w: rng.randint(1, 30) for w in ["trackandfieldassociationsinternational", "track", "and", "field", "fields", "alpha", "bet", "al", "phabet", "ab", "cdefg", "q" * 70]}
    own = q.Splitter(known)

    def cheapest(name):
        plain, long = {0: 0.0}, {0: 0.0}
        for end in range(1, len(name) + 1):
            for start in range(end):
                word, n = name[start:end], end - start
                cost = own.costs.get(word, float("inf"))
                plain[end] = min(plain.get(end, float("inf")), plain[start] + cost)
                other = min(cost if n >= own.LONG else float("inf"), own._unknown(n) if n >= own.STRETCH else float("inf"))
                long[end] = min(long.get(end, float("inf")), long[start] + other)
        return min(plain[len(name)], long[len(name)], own.costs.get(name, own._unknown(len(name))))

    def cost(name, parts):
        return sum(own.costs.get(x, own._unknown(len(x))) for x in parts)

    names = ["".join(rng.choice([*known, "xy", "zzzzz", "bq"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    for name in names:
        parts = own.split(name)
        assert "".join(parts) == name and cost(name, parts) == pytest.approx(cheapest(name)), (name, parts)
    assert own.split("trackandfieldassociationsinternational") == ["trackandfieldassociationsinternational"]
    assert own.split("alpha" + "q" * 70) == ["alpha", "q" * 70]


def test_prior_above_one_half(spark):
    """Where most labels are toxic the estimate takes their share as it is, or the prior that is given."""
    from granary.llm import toxicity as q

    docs = spark.createDataFrame([(i, ("bad vile text " if i % 4 else "kind text ") + str(i)) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.expr("IF(doc_id % 4 = 0, 0, 1)").alias("toxic"))
    score = lambda prior: {r.doc_id: r.score for r in q.score(docs, q.fit(docs, labels, prior=prior)).collect()}
    most, few = score(None), score(0.2)
    assert sum(most[i] for i in range(400)) > sum(few[i] for i in range(400)) and min(most[i] for i in range(400) if i % 4) > 0.7
    assert q.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"))) is not None
