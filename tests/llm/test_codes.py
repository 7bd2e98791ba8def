"""SimHash components, periodic runs and vector codes against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, fp string, start int, label string, component_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies, periodic texts; extra columns with clashing names."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = make(400)
    texts = [None, "", " \t\n", "Äö ü\x1cx　y", "one two", "ONE Two", "x" * 5000, make(5000), "aa " * 40, "a b c d " * 30 + "a b", "  x  "]
    texts += [long, long.upper(), long + " tail", long.replace(" ", "\n", 3), "a a a a a", "a a a a a a", "b a a a a a a c a a a a a a"]
    texts += [(make(rng.randint(1, 9)) + " ") * rng.randint(2, 12) + make(rng.randint(0, 30)) for _ in range(40)]
    rows = [(i * 7 - 3, t, "x", i, "y", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[4], (None, long, "x", 1, "y", None), (None, None, "x", 1, "y", None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """The smallest key reachable over at most three differing bits, by all pairs."""
    label = {i: i for i in prints}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    keys = list(prints)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in keys}


def test_simhash_rows(odd, empty):
    from granary.llm import simhash as q

    prints = {r.doc_id: fingerprint(r.text) for r in odd.collect() if r.doc_id is not None}
    want = linked(prints)
    got = q.components(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
        else:
            assert r.component_id is None and r.fingerprint
    assert q.components(empty).count() == 0


@pytest.mark.parametrize("leaf, branch, agree", [(20000, 64, 1), (12, 4, 1), (12, 4, 2)])
def test_simhash_trees(spark, leaf, branch, agree):
    """Shards, distributed and local trees find all that all pairs find, in clusters of many fingerprints too."""
    from granary.llm import simhash as q

    rng = random.Random(agree * leaf)
    centres, prints = [rng.getrandbits(64) for _ in range(5)], {}
    for i in range(700):
        x = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9) if i % 3 else 0):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    want = linked(prints)
    first = {}
    for i, x in prints.items():
        first.setdefault(x, i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in first], "fp long")
    nodes = q.connected(q.links_of(q.split_large(q.shards(fps, agree), leaf), branch)).collect()
    back, groups = {signed(x): i for x, i in first.items()}, {}
    for r in nodes:
        groups.setdefault(r.label, set()).add(back[r.node])
    want_groups = {}
    for x, i in first.items():
        want_groups.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want_groups.values() if len(g) > 1)


def runs_by_hand(w):
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                # a smaller period explains the same stretch
                if not any(s <= i and e >= j + p and b < p for s, e, b in found):
                    found[i, j + p, p] = True
            i = max(j, i) + 1
    return sorted((s, e - s, p) for s, e, p in found)


def collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(odd, empty, plant):
    from granary.llm import periodic_runs as q

    got = sorted(q.periodic_runs(odd, plant).collect(), key=repr)
    want, periodic = [], 0
    for r in odd.collect():
        w = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if plant and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            periodic += 1
        runs = runs_by_hand(w)
        s, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        want.append((r.doc_id, len(runs), s, n, p, n and 1000 * n // p, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(collapsed(w, runs))))
    assert [tuple(r) for r in got] == sorted(want, key=lambda x: repr(type(got[0])(*x)))
    assert (periodic > 0) == plant
    assert q.periodic_runs(empty).count() == 0


def test_runs_together_and_alone():
    """Documents worked on together or one by one have the runs that a plain scan finds."""
    import numpy as np

    from granary.llm import periodic_runs as q

    rng = random.Random(8)
    docs = []
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3) if w else 0):
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            for i in range(a + p, min(len(w), a + rng.randint(1, 50))):
                w[i] = w[i - p]
        docs.append(w)
    want = [(d, *r) for d, w in enumerate(docs) for r in runs_by_hand(w)]
    for size in (1, 400):
        got = []
        for lo in range(0, len(docs), size):
            part = docs[lo : lo + size]
            offsets = np.cumsum([0] + [len(w) for w in part])
            runs = q.runs_of(np.array([x for w in part for x in w], dtype=np.int64), np.repeat(np.arange(len(part)), [len(w) for w in part]))
            for p, s, e in runs.tolist():
                d = int(np.searchsorted(offsets, s, side="right")) - 1
                got.append((lo + d, s - int(offsets[d]), e - s, p))
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("words", [[0] * 60000, ([0] * 100 + [1]) * 600, list(range(700)) * 90])
def test_runs_of_long_texts(words):
    import numpy as np

    from granary.llm import periodic_runs as q

    runs = q.runs_of(np.array(words), np.zeros(len(words), dtype=np.int64)).tolist()
    for p, s, e in runs:
        assert words[s : e - p] == words[s + p : e] and (s == 0 or words[s - 1] != words[s - 1 + p]) and (e == len(words) or words[e] != words[e - p])
    assert any(e - s == len(words) for p, s, e in runs)


def codes_by_hand(rows, rounds=4, entries=256):
    import numpy as np

    rows = sorted((r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])), key=lambda r: (r[0], r[1]))
    parts = np.split(np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64), 4, axis=1)
    books = [p[:entries].copy() for p in parts]
    measure = lambda k: ((parts[k][:, None] - books[k][None]) ** 2).sum(2)
    for _ in range(rounds):
        for k in range(4):
            at = measure(k).argmin(1)
            for j in set(at.tolist()):
                books[k][j] = [int(v) // int((at == j).sum()) for v in parts[k][at == j].sum(0)]
    d = [measure(k) for k in range(4)]
    digest = sha(",".join(str(v) for b in books for e in b.tolist() for v in e))
    errors = [int(sum(x[i].min() for x in d)) for i in range(len(rows))]
    totals = {}
    for r, e in zip(rows, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{x[i].argmin():02x}" for x in d), errors[i], totals[r[2]], digest) for i, r in enumerate(rows))


def test_vector_codes(spark, tmp_path):
    from granary.llm import vector_codes as q

    rng = random.Random(2)
    rows = [(i * 3 % 601, [round(rng.gauss(0, 0.2), 2) for _ in range(8)], rng.choice([1, 2, 2, 2, None])) for i in range(601)]
    rows += [(1000 + i, [0.5] * 8, None) for i in range(300)]
    odd = [(5000, None, 1), (5001, [None] + [0.0] * 7, 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] * 8, 1), (-5, [-float("inf")] * 8, 2), (5004, [], 1)]
    frame = spark.createDataFrame([(i, v, n, "x", "y") for i, v, n in rows + odd], "vec_id long, embedding array<double>, label int, code string, _label string")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in q.query(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == codes_by_hand(rows)
    few = spark.createDataFrame([(2, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], 1), (None, [1e30, 0.0, 0.0], 1), (3, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    codes, books = q.compress(few)
    assert sorted((r.vec_id or 0, r.label or 0) for r in codes.collect()) == [(0, 1), (2, 0), (2, 1)] and books.shape == (4, 2, 1)
    assert q.compress(few.limit(0))[0].count() == 0 and q.compress(few.where("vec_id IS NULL"))[0].count() == 0


@pytest.mark.parametrize("dims, largest", [(2, 2), (4, 60), (16, 300), (3, 1 << 26)])
def test_nearest_entries(dims, largest):
    import numpy as np

    from granary.llm import vector_codes as q

    rng = np.random.default_rng(dims)
    entries, queries = rng.integers(-largest, largest + 1, (256, dims)), rng.integers(-largest, largest + 1, (2000, dims))
    entries[100:140] = entries[7]
    d = ((queries[:, None] - entries[None]) ** 2).sum(2)
    for splits, child in ((16, 24), (3, 2)):
        at, best = q.assign(queries, q.Gnat(entries, splits=splits, child=child))
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    if dims == 2:
        far, none = np.full(2000, np.iinfo(np.int64).max), np.full(2000, np.iinfo(np.int64).max)
        assert q.Gnat(entries).nearest(queries, far, none) < 0.5 * d.size
