"""Removal of repeated passages by a sparse suffix array.

A byte goes when it lies in a `LENGTH`-byte string that also starts earlier (smaller doc_id, or the same document and
an earlier start). Every such string holds an anchor: the place of the smallest hash among its `LEAD`-byte strings, so
equal strings have equal anchors and only the suffixes at anchors (about 3 in 100) need sorting.

1. Anchors are scanned per document; one shuffle by the hash of their leading bytes brings equal leads together. Leads
   that occur once are certainly unique and go no further. Equal contexts (68 bytes before an anchor to 100 after) are
   pre-aggregated: all but the first of each are settled, and only the firsts of leads with several contexts are
   fetched. Leads that a bounded sample shows to be frequent are dealt over SALTS tasks and settled in two steps.
2. Splitters, whole leads from a bounded sample of documents, range-partition these suffixes by their leading tokens.
   Each bucket is sorted twice by multikey quicksort over 8-byte tokens: its suffixes, and the bytes before them from
   right to left. Bytes that neighbours have in common cut both orders into intervals for every window length.
3. A window of LENGTH bytes around an anchor is repeated where an earlier row lies in the same interval of both orders,
   that is, where its bytes are equal. The windows of one anchor all hold its lead, so the first and the last repeated
   one bound what goes. Splitters are whole leads and a lead equal to one always goes to its right, so that neighbours
   across a boundary never share a lead and no window of LENGTH bytes: comparing them can't find a repeat.
   Runs of more than RUN_ROWS suffixes aren't sorted: the earliest start of each of their windows comes from a
   map-side combined aggregation of 64-bit window hashes, which then marks the others.
4. Spans are merged per document and the other bytes hashed.

Contexts are taken for equal by a 64-bit hash beside the equal 64-bit hash of their leads.

Defined results: null and empty texts, and those shorter than LENGTH, lose nothing and repeat nothing; of equal texts
the smallest doc_id keeps its bytes; of rows that share a doc_id the one whose text sorts first counts as the earlier
one, and rows without a doc_id come after all others in the order of their texts; empty tables give empty results;
extra columns are kept by `cut` and ignored by `stripped`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import partitions_for, stored, table
from granary.llm.textbytes import WindowHasher, anchors, mix

LENGTH, LEAD = 100, 32
BEFORE = LENGTH - LEAD
#: Documents, and places of each at most, in the sample that splitters and frequent leads are taken from: at least so
#: many, or one in SAMPLE_SHARE, as buckets grow in number with the documents; the leads of all come to SAMPLE_LEADS at most.
SAMPLE_DOCS, SAMPLE_PLACES = 2000, 200
SAMPLE_SHARE, SAMPLE_LEADS = 2000, 4_000_000
#: A row of a bucket takes about 850 bytes of a task's memory, so that its longest run takes 170 MB.
ROWS_PER_BUCKET, RUN_ROWS, SALTS = 40_000, 200_000, 32
#: First occurrences of repeated windows that are shipped to the tasks, at 20 bytes each.
SHIPPED_WINDOWS = 1_000_000
#: Leads in so many documents of the sample, and in this share of them, are frequent.
FREQUENT_DOCS, FREQUENT_SHARE = 4, 0.005
#: The number of a row within its table; what the steps call key.
KEY = "_row_key"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with KEY, unique and ascending by doc_id (nulls last), then by text.

    It is the doc_id itself where that identifies a row; only otherwise rows are sorted, in ranges.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    rows = stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "rows")
    ordered = rows.orderBy(F.asc_nulls_last("doc_id"), "text", KEY).withColumn(KEY, F.monotonically_increasing_id())
    return stored(ordered, "numbered")


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)


def scan(docs: DataFrame, frequent: np.ndarray | None = None) -> DataFrame:
    """h (hash of the leading bytes), ctx (hash of the whole context), key, pos, own, salt of every anchor.

    own: the context occurred before in the same document. That settles the anchor, so it needn't meet its lead; its h
    is then one of the document, which keeps lines that fill whole documents from landing in one task. salt is -1 but
    for frequent leads (ascending hashes), which it deals over SALTS tasks.
    """
    often = docs.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint64) if frequent is None else frequent)

    def run(batches):
        hasher, hot = WindowHasher(), often.value
        for batch in batches:
            hs, cs, ids, ps, own, salts = [], [], [], [], [], []

            def flush():
                out = [np.concatenate(x) for x in (hs, cs, ids, ps, own, salts)]
                for x in (hs, cs, ids, ps, own, salts):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), pa.array(out[2]), pa.array(out[3].astype(np.int32)), pa.array(out[4]), pa.array(out[5])], names=["h", "ctx", "key", "pos", "own", "salt"])

            rows = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _bytes(text.as_py())
                if len(data) < LENGTH:
                    continue
                sums = hasher.sums(data)
                n = len(data) - LEAD + 1
                lead = mix((sums[LEAD:] - sums[:n]) * hasher.scale(n))
                at = anchors(lead, BEFORE + 1)
                start, end = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, len(data))
                context = mix((sums[end] - sums[start]) * hasher.scale(len(data))[start])
                context = mix(context ^ ((at - start) * 1000 + (end - at)).astype(np.uint64))
                again = np.ones(len(at), dtype=bool)
                again[np.unique(context, return_index=True)[1]] = False
                hs.append(np.where(again, mix(np.array([key], dtype=np.int64).view(np.uint64)), lead[at]))
                cs.append(context)
                own.append(again)
                ids.append(np.full(len(at), key, dtype=np.int64))
                ps.append(at)
                known = hot[np.searchsorted(hot, lead[at]).clip(0, len(hot) - 1)] == lead[at] if len(hot) else np.zeros(len(at), dtype=bool)
                salts.append(np.where(known & ~again, key % SALTS, -1).astype(np.int32))
                rows += len(at)
                if rows > 200_000:
                    yield flush()
                    rows = 0
            if rows:
                yield flush()

    return docs.select(KEY, "text").mapInArrow(run, "h long, ctx long, key long, pos int, own boolean, salt int")


def _marked(found: DataFrame, within: list[str]) -> DataFrame:
    """found with again (its context occurred before), several (its lead has more contexts) and long (more than RUN_ROWS)."""
    ordered, whole = Window.partitionBy(*within).orderBy("ctx", "key", "pos"), Window.partitionBy(*within)
    marked = found.withColumn("again", F.col("own") | F.lag("ctx").over(ordered).eqNullSafe(F.col("ctx"))).withColumn("several", F.min("ctx").over(whole) != F.max("ctx").over(whole))
    return marked.withColumn("long", F.sum((~F.col("again")).cast("long")).over(whole) > RUN_ROWS)


def sort_out(found: DataFrame) -> DataFrame:
    """key, and its places: settled (whole context goes), open and long (distinct contexts of leads with several).

    Leads with more than RUN_ROWS contexts are long: no task may hold their run. `hot` has the first places of each
    task's share of a frequent lead, which `settle_hot` compares with each other.
    """
    sized = _marked(found.repartition("h", "salt"), ["h", "salt", "own"])
    again, hot = F.col("again"), F.col("salt") >= 0
    kept = sized.where(again | hot | F.col("several")).select("key", "pos", "again", "long", "salt", "h", "ctx")
    places = lambda which: F.collect_list(F.when(which, F.col("pos")))
    return kept.groupBy("key").agg(places(again).alias("settled"), places(~again & ~hot & ~F.col("long")).alias("open"), places(~again & ~hot & F.col("long")).alias("long"),
                                   F.collect_list(F.when(~again & hot, F.struct("h", "ctx", "pos"))).alias("hot"))


def settle_hot(places: DataFrame) -> DataFrame:
    """places with those of frequent leads moved from `hot` into the other lists; a context has SALTS of them at most.

    A lead's contexts are counted by an aggregation; leads in `hot` come from a bounded sample, so their counts are few.
    """
    hot = places.select("key", F.explode("hot").alias("x")).select("key", "x.*")
    per_lead = hot.groupBy("h").agg(F.count_distinct("ctx").alias("contexts"))
    ordered = Window.partitionBy("h", "ctx").orderBy("key", "pos")
    sized = hot.withColumn("again", F.row_number().over(ordered) > 1).join(F.broadcast(per_lead), "h").where("again OR contexts > 1")
    again, long = F.col("again"), F.col("contexts") > RUN_ROWS
    which = {"settled": again, "open": ~again & ~long, "long": ~again & long}
    more = sized.groupBy("key").agg(*[F.collect_list(F.when(c, F.col("pos"))).alias(f"more_{x}") for x, c in which.items()])
    none = F.array().cast("array<int>")
    return places.join(more, "key", "left").select("key", *[F.concat(x, F.coalesce(f"more_{x}", none)).alias(x) for x in which])


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending leads of a bounded sample of documents, and the hashes of those frequent in it, ascending."""
    count = docs.count()
    sampled = max(SAMPLE_DOCS, count // SAMPLE_SHARE)
    places = max(1, min(SAMPLE_PLACES, SAMPLE_LEADS // sampled))
    share = min(1.0, 1.5 * sampled / max(1, count))
    some = docs.where(F.xxhash64(KEY, F.lit(3)) <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else docs

    def run(batches):
        hasher = WindowHasher()
        for batch in batches:
            leads, hashes = [], []
            for text in batch.column(0).to_pylist():
                data = _bytes(text)
                h = hasher.windows(data, LEAD)
                at = anchors(h, BEFORE + 1)
                # the places with the smallest hashes: the same leads are taken wherever they stand
                at = at[np.argsort(h[at])[:places]]
                at = at[np.unique(h[at], return_index=True)[1]]
                leads += [data[p : p + LEAD].tobytes() for p in at]
                hashes.append(h[at])
            if leads:
                yield pa.RecordBatch.from_arrays([pa.array(leads, type=pa.binary()), pa.array(np.concatenate(hashes).view(np.int64))], names=["lead", "h"])

    got = some.select("text").limit(sampled).mapInArrow(run, "lead binary, h long").toArrow()
    leads = np.sort(np.array(got["lead"].to_pylist(), dtype=f"S{LEAD}")) if len(got) else np.zeros(0, dtype=f"S{LEAD}")
    hashes, n = np.unique(got["h"].to_numpy().view(np.uint64), return_counts=True)
    return leads, hashes[n >= max(FREQUENT_DOCS, FREQUENT_SHARE * min(count, sampled))]


def splitters(leads: np.ndarray, n: int) -> np.ndarray:
    """n - 1 leads that part a sample's leads evenly."""
    return np.unique(leads[np.linspace(0, len(leads) - 1, n + 1).astype(int)[1:-1]]) if len(leads) else leads


def tokens(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte tokens (padded with zeros)."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """The order of rows of tokens: ranges are parted in three by a pivot token; the middle goes on with the next token."""
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth >= keys.shape[1]:
            continue
        own = order[a:b]
        if b - a <= 512:
            order[a:b] = own[np.lexsort(keys[own, depth:].T[::-1])]
            continue
        token = keys[own, depth]
        pivot = np.sort(token[:: len(token) // 101])[50]
        less, same = own[token < pivot], own[token == pivot]
        order[a:b] = np.concatenate([less, same, own[token > pivot]])
        todo += [(a, a + len(less), depth), (a + len(less), a + len(less) + len(same), depth + 1), (a + len(less) + len(same), b, depth)]
    return order


def common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in order has in common with the one before it (none for the first)."""
    out = np.zeros(len(order), dtype=np.int64)
    step = 20_000
    for a in range(1, len(order), step):
        x = order[a - 1 : min(len(order), a + step)]
        differs = rows[x[1:]] != rows[x[:-1]]
        out[a : a + len(x) - 1] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def repeated_windows(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of context (BEFORE bytes, then LENGTH): the least and the greatest offset of a repeated window, or -1.

    The window that starts `offset` bytes before an anchor is equal in two rows if these lie in one interval of the
    suffix order (LENGTH - offset bytes in common) and in one of the order of the bytes before, read backwards.
    """
    least, most = np.full(len(rows), -1), np.full(len(rows), -1)
    after, before = rows[:, BEFORE:], rows[:, :BEFORE][:, ::-1]
    order = multikey_quicksort(tokens(after))
    shared = common(after, order)
    # a lead that no neighbour has is unique: its row repeats nothing
    some = order[(shared >= LEAD) | np.r_[shared[1:] >= LEAD, False]]
    if not len(some):
        return least, most
    some = some[np.lexsort((pos[some], doc[some]))]
    reverse = multikey_quicksort(tokens(before))
    shared_before = common(before, reverse)
    interval, interval_before = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for offset in range(BEFORE + 1):
        interval[order] = np.cumsum(shared < LENGTH - offset)
        interval_before[reverse] = np.cumsum(shared_before < offset)
        valid = some[(left[some] >= offset) & (right[some] >= LENGTH - offset)]
        code = interval[valid] * (len(rows) + 1) + interval_before[valid]
        by_code = np.argsort(code, kind="stable")
        again = valid[by_code[1:][code[by_code[1:]] == code[by_code[:-1]]]]
        least[again[least[again] < 0]] = offset
        most[again] = offset
    return least, most


def open_suffixes(docs: DataFrame, places: DataFrame, cuts: np.ndarray) -> DataFrame:
    """bucket, key, pos, left, ctx (the bytes around) of every open place."""

    def run(batches):
        for batch in batches:
            for key, text, opens in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data = (text or "").encode("utf-8")
                at = np.array(opens, dtype=np.int64)
                leads = np.array([data[p : p + LEAD] for p in at], dtype=f"S{LEAD}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(cuts, leads, side="right").astype(np.int32)), pa.array(np.full(len(at), key, dtype=np.int64)), pa.array(at.astype(np.int32)), pa.array(np.minimum(at, BEFORE).astype(np.int32)), pa.array([data[max(0, p - BEFORE) : p + LENGTH] for p in at], type=pa.binary())],
                    names=["bucket", "key", "pos", "lft", "ctx"])

    own = docs.select(F.col(KEY).alias("key"), "text").join(places, "key").select("key", "text", "open")
    return own.mapInArrow(run, "bucket int, key long, pos int, lft int, ctx binary")


def compare(suffixes: DataFrame, n: int) -> DataFrame:
    """key, a, b: the spans that a bucket's two orders show to be repeats."""

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        doc, pos, left = (t[x].to_numpy().astype(np.int64) for x in ("key", "pos", "lft"))
        ctx = t["ctx"].to_pylist()
        rows = np.zeros((len(ctx), BEFORE + LENGTH), dtype=np.uint8)
        size = np.array([len(x) for x in ctx], dtype=np.int64)
        for i, x in enumerate(ctx):
            rows[i, BEFORE - left[i] : BEFORE - left[i] + len(x)] = np.frombuffer(x, dtype=np.uint8)
        least, most = repeated_windows(rows, left, size - left, doc, pos)
        hit = np.flatnonzero(least >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((pos[hit] - most[hit]).astype(np.int32)), pa.array((pos[hit] + LENGTH - least[hit]).astype(np.int32))], names=["key", "a", "b"])

    return suffixes.repartitionById(n, F.col("bucket")).mapInArrow(run, "key long, a int, b int")


def windows_of(docs: DataFrame, places: DataFrame, firsts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """w (hash of the window's bytes), key, pos, start of every window of LENGTH bytes around every long place.

    With firsts (ascending hashes of repeated windows, keys and starts of their first occurrences) only key, a, b: each
    place's span from its first to its last window that occurs before.
    """
    known = docs.sparkSession.sparkContext.broadcast(firsts)

    def run(batches):
        hasher, own = WindowHasher(), known.value
        for batch in batches:
            for key, text, opens in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data = _bytes(text)
                sums, every = hasher.sums(data), np.sort(np.array(opens, dtype=np.int64))
                for k in range(0, len(every), 2000):
                    at = np.repeat(every[k : k + 2000], BEFORE + 1)
                    start = at - np.tile(np.arange(BEFORE + 1), len(at) // (BEFORE + 1))
                    fits = (start >= 0) & (start + LENGTH <= len(data))
                    at, start = at[fits], start[fits]
                    h = hasher.of(sums, start, LENGTH)
                    if own is None:
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(at), key, dtype=np.int64)), pa.array(at.astype(np.int32)), pa.array(start.astype(np.int32))], names=["w", "key", "pos", "start"])
                        continue
                    place = np.searchsorted(own[0], h).clip(0, len(own[0]) - 1)
                    again = (own[0][place] == h) & ((own[1][place] != key) | (own[2][place] != start))
                    spots, first = np.unique(at[again], return_index=True)
                    if len(spots):
                        # starts descend with the offset, so a place's last hit in order is its earliest window
                        last = np.append(first[1:], again.sum()) - 1
                        hits = start[again]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spots), key, dtype=np.int64)), pa.array(hits[last].astype(np.int32)), pa.array((hits[first] + LENGTH).astype(np.int32))], names=["key", "a", "b"])

    own = docs.select(F.col(KEY).alias("key"), "text").join(places, "key").select("key", "text", "long")
    return own.mapInArrow(run, "w long, key long, pos int, start int" if firsts is None else "key long, a int, b int")


def compare_long(docs: DataFrame, places: DataFrame, shipped: int = SHIPPED_WINDOWS) -> DataFrame:
    """key, a, b: the spans that the long runs show to be repeats, by aggregations in place of sorted runs.

    What many rows share is few windows: the first occurrences of repeated ones are shipped to the tasks up to a
    counted bound, and beyond it joined.
    """
    windows = windows_of(docs, places)
    firsts = stored(windows.groupBy("w").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("w", "first.*"), "firsts")
    if firsts.count() <= shipped:
        t = firsts.toArrow()
        w = t["w"].to_numpy().view(np.uint64)
        order = np.argsort(w)
        if not len(order):
            return windows.select("key", F.col("pos").alias("a"), F.col("pos").alias("b")).where("false")
        return windows_of(docs, places, (w[order], t["key"].to_numpy()[order], t["start"].to_numpy().astype(np.int64)[order]))
    # a window may be in a third of all documents: its rows are dealt over SALTS tasks
    salted = firsts.select("w", F.col("key").alias("k1"), F.col("start").alias("s1"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    again = dealt.join(salted, ["w", "salt"]).where((F.col("key") != F.col("k1")) | (F.col("start") != F.col("s1")))
    return again.groupBy("key", "pos").agg(F.min("start").alias("a"), (F.max("start") + LENGTH).cast("int").alias("b")).select("key", "a", "b")


def removals(docs: DataFrame) -> DataFrame:
    """key, settled (places whose contexts go), a and b (starts and ends of further spans); docs has KEY and text."""
    leads, frequent = sample(docs)
    places = stored(sort_out(scan(docs, frequent)), "places")
    total, in_long, in_hot = (x or 0 for x in places.agg(F.sum(F.size("open")), F.sum(F.size("long")), F.sum(F.size("hot"))).first())
    if in_hot:
        places = stored(settle_hot(places), "places")
        total, in_long = (x or 0 for x in places.agg(F.sum(F.size("open")), F.sum(F.size("long"))).first())
    n = partitions_for(total, ROWS_PER_BUCKET)
    some = places.where(F.size("open") > 0).select("key", "open")
    spans = compare(open_suffixes(docs, some, splitters(leads, n)), n)
    if in_long:
        spans = spans.unionByName(compare_long(docs, places.where(F.size("long") > 0).select("key", "long")))
    per_doc = spans.groupBy("key").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return places.select("key", "settled").join(per_doc, "key", "full")


def merged(size: int, settled: list[int] | None, a: list[int] | None, b: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans to remove: starts and ends."""
    at = np.array(settled or [], dtype=np.int64)
    start = np.concatenate([np.maximum(at - BEFORE, 0), np.array(a or [], dtype=np.int64)])
    end = np.concatenate([np.minimum(at + LENGTH, size), np.array(b or [], dtype=np.int64)])
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.zeros(0, dtype=bool)
    return start[new], end[np.r_[new[1:], True]] if len(end) else end


def _cut(docs: DataFrame, with_text: bool) -> DataFrame:
    """KEY, doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of a numbered table, and with with_text the bytes that are left."""

    def run(batches):
        for batch in batches:
            out = []
            for text, settled, a, b in zip(*[batch.column(i).to_pylist() for i in range(2, 6)]):
                data = (text or "").encode("utf-8")
                start, end = merged(len(data), settled, a, b)
                kept = data if not len(start) else b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
                out.append([len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest()] + [kept] * with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            names = [KEY, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)]], names=names)

    gone = removals(docs).withColumnRenamed("key", KEY)
    both = docs.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), "text").join(gone, KEY, "left").select(KEY, "doc_id", "text", "settled", "a", "b")
    return both.mapInArrow(run, f"{KEY} long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def stripped(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _cut(numbered(docs.select("doc_id", "text")), False).drop(KEY)


def cut(docs: DataFrame, text_of: Callable[[Column], Column], sizes: tuple[str, ...] = ()) -> DataFrame:
    """docs with what repeats taken out of text; text_of makes a text of the bytes left. All rows and columns stay.

    The columns of `sizes` get the new text's length where it changed.
    """
    rows = numbered(docs)
    kept = _cut(rows, True).where("n_removed > 0").select(F.col(KEY).alias("_cut_key"), text_of(F.col("kept")).alias("_cut_text"))
    joined = rows.join(kept, rows[KEY] == kept["_cut_key"], "left")
    changed, text = kept["_cut_key"].isNotNull(), kept["_cut_text"]
    new = {"text": F.when(changed, text).otherwise(rows["text"])} | {c: F.when(changed, F.length(text).cast("long")).otherwise(rows[c]) for c in sizes}
    return joined.select(*[new[c].alias(c) if c in new else rows[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripped(table(spark, sf_dir, "documents"))
