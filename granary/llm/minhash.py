"""Near duplicates by b-bit MinHash.

1. Every text becomes its set of 64-bit hashes of 5-word shingles. Texts with equal sets, by their sizes and two
   independent 64-bit hashes of the whole set, are one class.
2. A class representative gets `PERMUTATIONS` minima. Bands of `ROWS` minima are hashed to bucket keys; of each
   minimum, the two lowest bits are kept in bit planes, so that a signature is four longs.
3. Candidates are pairs of one bucket. Their similarity is estimated from bit counts, corrected for chance agreement
   (a quarter of all minima agree by accident); pairs far below the bound are dropped, the others are confirmed by
   exact intersection of their full sets.
4. Links are joined to components by label propagation.

Buckets may hold a third of all texts, so their pairs are never listed. In a first round every member is only paired
with its bucket's smallest member, which joins a group of copies in a few components. In a second round the members of
buckets that still hold several components are compared block against block; only links come out, and no member is
dropped.

A pair of similarity 0.85 shares a bucket with probability 1 - (1 - 0.85^5)^25 > 0.9999995.

Defined results: null and empty texts have empty sets and are linked with nothing; texts with fewer than five words
have one shingle, all their words; repeated rows and equal texts form one component, named by its smallest doc_id; an
empty table gives an empty table; columns beside doc_id and text are kept by `keep_first` and ignored by `components`.
`keep_first` returns one row of each doc_id that stays, and all rows without a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lower_ascii, remove_path, scratch_path, stored, table, words_of
from granary.llm.textbytes import mix

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 25, 5
PERMUTATIONS, PLANES = BANDS * ROWS, 2
#: Standard deviations of the estimate that a pair may lie below the bound and still be confirmed exactly.
MARGIN = 5
#: Blocks of 2**BLOCK_BITS sets are compared with each other.
BLOCK_BITS = 8
#: Tasks that the members of a class of equal texts are dealt over.
SALTS = 16
#: Makes the second hash of a set independent of the first.
CHECK = np.uint64(0x5851F42D4C957F2D)
_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(1, 2**63 - 1, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63 - 1, size=PERMUTATIONS, dtype=np.uint64)


def with_shingles(docs: DataFrame) -> DataFrame:
    """doc_id and sh, the distinct 64-bit hashes of the text's shingles (an array; empty without words)."""
    text = F.col("text")
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    words, n = F.col("_words"), F.size("_words")
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    sets = F.when(n >= SHINGLE, F.array_distinct(windows)).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    # the words are a column of their own: inside the lambda an expression would be worked out for each word
    return docs.select("doc_id", words_of(lowered).alias("_words")).select("doc_id", sets.alias("sh"))


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The smallest permuted hash of every set (rows) under every permutation (columns); sets aren't empty."""
    out = np.empty((len(starts), PERMUTATIONS), dtype=np.uint32)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat(((flat * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (a column for each band) and the packed low bits: two longs for each plane."""
    keys = np.zeros((len(least), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        h = np.full(len(least), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            h = mix(h ^ least[:, k].astype(np.uint64))
        keys[:, band] = h
    planes = []
    for p in range(PLANES):
        bits = np.zeros((len(least), 128), dtype=np.uint8)
        bits[:, :PERMUTATIONS] = (least >> np.uint32(p)) & np.uint32(1)
        planes.append(np.packbits(bits, axis=1).view(np.int64))
    return keys.view(np.int64), np.concatenate(planes, axis=1)


def agreement_bound(percent: int = PERCENT) -> int:
    """The least number of agreeing minima that a pair at the bound reaches but for MARGIN standard deviations."""
    chance = 0.5**PLANES
    p = percent / 100 * (1 - chance) + chance
    return int(PERMUTATIONS * p - MARGIN * np.sqrt(PERMUTATIONS * p * (1 - p)))


def agreements(a: str, b: str) -> Column:
    """Agreeing minima of two signatures: bit counts of what differs in no plane."""
    differs = lambda half: F.bit_count(F.col(f"{a}.s0{half}").bitwiseXOR(F.col(f"{b}.s0{half}")).bitwiseOR(F.col(f"{a}.s1{half}").bitwiseXOR(F.col(f"{b}.s1{half}"))))
    return F.lit(PERMUTATIONS) - differs(0) - differs(1)


def estimated_similarity(agreeing: Column) -> Column:
    chance = 0.5**PLANES
    return (agreeing / PERMUTATIONS - chance) / (1 - chance)


SIGNATURE = ["s00", "s01", "s10", "s11"]


def with_signatures(sets: DataFrame) -> DataFrame:
    """doc_id, size, set_hash, set_check, keys and signature of every row of (doc_id, sh); the sets themselves are left behind."""
    schema = "doc_id long, size int, set_hash long, set_check long, keys array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            for at in range(0, len(lists), 2000):
                part = lists.slice(at, 2000)
                sizes = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                full = np.flatnonzero(sizes > 0)
                starts = (np.cumsum(sizes) - sizes)[full]
                hashed, checked, keys, sig = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), [[] for _ in sizes], np.zeros((len(sizes), 4), dtype=np.int64)
                if len(full):
                    mixed = mix(flat)
                    hashed[full] = (np.add.reduceat(mixed, starts) ^ mix(np.add.reduceat(mix(mixed), starts))).view(np.int64)
                    checked[full] = np.add.reduceat(mix(flat ^ CHECK), starts).view(np.int64)
                    found, sig[full] = signatures(minima(mixed, starts))
                    for i, row in zip(full, found.tolist()):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 2000), pa.array(sizes.astype(np.int32)), pa.array(hashed), pa.array(checked), pa.array(keys, type=pa.list_(pa.int64())), *[pa.array(sig[:, k]) for k in range(4)]],
                    names=["doc_id", "size", "set_hash", "set_check", "keys", *SIGNATURE])

    return sets.select("doc_id", "sh").mapInArrow(run, schema)


def pairs_with(buckets: DataFrame, pivot: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a < b) of each bucket member with its bucket's pivot, if their estimate allows."""
    joined = buckets.alias("x").join(pivot.alias("p"), "key")
    close = (F.col("x.doc_id") != F.col("p.doc_id")) & (agreements("x", "p") >= agreement_bound(percent))
    return joined.where(close).select(F.least("x.doc_id", "p.doc_id").alias("a"), F.greatest("x.doc_id", "p.doc_id").alias("b"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs whose full shingle sets are as similar as asked; texts has doc_id and text."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = with_shingles(texts.join(wanted, "doc_id", "left_semi"))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", same.alias("i"), (F.size("sa") + F.size("sb")).alias("t")).where(F.col("i") * 100 >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def connected(links: DataFrame, name: str = "labels") -> DataFrame:
    """node, label (the smallest node reachable) of every node that has a link.

    Each round a node takes the smallest label among its neighbours', and then its label's label, so that long chains
    shorten fast; rounds end when no label changes. Labels are written to the shared folder after each round, and those
    of the round before deleted. A hub's rows are one side of a join of two shuffles, which adaptive execution splits.
    """
    spark = links.sparkSession
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels, last = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), name), None
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "m").alias("l"))
        jumps = labels.select(F.col("node").alias("l"), F.col("label").alias("j"))
        path = scratch_path(spark, name)
        lower.join(jumps, "l", "left").select("node", "label", F.least("l", F.coalesce("j", "l")).alias("new")).write.parquet(path)
        new = spark.read.schema("node long, label long, new long").parquet(path)
        if last:
            remove_path(spark, last)
        changed, last = new.where("new < label").limit(1).count(), path
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def links_and_labels(reps: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, label of representatives that are linked with others."""
    keyed = reps.select("doc_id", *SIGNATURE, F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    members = buckets.select("key", "doc_id", *SIGNATURE)
    pivots = buckets.where(F.col("doc_id") == F.col("first")).select("key", "doc_id", *SIGNATURE)
    tried = stored(pairs_with(members, pivots, percent).distinct(), "pairs")
    links = stored(confirm(tried, texts, percent), "links")
    labels = connected(links).select(F.col("node").alias("doc_id"), "label")
    own = members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("m")).where("lo < hi").select("key", "m")
    left_open = stored(own.join(mixed, "key").select("doc_id", "label", "m", *SIGNATURE), "open")
    more = across_components(left_open, texts, percent)
    return connected(links.union(more)).select("node", "label")


def across_components(left_open: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links between members of different components that share buckets, directly or over others.

    Buckets that hold several components form clusters. A cluster's members, ordered by component, are cut into blocks
    of 2**BLOCK_BITS; every two blocks meet in one cell, unless both hold the same component alone. A cell is a task of its own
    with at most two blocks' sets, whatever the size of the cluster, and returns links only, never pairs.
    """
    clusters = connected(left_open.select(F.col("doc_id").alias("a"), F.col("m").alias("b")).distinct(), "clusters").withColumnRenamed("label", "cluster")
    once = left_open.drop("m").distinct().join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
    dealt = once.repartitionByRange("cluster", "label", "doc_id").sortWithinPartitions("cluster", "label", "doc_id")
    # the id counts up in each partition from a multiple of 2**33, so its upper bits name a block
    blocks = stored(dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "blocks")
    ends = blocks.groupBy("cluster", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = ends.alias("x"), ends.alias("y")
    same = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
    cells = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & ~same).select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("b1"), F.col("y.block").alias("b2"))
    sides = cells.select("cluster", "b1", "b2", F.col("b1").alias("block")).union(cells.where("b1 < b2").select("cluster", "b1", "b2", F.col("b2").alias("block")))
    sets = with_shingles(texts.join(blocks.select("doc_id"), "doc_id", "left_semi")).select("doc_id", F.sort_array("sh").alias("sh"))
    full = blocks.join(sets, "doc_id")
    bound = agreement_bound(percent)

    def compare(pdf):
        found = []
        label, block = pdf["label"].to_numpy(), pdf["block"].to_numpy()
        sig = pdf[SIGNATURE].to_numpy().astype(np.int64).view(np.uint64)
        sh, ids = [np.asarray(v) for v in pdf["sh"]], pdf["doc_id"].to_numpy()
        size = np.array([len(v) for v in sh])
        other = (block != block[0]).any()
        words, codes = np.unique(np.concatenate(sh), return_inverse=True)
        ends = np.cumsum(size)

        def marked(members):
            """Which of the joined sets' elements are members."""
            mark = np.zeros(len(words), dtype=bool)
            mark[np.searchsorted(words, members)] = True
            return mark[codes]

        for i in range(len(ids)):
            apart = (label != label[i]) & (np.arange(len(ids)) > i)
            if other:
                apart &= block != block[i]
            apart &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            js = np.flatnonzero(apart)
            if not len(js):
                continue
            differs = sum(np.bitwise_count((sig[js, h] ^ sig[i, h]) | (sig[js, 2 + h] ^ sig[i, 2 + h])).astype(int) for h in (0, 1))
            js = js[PERMUTATIONS - differs >= bound]
            if len(js):
                # exact sizes of all intersections with set i: members of i are looked up in the cell's joined sets
                hits = np.concatenate([[0], np.cumsum(marked(sh[i]))])
                common = hits[ends[js]] - hits[ends[js] - size[js]]
                for j in js[100 * common >= percent * (size[i] + size[js] - common)]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return type(pdf)(found, columns=["a", "b"])

    return full.join(sides, ["cluster", "block"]).groupBy("cluster", "b1", "b2").applyInPandas(compare, "a long, b long")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document."""
    texts = docs.select("doc_id", "text")
    sigs = stored(with_signatures(with_shingles(texts)), "signatures")
    same = ["set_hash", "set_check", "size"]
    full = sigs.where("size > 0")
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    labels = links_and_labels(reps, texts, percent).select(F.col("node").alias("rep"), "label")
    # most documents are alone with their set: they find their label by doc_id. Members of larger classes, maybe a third
    # of all rows, find theirs by the set, dealt over SALTS tasks
    shared = classes.where("n > 1").join(labels, "rep", "left").select(*same, F.coalesce("label", "rep").alias("common")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = sigs.select("doc_id", *same).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # texts without a shingle share no set; each goes by its own id
    dealt = dealt.withColumn("set_hash", F.when(F.col("size") > 0, F.col("set_hash")).otherwise(F.xxhash64("doc_id")))
    got = dealt.join(shared, [*same, "salt"], "left").join(labels, dealt["doc_id"] == labels["rep"], "left")
    component = F.coalesce("common", "label", "doc_id")
    return got.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each doc_id: of repeated rows the one whose text, then whose other columns sort first, nulls last."""
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return docs
    row = F.struct(*docs.columns)
    order = F.struct(F.col("text").isNull(), F.col("text"), F.to_json(row))
    some = docs.join(repeated, docs["doc_id"] == repeated["_id"], "left_semi")
    firsts = some.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return docs.join(repeated, docs["doc_id"] == repeated["_id"], "left_anti").unionByName(firsts)


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which no near copy has a smaller doc_id, one row of each; rows without a doc_id all stay."""
    named = one_row_each(docs.where(F.col("doc_id").isNotNull()))
    kept = components(named, percent).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return named.join(kept, named["doc_id"] == kept["_kept_id"], "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
