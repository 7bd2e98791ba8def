"""Near duplicates by SimHash, exact within RADIUS differing bits, by vantage-point trees.

1. A text's fingerprint has each bit that is set in over half of the XXH64 values of its 3-word shingles. Texts with
   equal fingerprints are one class; only classes are compared.
2. The forest's roots: fingerprints within RADIUS bits agree wholly in `agree` of RADIUS + agree blocks of bits, so for
   each choice of blocks there is a tree whose first level splits by the distance in these blocks alone, with bound 0:
   shards of equal blocks, which overlap nowhere. (A tree over whole fingerprints alone visits 3 of 4 children at each
   level, since distances of unrelated fingerprints lie near 32 and the bounds are RADIUS to each side.)
3. A shard of more than `leaf` fingerprints is split by Spark: a vantage point is drawn, a histogram of at most 65
   distances gives the radius, and fingerprints go inside or outside. Those on the boundary are copied to the other side
   as guests, which meet the residents there but not each other. Levels repeat until no shard has more residents.
4. A shard is searched in one task by a tree in memory, for all its residents at once: triangle bounds leave out the
   branches that can't hold a partner. What comes out are spanning trees of its links, of 17 edges a node at most, so
   that thousands of near copies make neither pairs nor hubs.
5. Links of all shards are joined to components by label propagation.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts with fewer than three
words are one shingle; rows that repeat a doc_id are judged each by itself; rows without a doc_id get their fingerprint
and no component, and name none; ties don't arise, as components are named by their smallest doc_id; an empty table gives
an empty table; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from granary.llm.common import lower_ascii, stored, table, words_of
from granary.llm.minhash import connected

SHINGLE, RADIUS = 3, 3
#: Residents that a shard may have before Spark splits it, and those that a branch may have before a task compares them one by one.
LEAF, BRANCH = 20_000, 64
#: Groups up to this size are compared without a tree.
FEW = 32
#: Fingerprints that two agreeing blocks of five are used from, in place of one of four.
MANY = 1 << 28
SALTS = 16
#: Shingle hashes that a task turns into fingerprints at once.
HASHES = 1 << 20


def with_hashes(docs: DataFrame) -> DataFrame:
    """doc_id and h, the 64-bit hashes of all shingles, repeats included."""
    text = F.col("text")
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    words, n = F.col("_words"), F.size("_words")
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, SHINGLE)])))
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    hashes = F.when(n >= SHINGLE, windows).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return docs.select("doc_id", words_of(lowered).alias("_words")).select("doc_id", hashes.alias("h"))


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of every run of hashes; zero for empty ones."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for bit in range(64):
            ones = np.add.reduceat((flat >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
            out[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            blocks = np.cumsum(sizes) // HASHES
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)]):
                flat = lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(majority(flat, sizes[lo:hi]).view(np.int64))], names=["doc_id", "fp"])

    return with_hashes(docs).mapInArrow(run, "doc_id long, fp long")


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def root_masks(agree: int) -> list[int]:
    """The bits of every choice of `agree` blocks among RADIUS + agree, as signed 64-bit numbers."""
    n = RADIUS + agree
    ends = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(blocks, agree)]


def shards(fps: DataFrame, agree: int) -> DataFrame:
    """shard, fp, home: every fingerprint once at the root of each tree.

    Shards are named by hashes. Where two had the same name they would be searched as one, with the same result.
    """
    roots = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))) for t, mask in enumerate(root_masks(agree))])
    return fps.select(F.explode(roots).alias("shard"), "fp").withColumn("home", F.lit(True))


def split_large(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The rows with shards of more than `leaf` residents split by vantage points, level by level."""
    done, at = [], rows
    while True:
        counted = at.where("home").groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("vantage"))
        large = stored(counted.where(F.col("n") > leaf), "large-shards")
        if large.isEmpty():
            for part in done:
                at = at.unionByName(part)
            return at
        done.append(at.join(large, "shard", "left_anti"))
        far = stored(at.join(large, "shard").select("shard", "fp", "home", "n", distance("fp", "vantage").alias("d")), "distances")
        histogram = far.where("home").groupBy("shard", "n", "d").agg(F.count("*").alias("c"))
        below = histogram.withColumn("below", F.sum("c").over(Window.partitionBy("shard").orderBy("d")))
        # at least one distance stays inside and one outside, since the vantage point has distance 0 alone
        bounds = below.groupBy("shard").agg(F.coalesce(F.max(F.when(2 * F.col("below") <= F.col("n"), F.col("d"))), F.min("d")).alias("mu"))
        home, d, mu = F.col("home"), F.col("d"), F.col("mu")
        inside = F.when(d <= F.when(home, mu).otherwise(mu + RADIUS), F.struct(F.lit(0).alias("side"), home.alias("home")))
        over = F.when(home & (d > mu) & (d <= mu + RADIUS), F.struct(F.lit(0).alias("side"), F.lit(False).alias("home")))
        outside = F.when(d > F.when(home, mu).otherwise(mu - RADIUS), F.struct(F.lit(1).alias("side"), home.alias("home")))
        dealt = far.join(bounds, "shard").select("shard", "fp", F.explode(F.array_compact(F.array(inside, over, outside))).alias("x"))
        at = stored(dealt.select(F.xxhash64("shard", "x.side").alias("shard"), "fp", F.col("x.home").alias("home")), "shards")


def compare(fp: np.ndarray, homes: np.ndarray, guests: np.ndarray, label: np.ndarray) -> None:
    """Joins the labels of rows that links of these residents connect; homes and guests are places in fp and label."""
    every = np.concatenate([homes, guests])
    near = np.bitwise_count(fp[homes][:, None] ^ fp[every][None, :]) <= RADIUS
    near[np.arange(len(homes)), np.arange(len(homes))] = False
    met = np.flatnonzero(near.any(axis=1))
    todo = set(met.tolist())
    while todo:
        reached = np.zeros(len(every), dtype=bool)
        queue = [todo.pop()]
        while queue:
            i = queue.pop()
            reached[i] = True
            fresh = near[i] & ~reached
            reached |= fresh
            # a guest or resident that several residents are near joins these
            beside = np.flatnonzero(near[:, fresh].any(axis=1)) if fresh.any() else ()
            for k in beside:
                if k in todo:
                    todo.discard(k)
                    queue.append(k)
        members = every[reached]
        roots = np.unique(label[members])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]


def search(fp: np.ndarray, home: np.ndarray, branch: int = BRANCH) -> np.ndarray:
    """Labels of one shard's distinct rows, equal where links with its residents connect them, by a vantage-point tree."""
    label = np.arange(len(fp))
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        h, g = stack.pop()
        if not len(h) or len(h) + len(g) < 2:
            continue
        if len(h) <= branch:
            compare(fp, h, g, label)
            continue
        vantage = fp[h[len(h) // 2]]
        dh, dg = np.bitwise_count(fp[h] ^ vantage).astype(int), np.bitwise_count(fp[g] ^ vantage).astype(int)
        mu = min(int(np.median(dh)), int(dh.max()) - 1)
        inside = dh <= mu
        # triangle inequality: partners of what is inside have distances up to mu + RADIUS, of what is outside over mu - RADIUS
        stack.append((h[inside], np.concatenate([h[~inside & (dh <= mu + RADIUS)], g[dg <= mu + RADIUS]])))
        stack.append((h[~inside], g[dg > mu - RADIUS]))
    return label


def spanning(fp: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all rows of a label: the k-th row with the ((k - 1) // 16)-th."""
    order = np.argsort(label, kind="stable")
    lab = label[order]
    first = np.flatnonzero(np.r_[True, lab[1:] != lab[:-1]])
    start = np.repeat(first, np.diff(np.r_[first, len(lab)]))
    rank = np.arange(len(lab)) - start
    child = np.flatnonzero(rank)
    return fp[order[child]], fp[order[start[child] + (rank[child] - 1) // 16]]


def shard_links(shard: np.ndarray, fp: np.ndarray, home: np.ndarray, branch: int = BRANCH) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect, for whole shards that stand together."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    size = np.diff(np.r_[first, len(shard)])
    each = np.repeat(size, size)
    left, right = [], []
    for k in range(1, FEW):
        at = np.flatnonzero((each[k:] <= FEW) & (shard[k:] == shard[:-k]))
        if not len(at):
            break
        at = at[(home[at] | home[at + k]) & (np.bitwise_count(fp[at] ^ fp[at + k]) <= RADIUS)]
        left.append(fp[at])
        right.append(fp[at + k])
    for lo, n in zip(first[size > FEW], size[size > FEW]):
        # a fingerprint may stand twice in a shard, as a resident and as a guest by another way; once is enough
        some, at = np.unique(fp[lo : lo + n], return_index=True)
        here = np.zeros(len(some), dtype=bool)
        here[np.searchsorted(some, fp[lo : lo + n][home[lo : lo + n]])] = True
        a, b = spanning(some, search(some, here, branch))
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def links_of(rows: DataFrame, branch: int = BRANCH) -> DataFrame:
    """a, b: links within the shards, enough of them to connect what all links connect."""

    def run(batches):
        rest = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            part = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[last:] for x in part]
            yield made(*[x[:last] for x in part])
        if rest is not None:
            yield made(*rest)

    def made(shard, fp, home):
        a, b = shard_links(shard, fp, home, branch) if len(shard) else (fp, fp)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def salt_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def components(docs: DataFrame, leaf: int = LEAF, branch: int = BRANCH, agree: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = stored(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    classes = stored(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    agree = agree or (1 if classes.count() < MANY else 2)
    links = stored(links_of(split_large(shards(classes.select("fp"), agree), leaf), branch), "links")
    labels = connected(links).withColumnRenamed("node", "fp")
    lowest = labels.join(classes, "fp").groupBy("label").agg(F.min("first").alias("common"))
    linked = labels.join(lowest, "label").select("fp", "common")
    # a class of one document is found by that document's salt, larger ones, maybe a third of all rows, by any
    salts = F.when(F.col("n") == 1, F.array(salt_of(F.col("first")))).otherwise(F.array(*[F.lit(i) for i in range(SALTS)]))
    heads = classes.join(linked, "fp", "left").select("fp", F.coalesce("common", "first").alias("component_id"), F.explode(salts).alias("salt"))
    named = rows.withColumn("salt", salt_of(F.col("doc_id"))).join(heads, ["fp", "salt"], "left")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
