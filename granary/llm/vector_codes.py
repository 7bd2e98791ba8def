"""Vector code compression: product codes whose nearest entries are found by GNATs (geometric near-neighbour access trees).

Vectors become whole numbers and are cut into PARTS parts. Each part has a codebook of ENTRIES entries, at first that
part of the vectors with the smallest ids. ROUNDS times every part goes to its nearest entry, and each entry becomes the
mean of its parts, rounded down; then parts are coded by the final entries.

A codebook's GNAT has `SPLITS` entries as split points; every other entry is a child of its nearest one, and for each
pair of child and split point the smallest and largest distance are kept. A query measures its distances to the split
points; a child is left out if, for any split point, all its distances differ from the query's by more than the best
distance found so far. Bounds are rounded outwards and left out strictly, so that entries as near as the best one are
always measured; nearest entries are settled by whole squared distances, ties by the lower index. All queries of a batch
go down the tree together.

A round is one pass over the vectors: each task sums its parts by entry, so that what is shuffled are PARTS * ENTRIES
rows a task at most, and what comes to the driver is one codebook. Nothing else does.

Defined results: rows whose vector is null or holds null or non-finite components go, as do those with another length
than the vector of the smallest kept vec_id and vectors without components; lengths that PARTS doesn't divide are filled
with zeros; components beyond LARGEST are taken as LARGEST; rows that repeat a vec_id are judged each by itself, those
with the smallest vectors first in the codebooks; rows without a vec_id are coded but start no codebook, so that a table
of such rows alone gives an empty one; with fewer rows than ENTRIES a codebook has that many entries, of which equal ones
are told apart by index; an empty table gives an empty table; columns beside vec_id, embedding, label are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of whole components; squared distances stay exact in 64 bits.
LARGEST = 1 << 26
SPLITS, CHILD = 16, 24
SALTS = 16
#: Parts that are looked up together.
QUERIES = 4096


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, by queries and points."""
    largest = max((int(np.abs(x).max(initial=0)) for x in (queries, points)))
    if largest * largest * 4 * max(1, queries.shape[1]) < 1 << 53:
        a, b = queries.astype(np.float64), points.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((queries - p) ** 2).sum(1) for p in points], axis=1)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances rounded down and up."""
    d = np.sqrt(squares.astype(np.float64))
    # squares above 2**53 are rounded before the root is taken: two steps to each side hold both roundings
    return np.maximum(0, np.nextafter(np.nextafter(d, -np.inf), -np.inf)), np.nextafter(np.nextafter(d, np.inf), np.inf)


class Gnat:
    """A tree over some of a codebook's entries."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None, splits: int = SPLITS, child: int = CHILD) -> None:
        self.index = np.arange(len(entries)) if index is None else index
        self.points, self.children = entries[self.index], []
        if len(self.index) <= child or len(self.index) <= splits:
            return
        self.split = spread(self.points, splits)
        every = squared(self.points, self.points[self.split])
        nearest = every.argmin(axis=1)
        nearest[self.split] = -1
        low, high = roots(every)
        for k in range(splits):
            own = np.flatnonzero(nearest == k)
            if len(own):
                self.children.append((low[own].min(axis=0), high[own].max(axis=0), Gnat(entries, self.index[own], splits, child)))

    def nearest(self, queries: np.ndarray, best: np.ndarray, at: np.ndarray) -> int:
        """Lowers best (squared distances) and at (entries) of the queries; returns how many distances were worked out."""
        if not self.children:
            lower(queries, self.points, self.index, best, at)
            return len(queries) * len(self.points)
        measured = lower(queries, self.points[self.split], self.index[self.split], best, at)
        low, high = roots(measured)
        total = measured.size
        # children whose ranges lie nearest to the query's own distances first: they lower the bound soonest
        gaps = np.stack([np.maximum(np.maximum(low - most, least - high), 0).max(axis=1) for least, most, _ in self.children], axis=1)
        order = np.argsort(gaps, axis=1, kind="stable")
        for rank in range(len(self.children)):
            turn = order[:, rank]
            reach = roots(best)[1]
            open_ = ~(gaps[np.arange(len(queries)), turn] > reach)
            for k in np.unique(turn[open_]):
                some = np.flatnonzero(open_ & (turn == k))
                b, a = best[some], at[some]
                total += self.children[k][2].nearest(queries[some], b, a)
                best[some], at[some] = b, a
        return total


def lower(queries: np.ndarray, points: np.ndarray, index: np.ndarray, best: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Measures all points and keeps the nearest, of equally near ones that of the lowest index."""
    d = squared(queries, points)
    least = d.min(axis=1)
    first = np.where(d == least[:, None], index[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (least < best) | ((least == best) & (first < at))
    best[better], at[better] = least[better], first[better]
    return d


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points far from each other: each time the one farthest from those chosen."""
    chosen = [0]
    far = squared(points, points[:1])[:, 0]
    while len(chosen) < n:
        far[chosen] = -1
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def assign(parts: np.ndarray, tree: Gnat) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, and its squared distance."""
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.iinfo(np.int64).max)
    for lo in range(0, len(parts), QUERIES):
        tree.nearest(parts[lo : lo + QUERIES], best[lo : lo + QUERIES], at[lo : lo + QUERIES])
    return at, best


def whole(lists: pa.Array, dims: int) -> np.ndarray:
    """The vectors as whole numbers, filled up with zeros to a multiple of PARTS."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    scaled = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(scaled, ((0, 0), (0, -dims % PARTS)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of rows with a vector of finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", "embedding", "label").where(x.isNotNull() & (F.size(x) > 0) & finite)


def first_codebooks(kept: DataFrame) -> tuple[int, np.ndarray] | None:
    """The vectors' length and the codebooks (by part, entry, position) of the smallest ids; None without vectors."""
    named = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "embedding")
    head = named.limit(1).collect()
    if not head:
        return None
    dims = len(head[0].embedding)
    rows = named.where(F.size("embedding") == dims).limit(ENTRIES).select("embedding").collect()
    vectors = whole(pa.array([[float(v) for v in r.embedding] for r in rows], type=pa.list_(pa.float64())), dims)
    return dims, np.stack(np.split(vectors, PARTS, axis=1))


def trees_of(codebooks: np.ndarray) -> list[Gnat]:
    return [Gnat(c) for c in codebooks]


def moved(kept: DataFrame, dims: int, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    trees = trees_of(codebooks)
    width = codebooks.shape[2]
    sums = ", ".join(f"s{k} long" for k in range(width))

    def run(batches):
        total = np.zeros(codebooks.shape, dtype=np.int64)
        count = np.zeros(codebooks.shape[:2], dtype=np.int64)
        for batch in batches:
            vectors = whole(batch.column(0), dims)
            for part, (tree, x) in enumerate(zip(trees, np.split(vectors, PARTS, axis=1))):
                at, _ = assign(x, tree)
                np.add.at(total[part], at, x)
                count[part] += np.bincount(at, minlength=count.shape[1])
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    partial = kept.select("embedding").mapInArrow(run, f"part int, entry int, n long, {sums}")
    # a sum of whole numbers over all rows may leave 64 bits
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
    out = codebooks.copy()
    for row in added.collect():  # PARTS * ENTRIES rows at most
        out[row.part, row.entry] = [int(row[f"s{k}"]) // int(row.n) for k in range(width)]
    return out


def coded(kept: DataFrame, dims: int, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code, error by given codebooks."""
    trees = trees_of(codebooks)

    def run(batches):
        for batch in batches:
            vectors = whole(batch.column(2), dims)
            both = [assign(x, tree) for tree, x in zip(trees, np.split(vectors, PARTS, axis=1))]
            codes = np.stack([at for at, _ in both], axis=1).astype(np.uint8)
            text = [bytes(c).hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, type=pa.string()), pa.array(np.sum([d for _, d in both], axis=0))], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode("ascii")).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every kept row, and the final codebooks."""
    kept = usable(vectors)
    start = first_codebooks(kept)
    if start is None:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return empty, np.zeros((PARTS, 0, 0), dtype=np.int64)
    dims, codebooks = start
    kept = kept.where(F.size("embedding") == dims)
    for _ in range(rounds):
        codebooks = moved(kept, dims, codebooks)
    return coded(kept, dims, codebooks), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels; a label may be that of most rows, so it is dealt over SALTS tasks."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    every = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    dealt = codes.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(every, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt"))).drop("_label", "_salt", "_s")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    all_errors = with_label_errors(stored(codes, "codes"))
    return all_errors.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
