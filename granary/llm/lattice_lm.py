"""Language-model scoring by subword lattices.

The pieces of an existing public vocabulary are the arcs of a lattice over each word; a piece's score is its unigram
log probability. A forward recursion in log space sums the weights of all segmentations, so that a word's score is its
marginal probability and not that of one best split. The installed vocabulary orders its pieces by merge ranks and has
no unigram probabilities, so these are fitted to it once per corpus: expectation maximisation over all distinct
training words, weighted by their counts. `score` is the sum of these marginals over a document's words and one end
token. `mixed_score`, a further column, adds one more segmentation to each lattice, the
whole training word with its discounted relative frequency, which leaves the lattice the mass of what is rare or new.

Word counts come from all training documents by a map-side combined aggregation. The `MAX_WORDS` most frequent words
(a fixed bound, whatever the input) are shipped to the workers as hashes and counts; all other words of a document are
joined to the count table. Lattices are computed for many words at once, column by column, in numpy. A word of more than
LONG bytes is worked on alone, in blocks of places, with one or two numbers for each of its bytes.

Defined results: null and empty texts are one end token; texts without white space are one long word; repeated
rows are scored alike; without training rows counts are 0 and the pieces keep their initial scores; an empty table
gives an empty table; columns beside doc_id and text are ignored. doc_id identifies a row.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold_of, lower_ascii, stored, table, vocabulary_file, words_of
from granary.llm.textbytes import WindowHasher

FOLDS, HELD_OUT = 10, 0
#: Bytes beyond which a word is worked on alone, and the places that it is cut at then.
LONG, PLACES = 1 << 12, 1 << 15
MAX_WORDS = 300_000
#: Rounds of expectation maximisation, each on all training words.
EM_ROUNDS = 4
#: Taken off the count of every training word; the mass that this frees goes through the lattice (absolute discounting).
DISCOUNT = 0.75
SMOOTH = 0.1
LOG10 = float(np.log(10.0))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def read_pieces(path: str) -> dict[bytes, int]:
    """The byte strings of a sentencepiece vocabulary with their places; a word's first piece begins with a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            data = bytes([int(piece[3:5], 16)])
        elif model.is_control(i) or model.is_unknown(i):
            continue
        else:
            data = piece.replace("\u2581", " ").encode("utf-8")
        if b" " not in data[1:] and data.lower() == data:
            out.setdefault(data, i)
    return out


class Lattice:
    """All segmentations of words into pieces."""

    FILTER_BITS = 20

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.hasher = WindowHasher()
        self.tables = {}
        for n in sorted({len(p) for p in pieces}):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            hashes = self.hasher.windows(np.frombuffer(b"".join(pieces[i] for i in own), dtype=np.uint8), n)[::n]
            order = np.argsort(hashes)
            maybe = np.zeros(1 << self.FILTER_BITS, dtype=bool)
            maybe[(hashes >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)] = True
            self.tables[n] = hashes[order], np.array(own)[order], maybe

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Sizes of the words (each after a space), and their arcs: (end, length, rows, pieces), ascending by end."""
        data = np.frombuffer(b" " + b" ".join(words), dtype=np.uint8)
        sizes = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(data)) - starts[row]
        left = sizes[row] - offset
        sums = self.hasher.sums(data)
        ends, lengths, rows, pieces = [], [], [], []
        for n, (known, which, maybe) in self.tables.items():
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            hashes = self.hasher.of(sums, at, n)
            some = np.flatnonzero(maybe[(hashes >> np.uint64(64 - self.FILTER_BITS)).astype(np.int64)])
            at, hashes = at[some], hashes[some]
            place = np.searchsorted(known, hashes).clip(0, len(known) - 1)
            hit = known[place] == hashes
            at = at[hit]
            ends.append(offset[at] + n)
            lengths.append(np.full(len(at), n))
            rows.append(row[at])
            pieces.append(which[place[hit]])
        end, length, rows_, piece = (np.concatenate(x) for x in (ends, lengths, rows, pieces))
        # arcs come by ascending length, so a stable sort by end orders them by both; 16-bit keys are sorted by radix
        order = np.argsort(end.astype(np.uint16) if len(end) and end.max() < 1 << 16 else end, kind="stable")
        end, length, rows_, piece = end[order], length[order], rows_[order], piece[order]
        cut = np.flatnonzero(np.r_[True, (end[1:] != end[:-1]) | (length[1:] != length[:-1]), True]) if len(end) else np.zeros(1, dtype=int)
        return sizes, [(int(end[a]), int(length[a]), rows_[a:b], piece[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    def long_arcs(self, data: bytes, lo: int) -> list[tuple[int, int, int]]:
        """(start, end, piece) of the arcs that begin at the next PLACES places of a long word, ascending."""
        part = np.frombuffer(data[lo : lo + PLACES + max(self.tables)], dtype=np.uint8)
        sums, found = self.hasher.sums(part), []
        for n, (known, which, maybe) in self.tables.items():
            at = np.arange(min(PLACES, len(part) - n + 1))
            hashes = self.hasher.of(sums, at, n)
            place = np.searchsorted(known, hashes).clip(0, len(known) - 1)
            hit = known[place] == hashes
            found.append(np.stack([at[hit], at[hit] + n, which[place[hit]]], axis=1))
        rows = np.concatenate(found)
        return (rows[np.argsort(rows[:, 0], kind="stable")] + [lo, lo, 0]).tolist()

    def long_forward(self, data: bytes, scores: list[float]) -> array:
        """As forward for one long word, itself after a space."""
        alpha = array("d", [-math.inf]) * (len(data) + 1)
        alpha[0] = 0.0
        for lo in range(0, len(data), PLACES):
            for start, end, piece in self.long_arcs(data, lo):
                alpha[end] = added(alpha[end], alpha[start] + scores[piece])
        return alpha

    def long_expected(self, data: bytes, weight: float, scores: np.ndarray) -> np.ndarray:
        """As expected for one long word; its arcs are worked out again for the way back."""
        own = scores.tolist()
        alpha = self.long_forward(data, own)
        beta = array("d", [-math.inf]) * (len(data) + 1)
        beta[len(data)] = 0.0
        out = np.zeros(len(self.pieces))
        for lo in reversed(range(0, len(data), PLACES)):
            arcs = self.long_arcs(data, lo)
            shares = []
            for start, end, piece in reversed(arcs):
                through = own[piece] + beta[end]
                beta[start] = added(beta[start], through)
                share = alpha[start] + through - alpha[-1]
                shares.append(math.exp(share) if share > -math.inf else 0.0)
            out += np.bincount([a[2] for a in reversed(arcs)], weights=shares, minlength=len(out)) * weight if arcs else 0
        return out

    @staticmethod
    def forward(sizes: np.ndarray, arcs: list, scores: np.ndarray) -> np.ndarray:
        """alpha[t, word]: the log probability that pieces spell the word's first t bytes."""
        alpha = np.full((int(sizes.max()) + 1, len(sizes)), -np.inf)
        alpha[0] = 0
        for end, length, rows, pieces in arcs:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - length, rows] + scores[pieces])
        return alpha

    def expected(self, words: list[bytes], weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations (forward and backward)."""
        sizes, arcs = self.arcs(words)
        alpha = self.forward(sizes, arcs, scores)
        index = np.arange(len(words))
        total = alpha[sizes, index]
        beta = np.full_like(alpha, -np.inf)
        beta[sizes, index] = 0
        out = np.zeros(len(self.pieces))
        for end, length, rows, pieces in reversed(arcs):
            through = scores[pieces] + beta[end, rows]
            beta[end - length, rows] = np.logaddexp(beta[end - length, rows], through)
            share = np.exp(alpha[end - length, rows] + through - total[rows]) * weights[rows]
            out += np.bincount(pieces, weights=np.where(np.isfinite(share), share, 0), minlength=len(out))
        return out

    def log_probabilities(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """The marginal log probability of each word."""
        out = np.zeros(len(words))
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            out[i] = self.long_forward(b" " + words[i], scores.tolist())[-1]
        by_size = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
        for group in groups(by_size, [len(words[i]) for i in by_size]):
            sizes, arcs = self.arcs([words[i] for i in group])
            out[group] = self.forward(sizes, arcs, scores)[sizes, np.arange(len(group))]
        return out


def added(a: float, b: float) -> float:
    """The logarithm of a sum of two numbers given by theirs."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def groups(items: list[int], sizes: list[int], cells: int = 400_000):
    """Runs of items, ascending by size, whose rows times longest stay under a bound (one item at least)."""
    run: list[int] = []
    for item, size in zip(items, sizes):
        if run and (len(run) + 1) * (size + 2) > cells:
            yield run
            run = []
        run.append(item)
    if run:
        yield run


@lru_cache(maxsize=2)
def lattice(path: str) -> tuple[Lattice, np.ndarray]:
    """The lattice of a vocabulary file and the pieces' initial scores, by their order in the file."""
    pieces = read_pieces(vocabulary_file(path))
    order = sorted(pieces, key=pieces.get)
    weight = 1.0 / (np.arange(len(order)) + 50.0)
    return Lattice(order), np.log(weight / weight.sum())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all training documents; words are lower-cased in A-Z."""
    learn = docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    return learn.select(F.explode(words_of(lower_ascii_fast(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lower_ascii_fast(text):
    """As lower_ascii; texts of ASCII alone take the built-in way, which is quicker and does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))


def expected_counts(counts: DataFrame, path: str, scores: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of all counted words, one row per piece and task."""
    shared = counts.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        mine, total = lattice(path)[0], None
        for batch in batches:
            words = [w.encode("utf-8") for w in batch.column(0).to_pylist()]
            n = batch.column(1).to_numpy().astype(float)
            for i in (i for i, w in enumerate(words) if len(w) > LONG):
                got = mine.long_expected(b" " + words[i], n[i], shared.value[:-1])
                total = got if total is None else total + got
            by_size = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
            for group in groups(by_size, [len(words[i]) for i in by_size]):
                got = mine.expected([words[i] for i in group], n[group], shared.value[:-1])
                total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array(total[some])], names=["piece", "n"])

    got = counts.select("word", "n").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(scores))
    out[got["piece"].to_numpy(dtype=int)] = got["n"].to_numpy()
    return out


def estimate(counts: DataFrame, path: str, ends: int) -> np.ndarray:
    """Piece scores, the last one that of the end token, by EM_ROUNDS rounds over all counted words."""
    scores = np.append(lattice(path)[1], np.log(0.05))
    for _ in range(EM_ROUNDS):
        new = expected_counts(counts, path, scores) + SMOOTH
        new[-1] += ends
        scores = np.log(new / new.sum())
    return scores


def word_hash(word: str) -> int:
    """Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(word.encode("utf-8"), seed=42)


def fit(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> tuple[DataFrame, dict]:
    """The counts of rarer words, and what the workers need: hashes, counts and scores of the most frequent words."""
    counts = stored(word_counts(docs), "words").withColumn("h", F.xxhash64("word"))
    ends = docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bound, sizes = 1, 0
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).limit(max_words).toLocalIterator():
        sizes += row["count"]
        if sizes > max_words:
            bound = row.n + 1
            break
    frequent = counts.where(F.col("n") >= bound)
    model = {"tokens": int(total + ends), "distinct": int(distinct + (ends > 0)), "ends": int(ends), "path": path}
    model["scores"] = estimate(counts, path, ends)
    shared = counts.sparkSession.sparkContext.broadcast(model["scores"])

    def lattices(batches):
        for batch in batches:
            logs = lattice(path)[0].log_probabilities([w.encode("utf-8") for w in batch.column(2).to_pylist()], shared.value[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], names=["h", "n", "lattice"])

    top = frequent.select("h", "n", "word").mapInArrow(lattices, "h long, n long, lattice double").toArrow()
    hashes = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    n = top["n"].to_numpy()[order]
    logs = top["lattice"].to_numpy()[order]
    model |= {"hashes": hashes[order], "base": base_log10(n, model), "full": mixed(n, logs, model), "pure": logs / LOG10}
    return counts.where(F.col("n") < bound), model


def base_log10(count, model: dict):
    return np.log10((count + SMOOTH) / (model["tokens"] + SMOOTH * (model["distinct"] + 1)))


def lattice_share(model: dict) -> float:
    """The probability mass that whole words leave to the lattice."""
    return DISCOUNT * model["distinct"] / model["tokens"] if model["tokens"] else 1.0


def mixed(count: np.ndarray, lattice_log: np.ndarray, model: dict) -> np.ndarray:
    """log10 of a word's probability: its discounted share of the training tokens, and its lattice."""
    with np.errstate(divide="ignore"):
        whole = np.log(np.maximum(np.asarray(count, dtype=float) - DISCOUNT, 0) / max(1, model["tokens"]))
    return np.logaddexp(whole, np.log(lattice_share(model)) + lattice_log) / LOG10


def partial_scores(docs: DataFrame, model: dict) -> DataFrame:
    """Per document: sums over the end token and the shipped words, and the other words with their lattice logs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tail_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("lattice", pa.float64())]))

    def run(batches):
        own = shared.value
        arcs, hashes = lattice(own["path"])[0], own["hashes"]
        end = (base_log10(own["ends"], own), float(mixed(own["ends"], own["scores"][-1], own)), int(own["ends"] > 0), float(own["scores"][-1]) / LOG10)
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            at = 0
            while at < len(texts):
                docs_words, size = [], 0
                while at < len(texts) and (not docs_words or size < 1_000_000):
                    text = texts[at].as_py() or ""
                    docs_words.append(WORD.findall(text.translate(UPPER)))
                    size += len(text)
                    at += 1
                places = {w: i for i, w in enumerate(set().union(*docs_words))}
                names = list(places)
                hashed = np.fromiter((word_hash(w) for w in names), dtype=np.uint64, count=len(names))
                place = np.searchsorted(hashes, hashed).clip(0, max(0, len(hashes) - 1))
                known = hashes[place] == hashed if len(hashes) else np.zeros(len(names), dtype=bool)
                base, full, logs, pure = (np.zeros(len(names)) for _ in range(4))
                base[known], full[known], pure[known] = own["base"][place[known]], own["full"][place[known]], own["pure"][place[known]]
                others = np.flatnonzero(~known)
                logs[others] = arcs.log_probabilities([names[i].encode("utf-8") for i in others], own["scores"][:-1])
                pure[others] = logs[others] / LOG10
                for words in docs_words:
                    which = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
                    got = known[which]
                    rest, times = np.unique(which[~got], return_counts=True)
                    tail = [{"h": h, "n": k, "lattice": x} for h, k, x in zip(hashed[rest].view(np.int64).tolist(), times.tolist(), logs[rest].tolist())]
                    rows.append((len(words) + 1, int(got.sum()) + end[2], float(base[which].sum()) + end[0], float(full[which].sum()) + end[1], float(pure[which].sum()) + end[3], tail))
            columns = [ids, *[pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), tail_type))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "mixed_score", "score", "tail"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, mixed_score double, score double, tail array<struct<h:long,n:long,lattice:double>>")


def score(docs: DataFrame, path: str, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score of every whole text."""
    rare, model = fit(docs, path, max_words)
    partial = stored(partial_scores(docs, model), "partial")
    tails = partial.select("doc_id", F.explode("tail").alias("x")).select("doc_id", "x.*")
    joined = tails.join(rare.select("h", F.col("n").alias("c")), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tokens = max(1, model["tokens"])
    base = F.log10((F.col("c") + SMOOTH) / (model["tokens"] + SMOOTH * (model["distinct"] + 1)))
    # log(a + b) with the lattice's part, which may be tiny, as the pivot where the word is unknown
    inside = float(np.log(lattice_share(model))) + F.col("lattice")
    whole = F.log(F.greatest(F.col("c") - DISCOUNT, F.lit(1e-300)) / F.lit(float(tokens)))
    most = F.greatest(inside, whole)
    full = F.when(F.col("c") > 0, most + F.log(F.exp(inside - most) + F.exp(whole - most))).otherwise(inside) / LOG10
    sums = joined.groupBy("doc_id").agg(F.sum(F.col("n") * (F.col("c") > 0).cast("long")).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * full).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.drop("tail").join(sums, "doc_id", "left").select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + zero(F.col("k"))).alias("n_known"), F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero(F.col("b"))).alias("base_score"), "score", (F.col("mixed_score") + zero(F.col("s"))).alias("mixed_score"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
