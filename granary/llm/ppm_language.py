"""Language identification by prediction by partial matching (PPM).

For every language, byte context trees of variable order (0 to `ORDER`) are counted on a bounded sample of labelled
rows, whole texts each, by one Spark aggregation over all languages. With the statistics frozen, a byte costs -log2 of its PPM probability: the longest context that is known is
tried first; a byte that never followed it costs an escape (method C: distinct followers over all) and goes on with
the next shorter context, down to a uniform choice of 256. The code length of a text is the sum over its bytes, and
the language with the shortest code wins.

As the statistics are frozen, a byte's costs depend only on it and the ORDER bytes before it. So costs of all
(ORDER + 1)-byte strings seen in training are tabulated once; the others are worked out per batch from the shorter
orders. Scoring is one pass without a shuffle; the tables are bounded by the training sample. Long texts are scored in
blocks of `BLOCK` bytes with the ORDER bytes before each, so that memory doesn't grow with a text beyond its own bytes.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language that sorts
first; rows with null language, or in the held-out fold, are never learnt from; repeated rows are scored alike; an
empty table gives an empty table; with nothing to learn from, every text is `und`. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold_of, table

ORDER = 3
#: About so many rows of each language make the training sample; their texts are taken whole.
TRAIN_DOCS = 1500
BLOCK = 1_000_000
FOLDS, HELD_OUT = 5, 0
LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The codes of all n-byte strings (n up to 4) that end at each byte from the n-th on."""
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | data[k : k + len(out)].astype(np.uint32)
    return out


def tallied(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The (k + 1)-byte strings of some texts, each after k spaces, ascending, and their counts."""
    codes = [grams(np.frombuffer(b" " * k + x, dtype=np.uint8), k + 1) for x in texts]
    return np.unique(np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32), return_counts=True)


class ContextTrees:
    """Frozen PPM statistics of several languages."""

    def __init__(self, languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        """counts[language][k]: the (k + 1)-byte strings with their counts, ascending."""
        self.languages, self.counts = languages, counts
        self.contexts = [[self._contexts(codes, n) for codes, n in own] for own in counts]
        known = np.unique(np.concatenate([own[ORDER][0] for own in counts]))
        self.keys, self.costs = self._table(known)

    @staticmethod
    def _contexts(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts (the strings without their last byte), their totals and their numbers of distinct followers."""
        context, start = np.unique(codes >> np.uint32(8), return_index=True)
        return context, np.add.reduceat(n, start).astype(np.float64), np.diff(np.append(start, len(codes))).astype(np.float64)

    @classmethod
    def learn(cls, samples: dict[str, list[bytes]]) -> ContextTrees:
        languages = sorted(samples)
        return cls(languages, [[tallied(samples[language], k) for k in range(ORDER + 1)] for language in languages])

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each (ORDER + 1)-byte string, by language (columns)."""
        out = np.zeros((len(codes), len(self.languages)))
        for column, (own, contexts) in enumerate(zip(self.counts, self.contexts)):
            bits, open_ = np.zeros(len(codes)), np.ones(len(codes), dtype=bool)
            for k in range(ORDER, -1, -1):
                part = codes & np.uint32((1 << (8 * (k + 1))) - 1) if k < 3 else codes
                context, total, distinct = contexts[k]
                at = np.searchsorted(context, part >> np.uint32(8)).clip(0, len(context) - 1)
                known = open_ & (context[at] == part >> np.uint32(8))
                strings, n = own[k]
                place = np.searchsorted(strings, part).clip(0, len(strings) - 1)
                seen = known & (strings[place] == part)
                size = total[at] + distinct[at]
                bits += np.where(seen, np.log2(size / n[place]), 0) + np.where(known & ~seen, np.log2(size / distinct[at]), 0)
                open_ &= ~seen
            out[:, column] = bits + np.where(open_, 8.0, 0)
        return out

    def _table(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of the known strings: keys (place + 1, 0 if free) and costs by place."""
        self.known, costs = known, self.code_lengths(known).astype(np.float32)
        size = 1 << max(10, int(4 * len(known)).bit_length())
        self.shift = np.uint32(32 - size.bit_length() + 1)
        keys = np.zeros(size, dtype=np.int32)
        slot, left = self._slot(known), np.arange(len(known))
        while len(left):
            free = keys[slot[left]] == 0
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            keys[slot[first]] = first + 1
            left = np.setdiff1d(left, first)
            slot[left] = (slot[left] + 1) % size
        return keys, costs

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        out, parts, owners, size = np.zeros((len(texts), len(self.languages))), [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                parts.append((t[at - ORDER : at] if at else b" " * ORDER) + t[at : at + BLOCK])
                owners.append(i)
                size += len(parts[-1])
                if size >= BLOCK:
                    np.add.at(out, owners, self._score(parts))
                    parts, owners, size = [], [], 0
        if parts:
            np.add.at(out, owners, self._score(parts))
        return out

    def _score(self, texts: list[bytes]) -> np.ndarray:
        """As score, of short texts with ORDER bytes of context before each."""
        starts = np.cumsum([0] + [len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        codes = grams(data, ORDER + 1)
        slot = self._slot(codes)
        place = np.full(len(codes), -1, dtype=np.int64)
        left = np.arange(len(codes))
        while len(left):
            at = self.keys[slot[left]].astype(np.int64) - 1
            hit = (at >= 0) & (self.known[at] == codes[left])
            place[left[hit]] = at[hit]
            left = left[(at >= 0) & ~hit]
            slot[left] = (slot[left] + 1) % len(self.keys)
        costs = self.costs[place]
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, back = np.unique(codes[missing], return_inverse=True)
            costs[missing] = self.code_lengths(new).astype(np.float32)[back]
        total = np.zeros((len(codes) + 1, len(self.languages)))
        np.cumsum(costs, axis=0, dtype=np.float64, out=total[1:])
        ends = starts[1:] - ORDER
        return total[ends.clip(0, len(codes))] - total[starts[:-1].clip(0, len(codes))]


def training_counts(docs: DataFrame, per_language: int = TRAIN_DOCS) -> ContextTrees | None:
    """Trees of the texts with a letter in the training folds: those rows of each language whose hashes are smallest.

    A hash bound takes about per_language rows of each, without a sort, in one scan for all languages; strings are
    counted in the tasks and summed by Spark. None without a usable row.
    """
    usable = docs.where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = usable.where((order < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def run(batches):
        total: dict = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.setdefault(lang, []).append(text.as_py().encode("utf-8"))
            for lang, own in texts.items():
                for k in range(ORDER + 1):
                    codes, n = tallied(own, k)
                    if (lang, k) in total:
                        old, m = total[lang, k]
                        both, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        codes, n = both, np.bincount(back, weights=np.concatenate([m, n])).astype(np.int64)
                    total[lang, k] = codes, n
        for (lang, k), (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(np.full(len(codes), k, dtype=np.int32)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "code", "n"])

    got = rows.mapInArrow(run, "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("k", "ascending"), ("code", "ascending")])
    if not len(got):
        return None
    lang, k, code, n = got["lang"].to_numpy(), got["k"].to_numpy(), got["code"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    languages = sorted(set(lang))
    return ContextTrees(languages, [[(code[(lang == x) & (k == i)], n[(lang == x) & (k == i)]) for i in range(ORDER + 1)] for x in languages])


def predict(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred, score for each document's whole text. score: the winner's share among 2^(-bits / sqrt(bytes))."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        own = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if own and t and LETTER.search(t)]
            while todo:
                group, size = [], 0
                while todo and (not group or size < 2_000_000):
                    group.append(todo.pop())
                    size += len(texts[group[-1]])
                data = [texts[i].encode("utf-8") for i in group]
                bits = own.score(data)
                best = bits.argmin(axis=1)
                lengths = np.array([len(x) for x in data])
                # damped by the length, so that long texts don't all score 1
                weight = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / np.sqrt(lengths)[:, None])
                for i, b, w in zip(group, best, weight[np.arange(len(group)), best] / weight.sum(axis=1)):
                    names[i], scores[i] = own.languages[b], float(w)
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, training_counts(docs.select("doc_id", "text", "lang")))
    return got.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
