"""Periodic runs of words, found on a grammar of the text.

1. Words become numbers, those of a document apart from all others'. A word in fewer than EXPONENT places of its
   document, or a pair of words in fewer than EXPONENT - 1, is in no run, so it ends a stretch.
2. Re-Pair: pairs of neighbouring symbols that occur twice or more in a document become nonterminals, all that are more
   frequent than the pairs beside them in one round, until no pair occurs twice. What is left of each stretch is paired
   up, neighbour by neighbour, to one symbol.
3. Every nonterminal is looked at once, where it first occurs: the stretches that cross the boundary of its two halves
   and repeat EXPONENT times inside it hold a square (two equal words runs) that ends or begins at that boundary. Squares
   are found by comparing some words, then hashes, then all words; larger periods that a found stretch explains go.
4. What is found is carried over to all places that derive the nonterminal, and intervals of one period that overlap by
   that period or more are merged. A run is found whole at the smallest nonterminal that holds it.

All documents of a task are worked on together, a few megabytes at a time; one text is never split, since its grammar is
one. Time is n log n in a text's words.

Defined results: null and empty texts and texts of white space have no run and an empty collapsed text; rows that repeat
a doc_id are judged each by itself; a null doc_id plants nothing; ties go to the smallest start, then period; an empty
table gives an empty table; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table
from granary.llm.textbytes import BASE, mix, powers

EXPONENT, SHORTEST = 4, 6
#: Bytes of text that are worked on together.
BLOCK_BYTES = 2 << 20
#: Pairs of nonterminal and period that are compared together.
COMBINATIONS = 1 << 20
FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Grammar:
    """Nonterminals over a text of numbers: left and right symbol, length and first place of each; terminals come first."""

    def __init__(self, text: np.ndarray, segment: np.ndarray, owner: np.ndarray) -> None:
        """segment numbers the stretches that nothing crosses, owner names the document of each stretch."""
        self.text, self.n_terminals = text, int(text.max()) + 1 if len(text) else 0
        self.length = np.ones(self.n_terminals, dtype=np.int64)
        self.left, self.right, self.first = (np.full(self.n_terminals, -1, dtype=np.int64) for _ in range(3))
        self.rounds = [self.n_terminals]
        finished = []
        s, seg, at = text.astype(np.int64), segment, np.arange(len(text), dtype=np.int64)
        while len(s):
            s, seg, at, again = self._replace(s, seg, at, owner)
            finished.append([x[~again] for x in (s, seg, at)])
            s, seg, at = s[again], seg[again], at[again]
        s, seg, at = [np.concatenate(x) for x in zip(*finished)] if finished else (s, seg, at)
        order = np.argsort(at)
        s, seg, at = s[order], seg[order], at[order]
        while len(s) > 1 and (seg[1:] == seg[:-1]).any():
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            offset = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
            i = np.flatnonzero((offset[:-1] % 2 == 0) & (seg[1:] == seg[:-1]))
            new = self._add(s[i], s[i + 1], at[i])
            s[i] = new
            keep = np.ones(len(s), dtype=bool)
            keep[i + 1] = False
            s, seg, at = s[keep], seg[keep], at[keep]
        self.roots, self.root_at = s, at

    def _add(self, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(self.length)
        self.length = np.concatenate([self.length, self.length[left] + self.length[right]])
        self.left, self.right, self.first = (np.concatenate(x) for x in ((self.left, left), (self.right, right), (self.first, first)))
        self.rounds.append(len(self.length))
        return np.arange(n, n + len(left))

    def _replace(self, s, seg, at, owner):
        """One round; also tells which symbols belong to documents that have pairs left."""
        i = np.flatnonzero(seg[1:] == seg[:-1])
        pairs, inverse, count = np.unique(s[i] * len(self.length) + s[i + 1], return_inverse=True, return_counts=True)
        often = count[inverse] >= 2
        # no two kinds of pairs are equally urgent; neighbours are only so in a row of one symbol
        urgent = np.full(len(s) + 1, -1, dtype=np.int64)
        urgent[i[often] + 1] = (count[inverse] * len(pairs) + inverse)[often]
        own = urgent[1:-1] if len(s) > 1 else urgent[:0]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
        offset = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
        chosen = np.flatnonzero((own >= 0) & (offset % 2 == 0) & (own >= urgent[:-2][: len(own)]) & (own >= urgent[2:]))
        if not len(chosen):
            return s, seg, at, np.zeros(len(s), dtype=bool)
        kind = np.zeros(len(s), dtype=np.int64)
        kind[i] = inverse
        kinds, where, which = np.unique(kind[chosen], return_index=True, return_inverse=True)
        left, right = np.divmod(pairs[kinds], len(self.length))
        s = s.copy()
        s[chosen] = self._add(left, right, at[chosen[where]])[which]
        keep = np.ones(len(s), dtype=bool)
        keep[chosen + 1] = False
        active = np.unique(owner[seg[chosen]])
        s, seg, at = s[keep], seg[keep], at[keep]
        return s, seg, at, np.isin(owner[seg], active)

    def crossing(self) -> list[tuple[int, int, int, int]]:
        """(nonterminal, period, start, end) of stretches across its boundary, maximal inside it, counted from its start."""
        text, found = self.text, []
        rules = np.flatnonzero((self.length >= SHORTEST) & (self.first >= 0))
        room = self.length[rules] // EXPONENT
        up = powers(BASE, len(text) + 1)
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        for part in np.split(np.arange(len(rules)), np.flatnonzero(np.diff(np.cumsum(room) // COMBINATIONS)) + 1):
            x = np.repeat(rules[part], room[part])
            q = np.arange(len(x)) - np.repeat(np.cumsum(room[part]) - room[part], room[part]) + 1
            lo = self.first[x]
            p, hi = lo + self.length[self.left[x]], lo + self.length[x]
            for side, begin in ((-1, p - 2 * q), (1, p)):
                i = np.flatnonzero((begin >= lo) & (begin + 2 * q <= hi))
                for step in (lambda q: 0 * q, lambda q: q - 1, lambda q: q // 2):
                    a = begin[i] + step(q[i])
                    i = i[text[a] == text[a + q[i]]]
                b, n = begin[i], q[i]
                i = i[(sums[b + n] - sums[b]) * up[n] == sums[b + 2 * n] - sums[b + n]]
                found.append(np.stack([x[i], q[i], np.full(len(i), side)], axis=1))
        squares = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        squares = squares[np.lexsort((squares[:, 1], squares[:, 0]))]
        out = []
        for group in np.split(squares, np.flatnonzero(np.diff(squares[:, 0])) + 1) if len(squares) else ():
            out += self._stretches(int(group[0, 0]), group[:, 1], group[:, 2])
        return out

    def _stretches(self, x: int, periods: np.ndarray, sides: np.ndarray) -> list[tuple[int, int, int, int]]:
        lo = int(self.first[x])
        p, hi = lo + int(self.length[self.left[x]]), lo + int(self.length[x])
        out = []
        while len(periods):
            q, side = int(periods[0]), int(sides[0])
            begin = p - 2 * q if side < 0 else p
            periods, sides = periods[1:], sides[1:]
            same = agreeing(self.text, begin, begin + q, hi - begin - q, 1)
            if same < q:
                continue  # two hashes were equal by chance
            start, end = begin - agreeing(self.text, begin - 1, begin + q - 1, begin - lo, -1), begin + q + same
            if end - start >= max(SHORTEST, EXPONENT * q) and start < p < end:
                out.append((x, q, start - lo, end - lo))
            # squares inside a stretch of smaller period repeat that period
            open_ = np.where(sides < 0, p - 2 * periods < start, p + 2 * periods > end)
            periods, sides = periods[open_], sides[open_]
        return out

    def everywhere(self, found: list[tuple[int, int, int, int]]) -> np.ndarray:
        """(period, start, end) in the text of what was found, at all places that derive it."""
        if not found:
            return np.zeros((0, 3), dtype=np.int64)
        rows = np.array(sorted(found), dtype=np.int64)
        n = np.bincount(rows[:, 0], minlength=len(self.length))
        begin = np.cumsum(n) - n
        needed = n > 0
        for lo, hi in zip(self.rounds, self.rounds[1:]):
            needed[lo:hi] |= needed[self.left[lo:hi]] | needed[self.right[lo:hi]]
        out, waiting = [], [[] for _ in self.rounds]
        level = np.searchsorted(self.rounds, np.arange(len(self.length)), side="right")

        def put(symbols, places):
            use = needed[symbols]
            symbols, places = symbols[use], places[use]
            order = np.argsort(level[symbols], kind="stable")
            symbols, places = symbols[order], places[order]
            for part in np.split(np.arange(len(symbols)), np.flatnonzero(np.diff(level[symbols])) + 1):
                if len(part):
                    waiting[level[symbols[part[0]]]].append((symbols[part], places[part]))

        put(self.roots, self.root_at)
        for k in range(len(waiting) - 1, 0, -1):
            if not waiting[k]:
                continue
            symbols, places = (np.concatenate(x) for x in zip(*waiting[k]))
            times = n[symbols]
            row = np.repeat(begin[symbols], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = np.repeat(places, times)
            out.append(np.stack([rows[row, 1], place + rows[row, 2], place + rows[row, 3]], axis=1))
            put(np.concatenate([self.left[symbols], self.right[symbols]]), np.concatenate([places, places + self.length[self.left[symbols]]]))
        return np.concatenate(out)


def agreeing(text: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and j on, forwards or backwards, are equal; at most so many are compared."""
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        a, b = i + step * done, j + step * done
        x, y = (text[a : a + n], text[b : b + n]) if step > 0 else (text[a - n + 1 : a + 1][::-1], text[b - n + 1 : b + 1][::-1])
        differs = np.flatnonzero(x != y)
        if len(differs):
            return done + int(differs[0])
        done += n
        size *= 2
    return done


def merged(intervals: np.ndarray) -> np.ndarray:
    """Intervals of one period that overlap by the period or more become one."""
    if not len(intervals):
        return intervals
    rows = intervals[np.lexsort((intervals[:, 2], intervals[:, 1], intervals[:, 0]))]
    period, start, end = rows.T
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(period * far + end) - period * far
    first = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (start[1:] + period[1:] > reach[:-1])])
    return np.stack([period[first], start[first], np.maximum.reduceat(end, first)], axis=1)


def stretches_of(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, place and stretch number of the words that may be in runs; the symbols of two documents differ."""
    _, symbol, count = np.unique(owner * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[symbol] >= EXPONENT)
    symbol = symbol[at]
    for width in (2, 1):
        joined = (np.diff(at) == 1) & (owner[at][1:] == owner[at][:-1]) if len(at) else np.zeros(0, dtype=bool)
        if width == 2 and joined.any():
            i = np.flatnonzero(joined)
            _, inverse, pairs = np.unique(symbol[i] * (int(symbol.max()) + 1) + symbol[i + 1], return_inverse=True, return_counts=True)
            joined[i[pairs[inverse] < EXPONENT - 1]] = False
        # a stretch's first word is one that isn't joined to the word before
        stretch = np.cumsum(np.r_[True, ~joined]) - 1 if len(at) else at
        long_enough = np.bincount(stretch)[stretch] >= SHORTEST if len(at) else at.astype(bool)
        if width == 2:
            at, symbol, kept = at[long_enough], symbol[long_enough], stretch[long_enough]
    return symbol, at, np.unique(kept, return_inverse=True)[1] if len(kept) else kept


def runs_of(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(period, start, end) of all runs; owner names the document of each word, and a document's words stand together."""
    symbol, at, stretch = stretches_of(words, owner)
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    symbol = np.unique(symbol, return_inverse=True)[1]
    first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
    grammar = Grammar(symbol, stretch, owner[at[first]])
    runs = merged(grammar.everywhere(grammar.crossing()))
    length = runs[:, 2] - runs[:, 1]
    start = at[runs[:, 1]]
    return np.stack([runs[:, 0], start, start + length], axis=1)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) of a document whose words from a on repeat its p words from there, or None."""
    if doc_id is None or not n:
        return None
    g, digit = divmod(zlib.crc32(str(doc_id).encode("ascii")), 10)
    return None if digit else (g % n, 1 + (n - g % n) // (3 + g % 8))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digest(doc_ids: list[int | None], texts: pa.Array, plant: bool = True) -> pa.RecordBatch:
    """FIELDS of some documents."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    words = words.filter(full)
    sizes = np.bincount(owner, minlength=len(sizes))
    offsets = np.r_[0, np.cumsum(sizes)]
    if plant:
        order = np.arange(len(words))
        for d, (i, n) in enumerate(zip(doc_ids, sizes.tolist())):
            if (given := planted(i, n)) is not None:
                a, p = given
                order[offsets[d] + a : offsets[d + 1]] = offsets[d] + a + np.arange(n - a) % p
        words = words.take(pa.array(order))
    runs = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), owner)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 1] + runs[:, 0], 1)
    np.add.at(edges, runs[:, 2], -1)
    kept = np.cumsum(edges)[:-1] == 0
    counts = np.bincount(owner[kept], minlength=len(sizes))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), words.filter(pa.array(kept))), " ")
    runs = runs[np.lexsort((runs[:, 0], runs[:, 1]))]
    bounds = np.searchsorted(runs[:, 1], offsets)
    rows = []
    for d, text in enumerate(joined):
        own = runs[bounds[d] : bounds[d + 1]].tolist()
        listed = [(start - int(offsets[d]), end - start, period) for period, start, end in own]
        best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else None
        told = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
        rows.append((doc_ids[d], len(listed), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(told.encode("ascii")), sha256(text.as_buffer().to_pybytes())))
    kinds = [pa.string() if "sha256" in f else pa.int64() for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in FIELDS.split(", ")])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """FIELDS of every document; with `plant`, of the texts that the fixed rule makes periodic (one in ten)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist()):
                if hi > lo:
                    yield digest(ids[lo:hi], texts.slice(lo, hi - lo), plant)

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
