"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can stand last in the prefix's encoding. A table of
these last tokens is filled from left to right: a token fits at the end of a prefix when the pair (last token of the
shorter prefix, token) is itself what merging their bytes gives. Walking back from the end yields the encoding. The
table makes appends exact (only new prefixes are filled) and lets an edit refill only until the old entries return.

Vocabularies are rank files (`base64 rank` lines) whose path is a parameter; nothing is trained. Each partition is
encoded on its own in Arrow batches: no shuffle, and memory bounded by one batch, the vocabulary and two caches.

Defined results: null and empty texts have no ids and decode to no bytes; any text of any length decodes to its own
bytes; an empty table gives an empty table; clashing names of extra columns are kept by `encode_documents`.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table, vocabulary_file

CACHE_ENTRIES = 300_000
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000
#: The file and the splitting pattern that the query uses.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens with the merge that makes each: a token's rank is its id, and lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.known: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._unmade: set[int] = set()
        for token, data in sorted(self.tokens.items()):
            if len(data) > 1:
                parts = self.merge(data, below=token)
                if len(parts) == 2:
                    self.halves[token] = (parts[0], parts[1])
                else:
                    self._unmade.add(token)
        self.joined = {(a << 32) | b: t for t, (a, b) in self.halves.items()}
        #: Tokens by their bytes from last to first: byte -> [token or -1, the same for the byte before].
        self.backwards: dict[int, list] = {}
        for token, data in self.tokens.items():
            if self.whole(token):
                at = None
                for byte in reversed(data):
                    at = (self.backwards if at is None else at[1]).setdefault(byte, [-1, {}])
                at[0] = token

    def merge(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """Plain merging by lowest rank, with ranks under a bound; for short byte strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        return token not in self._unmade

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens as they are, side by side."""
        key = (left << 32) | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= 4 * CACHE_ENTRIES:
                self.known.clear()
            known = self.known[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Merges are undone from the last to the first; at each moment, no earlier merge may join what touches.

        a and b are the tokens on either side of the border; `until` is the rank of the merge undone last, before
        which a joint merge of a and b would have come. On equal ranks the left place merges first.
        """
        until = 1 << 40
        while True:
            if self.joined.get((a << 32) | b, 1 << 40) < until:
                return False
            made_a, made_b = self.halves.get(a), self.halves.get(b)
            if made_a and (not made_b or a > b):
                until, a = a, made_a[1]
            elif made_b:
                until, b = b + 1, made_b[0]
            else:
                return True


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _fill(self, data: bytes, last: list[int], end: int) -> None:
        """Enters the last token of every prefix from length len(last) + 1 to end.

        It is the longest token that ends there and fits; no other can, as an encoding is unique.
        """
        v = self.vocabulary
        known, fits, backwards, start = v.known.get, v.fits, v.backwards, len(last)
        for place in range(start, end):
            node, at, found = backwards.get(data[place]), place, []
            while node is not None:
                if node[0] >= 0:
                    found.append((node[0], at))
                if not at:
                    break
                at -= 1
                node = node[1].get(data[at])
            while found:
                token, at = found.pop()
                if not at:
                    break
                left = last[at - 1]
                fit = known((left << 32) | token)
                if fit or (fit is None and fits(left, token)):
                    break
            else:
                raise ValueError(f"no token ends at byte {place}: the vocabulary lacks a byte")
            last.append(token)

    def cut(self, size: int) -> None:
        """Keeps the first bytes only; their entries stay as they are."""
        self.data = self.data[:size]
        del self.last[size:]

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts new bytes in the place of data[start:stop]; returns how many prefixes were filled anew.

        Refilling stops once as many entries as the longest token has bytes have come out as they were before.
        """
        old_tail, data = self.last[stop:], self.data[:start] + new + self.data[stop:]
        last, same, shift = self.last[:start], 0, start + len(new)
        for end in range(start + 1, len(data) + 1):
            self._fill(data, last, end)
            token = last[-1]
            place = end - 1 - shift
            same = same + 1 if place >= 0 and old_tail[place] == token and len(self.vocabulary.tokens[token]) <= place + 1 else 0
            if same >= self.vocabulary.longest:
                last += old_tail[place + 1 :]
                break
        filled = end - start if len(data) > start else 0
        self.data, self.last = data, last
        return filled

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Encodes texts piece by piece and decodes ids; remembers the ids of the pieces of late."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> None:
        """Enters new pieces in byte order, so that each goes on from the prefix it shares with the one before."""
        ranks, older, prefixes = self.vocabulary.ranks, self.older.get, PrefixTable(self.vocabulary)
        for piece in sorted(missing):
            packed = older(piece)
            if packed is None:
                data = piece.encode("utf-8")
                token = ranks.get(data)
                if token is not None:
                    packed = struct.pack("<I", token)
                else:
                    same, most = 0, min(len(data), len(prefixes.data))
                    while same < most and data[same] == prefixes.data[same]:
                        same += 1
                    prefixes.cut(same)
                    prefixes.append(data[same:])
                    ids = prefixes.tokens()
                    packed = struct.pack(f"<{len(ids)}I", *ids)
            self.pieces[piece] = packed

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(t) if t else [] for t in texts]
        distinct = set().union(*found)
        missing = distinct.difference(self.pieces)
        if missing:
            if len(self.pieces) + len(missing) > CACHE_ENTRIES:
                self.older, self.pieces, missing = self.pieces, {}, distinct
            self._learn(missing)
        packed = self.pieces.__getitem__
        return [b"".join(map(packed, x)) for x in found]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary; its tables are left out of later garbage collections."""
    made = Codec(read_ranks(vocabulary_file(path)), pattern)
    gc.collect()
    gc.freeze()
    return made


def in_groups(column: pa.Array, chars: int):
    """The texts of a column in lists of about so many characters (one long text may be more)."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py())
        size += len(group[-1] or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """The columns of `keep`, then n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids (array of long).

    A column of `keep` that is named like one of these is left out.
    """
    keep = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256") + ("ids",) * with_ids]
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            at, keys = 0, batch.num_columns - 1
            for texts in in_groups(batch.column(keys), GROUP_CHARS):
                rows, all_ids = [], []
                for packed in own.encode_packed(texts):
                    ids = np.frombuffer(packed, dtype="<u4")
                    rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(ids.tolist())).hexdigest()))
                    if with_ids:
                        all_ids.append(ids)
                made = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                if with_ids:
                    ends = np.cumsum([0] + [len(x) for x in all_ids]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids).astype(np.int64))))
                names = batch.schema.names[:-1] + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, len(texts)) for i in range(keys)] + made, names=names)
                at += len(texts)

    kept = ", ".join(f"`k{i}` {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = inner.mapInArrow(run, f"{kept}, {fields}")
    return out.toDF(*keep, *[x.strip().split(" ")[0] for x in fields.split(", ")])


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """ids (array of long) -> text as UTF-8 with replacement of broken sequences, beside the other columns."""

    @F.pandas_udf("string")
    def text_of(ids):
        own = codec(path, pattern)
        return ids.map(lambda x: None if x is None else own.decode([int(i) for i in x]).decode("utf-8", "replace"))

    return rows.withColumn("text", text_of("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_files(), keep=["doc_id"])
