"""What a text must hold for a pattern to match it: a cheap test before a dear one."""

from __future__ import annotations

import functools
import re
import re._constants as sre
import re._parser as parser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals of one or two letters tell too little.
LEAST = 3
#: Hits that are looked for in one pass over the union of all literals.
ROUNDS = 16


def required(pattern: str) -> set[str] | None:
    """Literals in lower case, one of which stands in every ASCII-case-insensitive match; None if there may be none.

    Of what must follow on each other the part whose shortest literal is longest is taken, of alternatives all.
    """
    best = _of(parser.parse(pattern))
    return best if best and min(map(len, best)) >= LEAST and all(x.isascii() for x in best) else None


def _of(sequence) -> set[str] | None:
    found, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        if kind is sre.LITERAL:
            run += chr(value).lower()
            continue
        lead = [(sre.LITERAL, ord(c)) for c in run]
        if run:
            found.append({run})
            run = ""
        if kind is sre.SUBPATTERN:
            found.append(_of(value[3]))
        elif kind is sre.BRANCH:
            # the parser takes a beginning that all alternatives share out of them
            parts = [_of([*lead, *part]) for part in value[1]]
            found.append(set().union(*parts) if all(parts) else None)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            found.append(_of(value[2]))
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)


class Finder:
    """Which of many patterns a text may match, by the literals that they need, in one pass over the text.

    The union of all literals is looked for from hit to hit, ROUNDS times for a batch of texts at once. Texts with more
    hits are searched for each literal.
    """

    def __init__(self, patterns):
        needed = [required(p) for p in patterns]
        self.always = [i for i, literals in enumerate(needed) if not literals]
        self.users: dict[bytes, list[int]] = {}
        for i, literals in enumerate(needed):
            for x in literals or ():
                self.users.setdefault(x.encode(), []).append(i)
        self.begin: dict[bytes, list[bytes]] = {}
        for x in self.users:
            self.begin.setdefault(x[:LEAST], []).append(x)
        self.union = "|".join(re.escape(x.decode()) for x in sorted(self.users))
        self.longest = max(map(len, self.users), default=0)

    def met(self, texts: list[str | None]) -> list[list[int]]:
        """Per text, in order, the numbers of patterns that it may match; all that it does are among them."""
        held: list[set[bytes]] = [set() for _ in texts]
        live = [(i, x.encode()) for i, x in enumerate(texts) if x] if self.users else []
        for _ in range(ROUNDS):
            places = pc.find_substring_regex(pa.array([x for _, x in live], pa.large_binary()), self.union, ignore_case=True).to_pylist()
            rest = []
            for (i, x), at in zip(live, places):
                if at >= 0:
                    here = x[at : at + self.longest].lower()
                    held[i].update(literal for literal in self.begin.get(here[:LEAST], ()) if here.startswith(literal))
                    rest.append((i, x[at + 1 :]))
            live = rest
            if not live:
                break
        for i, x in live:
            lowered = x.lower()
            held[i].update(literal for literal in self.users if literal in lowered)
        return [sorted({*self.always, *(i for literal in found for i in self.users[literal])}) if text else [] for text, found in zip(texts, held)]


@functools.cache
def finder(patterns: tuple[str, ...]):
    """The patterns' Finder and the patterns compiled, made once for each process."""
    return Finder(patterns), [regex.compile(p, regex.I | regex.A) for p in patterns]


def patterns_met(text: Column, patterns) -> Column:
    """Numbers of the patterns that occur in the text, in order; none in a null text."""
    patterns = tuple(patterns)

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        quick, compiled = finder(patterns)
        listed = texts.tolist()
        return pd.Series([[i for i in numbers if compiled[i].search(x)] for x, numbers in zip(listed, quick.met(listed))])

    return find(text)
