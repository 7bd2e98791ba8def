"""URL filter: explicit rules, and for the rest a naive Bayes score of segmented host and path tokens.

Host names join words without spaces. A unigram model of the corpus' own path words and separated host parts splits
every host label by the Viterbi path; a multinomial naive Bayes model over these words and the path's words then tells
wanted from unwanted hosts. Its labelled examples come from one of two sources (`learn`):

- `seeds`, a list of words (a parameter): URLs with a seed word in the host are examples of block, all others of allow;
  what else such hosts say is learnt beside the seeds. This is the default: the registered rules name regions
  (`net/`, `example.com/de/`), not bad hosts, and what goes with a region says nothing about the rest (README).
- `rules`: URLs that a rule decides, with the rule's own host and path left out of their tokens, are examples of its
  verdict; each seed then adds SEED_LOG_ODDS to the score, as a prior does.

Tokens are made once, in one pass, and stored; word and token counts are Spark aggregations over all pages. The most
frequent `MAX_WORDS` of them are shipped to the workers, all others are joined.

Defined results: null urls and urls without `://` have empty host and path, no rule and verdict allow; ties between
rules of equal length go to the one that sorts first, and of two verdicts of one rule block wins; repeated urls are judged alike; extra columns are ignored; an
empty table gives an empty table; without examples of both verdicts only rules (and seeds) block; words may have any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lower_ascii, stored, table

#: (verdict, rule): a rule is a host, a slash and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of unwanted hosts, and what each adds to the log odds of block beside examples that rules label.
SEEDS, SEED_LOG_ODDS = ("casino", "bets", "bet", "poker", "pills", "viagra", "spam", "porn", "xxx", "warez", "track", "ads"), 4.0
#: Seeds and common company words count as known words at least this often, so that names can be split at them.
PRIOR_WORDS = SEEDS + ("free", "cheap", "win", "farm", "online", "shop", "news", "blog", "mail", "best", "buy", "club")
PRIOR_COUNT, MAX_WORDS, SALTS = 50, 100_000, 32
TOKEN = r"[a-z]+|[0-9]+"


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_columns(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]], r[0] == "block")):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def beside(host: Column, path: Column, rule: Column) -> tuple[Column, Column]:
    """Host and path without what the rule names."""
    name, slash = F.substring_index(rule, "/", 1), F.instr(rule, "/")
    start = F.substr(rule, slash)
    bare_host = F.when(rule.isNull(), host).otherwise(F.left(host, F.greatest(F.lit(0), F.length(host) - F.length(name))))
    return bare_host, F.when(rule.isNull(), path).otherwise(F.substr(path, F.length(start) + 1))


def most_frequent(counts: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose count reaches the lowest bound that at most `limit` keys reach, and the others (None if none are)."""
    bound, total = 1 << 62, 0
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).limit(limit + 1).collect():
        total += row["count"]
        if total > limit:
            return counts.where(F.col("n") >= bound), counts.where(F.col("n") < bound)
        bound = row.n
    return counts, None


class Splitter:
    """Splits joined words by the likeliest sequence of known words.

    A name with unknown stretches is split at long known words only (`LONG` letters), and no unknown stretch is shorter
    than `STRETCH`: `bet` isn't a word of `better`. Unknown stretches cost by length, also a whole name.
    """

    LONG, STRETCH, LETTER = 5, 4, 2.3

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        counts = dict(counts)
        self.total = (sum(counts.values()) if total is None else total) + len(PRIOR_WORDS) * PRIOR_COUNT
        for w in PRIOR_WORDS:
            counts[w] = counts.get(w, 0) + PRIOR_COUNT
        self.costs = {w: self._known(n) for w, n in counts.items()}
        self.sizes = {len(w) for w in self.costs}

    def _known(self, n: int) -> float:
        return math.log(self.total / n)

    def _unknown(self, size: int) -> float:
        return math.log(self.total) + self.LETTER * size

    def split(self, name: str, rare: dict[str, int] | None = None) -> list[str]:
        """The parts; rare holds the counts of words that aren't among the splitter's own."""
        costs, sizes = self.costs, self.sizes
        if rare:
            sizes = sizes | {len(w) for w in rare}
            costs = costs | {w: self._known(n + PRIOR_COUNT * (w in PRIOR_WORDS)) for w, n in rare.items()}
        whole = (self._unknown(len(name)) if name not in costs else costs[name], [name])
        sizes = sorted((n for n in sizes if n <= len(name)), reverse=True)
        return min(whole, self._best(name, costs, sizes, False), self._best(name, costs, [n for n in sizes if n >= self.LONG], True))[1]

    def _best(self, name: str, costs: dict[str, float], sizes: list[int], stretches: bool) -> tuple[float, list[str]]:
        """Words of the given sizes; with stretches, unknown ones of any size too, whose best start is carried along."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        begin, least = 0, math.inf
        for end in range(1, len(name) + 1):
            if stretches and end >= self.STRETCH:
                start = end - self.STRETCH
                if best[start] - self.LETTER * start < least:
                    begin, least = start, best[start] - self.LETTER * start
                if least < math.inf:
                    best[end], back[end] = best[begin] + self._unknown(end - begin), begin
            for n in sizes:
                if n <= end and (cost := costs.get(name[end - n : end])) is not None and best[end - n] + cost < best[end]:
                    best[end], back[end] = best[end - n] + cost, end - n
        out, end = [], len(name)
        while end and best[-1] < math.inf:
            out.append(name[back[end] : end])
            end = back[end]
        return best[-1], out[::-1]


class Tokens:
    """host and path -> marked tokens; remembers the hosts of late."""

    def __init__(self, splitter: Splitter) -> None:
        self.splitter, self.hosts = splitter, {}

    def of(self, host: str, path: str, rare: Iterable[dict] | None = None) -> list[str]:
        known = self.hosts.get(host)
        if known is None:
            own = {r["word"]: r["n"] for r in rare} if rare is not None else None
            known = ["h:" + w for x in re.findall(TOKEN, host) for w in (self.splitter.split(x, own) if x[0] > "9" else ["#"])]
            if len(self.hosts) > MAX_WORDS:
                self.hosts.clear()
            self.hosts[host] = known
        return known + ["p:" + (x if x[0] > "9" else "#") for x in re.findall(TOKEN, path.lower())]


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


def url_words(urls: DataFrame) -> DataFrame:
    """word, n: the letter runs of paths, and those of host labels that hyphens or digits part.

    A name that stands alone in its label may be joined, so it is no word by its own count. A part of a label counts
    once for each other label that has it, however many pages these have.
    """
    paths = urls.select(F.explode(runs_of(lower_ascii(F.col("path")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    labels = urls.select("host").distinct().select(F.explode(F.split("host", r"\.")).alias("label")).where(F.col("label").rlike("[a-z][^a-z]+[a-z]")).distinct()
    parts = labels.select(F.explode(F.array_distinct(runs_of(F.col("label")))).alias("word")).groupBy("word").agg((F.count("*") - 1).alias("n")).where("n > 0")
    return paths.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"))


def with_rare_words(urls: DataFrame, rare: DataFrame | None) -> DataFrame:
    """urls with the words of `rare` that their hosts hold (rare: an array of word and n, or null)."""
    if rare is None:
        return urls.withColumn("rare", F.lit(None).cast("array<struct<word:string,n:bigint>>"))
    hosts = urls.select("host").distinct().select("host", F.explode(F.array_distinct(runs_of(F.col("host")))).alias("run"))
    # only sizes that rare words have: a few dozen, as words of k sizes hold k * k / 2 letters
    sizes = [r.n for r in rare.select(F.length("word").alias("n")).distinct().collect()]
    ends = lambda i: F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length("run") - i + 1), lambda n: F.substr(F.col("run"), i, n))
    inside = hosts.select("host", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"), "run").select("host", F.explode(ends(F.col("i"))).alias("word"))
    found = inside.distinct().join(rare, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    # a host may have a third of all pages: they are dealt over SALTS tasks
    salted = found.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select("page_id", "host", "path", "rare")


def class_weights(counted: DataFrame, seeds: Iterable[str] = ()) -> DataFrame:
    """token, n, weight: the log odds of block against allow with one count added to each; counted has token, n, bad, good.

    Without examples of both classes nothing is learnt.
    """
    n_bad, n_good, size = counted.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*") + 1).first()
    log = lambda n, all_: F.log((n + 1) / F.lit(float(all_ + size)))
    names = ["h:" + s for s in seeds]
    seeded = F.when(F.col("token").isin(*names), SEED_LOG_ODDS).otherwise(0.0) if names else F.lit(0.0)
    return counted.select("token", "n", ((log(F.col("bad"), n_bad) - log(F.col("good"), n_good) if n_bad and n_good else F.lit(0.0)) + seeded).alias("weight"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, seeds: Iterable[str] = SEEDS, bar: float = 0.5, max_words: int = MAX_WORDS, learn: str = "seeds") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the posterior of block; null where a rule decides)."""
    spark, seeds, by_rules = pages.sparkSession, list(seeds), {"seeds": False, "rules": True}[learn]
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    plain = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    words = stored(url_words(plain), "words")
    shipped, rare = most_frequent(words, "word", max_words)
    splitter = spark.sparkContext.broadcast(Splitter({r.word: r.n for r in shipped.collect()}, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))

    @F.pandas_udf("array<string>")
    def tokens_of(host: pd.Series, path: pd.Series, rare: pd.Series) -> pd.Series:
        own = Tokens(splitter.value)
        return pd.Series([own.of(h, p, r) for h, p, r in zip(host, path, rare)])

    ruled = with_rare_words(plain, rare).select("*", rule.alias("rule"), verdict.alias("said"))
    bare_host, bare_path = beside(F.col("host"), F.col("path"), F.col("rule")) if by_rules else (F.col("host"), F.col("path"))
    tokens = ruled.withColumn("bare_host", bare_host).withColumn("bare_path", bare_path).select("page_id", "host", "path", "rule", "said", tokens_of("bare_host", "bare_path", "rare").alias("tokens"))
    # the rows' numbers stay as they are once the table is written
    urls = stored(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit("h:" + x) for x in seeds])) if seeds else F.lit(False)
    bad, good = [F.coalesce(c.cast("long"), F.lit(0)) for c in ((F.col("said") == "block", F.col("said") == "allow") if by_rules else (seeded, ~seeded))]
    examples = urls.agg(F.coalesce(F.sum(bad), F.lit(0)), F.coalesce(F.sum(good), F.lit(0))).first()
    exploded = urls.select(F.explode("tokens").alias("token"), bad.alias("bad"), good.alias("good"))
    counted = stored(exploded.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")
    frequent, others = most_frequent(class_weights(counted, seeds if by_rules else ()), "token", max_words)
    prior = math.log((examples[0] + 1) / (examples[1] + 1)) if all(examples) else 0.0
    model = spark.sparkContext.broadcast(({r.token: r.weight for r in frequent.collect()}, prior))

    @F.pandas_udf("struct<logit:double,tail:array<string>>")
    def partial(tokens: pd.Series) -> pd.DataFrame:
        weight, start = model.value
        return pd.DataFrame({"logit": [start + sum(weight.get(t, 0.0) for t in x) for x in tokens], "tail": [[t for t in x if t not in weight] for x in tokens]})

    open_ = urls.where("said IS NULL").select("row", "page_id", "host", "path", partial("tokens").alias("x")).select("row", "page_id", "host", "path", "x.*")
    if others is not None:
        # tokens beyond the shipped ones get their weights by a join
        rows = stored(open_, "partial")
        tails = rows.select("row", F.explode("tail").alias("token")).join(others, "token").groupBy("row").agg(F.sum("weight").alias("more"))
        open_ = rows.join(tails, "row", "left").withColumn("logit", F.col("logit") + F.coalesce("more", F.lit(0.0)))
    own = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("logit")))))
    scored = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when((F.col("host") != "") & (own > bar), "block").otherwise("allow").alias("verdict"), own.alias("score"))
    return scored.unionByName(urls.where("said IS NOT NULL").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
