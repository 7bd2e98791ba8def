"""Companies of a lead list: rows of one company are merged, weak matches are flagged on both sides, blanks are filled.

A row joins the earliest leader (a row that opened a group) of equal domain, else of equal name key, else of equal key
without spaces (SQUASHED characters or more). Else it leads a group of its own, and if half of the words of it and an
earlier leader are the same, the two flag each other: the earliest such leader counts, and nothing is merged.

Leaders are those that no earlier leader shares a key with. Rows are first reduced to distinct keys; then in each of
PEELED rounds a row leads that is the first in all its groups, and whatever shares a key with it goes, so that a domain
of a third of all rows is settled at once. Only what is left of long chains is replayed in order, component by component.

Weak matches are found without pairs: two names of up to SHORT words match if and only if they share a set of c words,
for a c of at least half of either's number of words. So each leader puts forward all such sets of its own, and the
first leader of each set is its match. Longer names and those that repeat a word are few: they meet by their rarest
words, one of which a match must share, and are compared word by word.

Defined results: rows without a name are left out; null and malformed websites are no domain; repeated rows join the
first; extra columns are ignored; an empty table gives empty tables. `pos` identifies a row and gives the order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import signal_rules as R
from granary.functions import url as U
from granary.session import stored

KEYS = ("domain", "k", "s")
TIERS = ("domain", "exact", "squash")
SQUASHED, SHORT, PEELED = 5, 8, 4
FILLED = ("website", "linkedin", "industry", "country")


def batch_key(name: Column) -> Column:
    """A name in lower case without legal forms; what is neither a word character nor a hyphen becomes a space."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), R.spark_pattern(R.LEGAL_FORMS), " "), r"[^A-Za-z0-9_\s-]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def website_domain(website: Column) -> Column:
    """The host of a website, with or without a scheme, without `www.`; null if there is none."""
    host = U.host(website)
    return F.when(host.rlike(r"^[^\s<>\[\]{}|^%`\"]+$"), host)


def with_keys(rows: DataFrame) -> DataFrame:
    """pos, name, domain, k, s, words, and the columns that are filled."""
    blank = [c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FILLED]
    keyed = rows.where("name IS NOT NULL").select("pos", "name", *blank).select("*", website_domain(F.col("website")).alias("domain"), batch_key(F.col("name")).alias("k"))
    squashed = F.regexp_replace("k", r"\s", "")
    return keyed.select("*", F.when(F.length(squashed) >= SQUASHED, squashed).alias("s"), F.filter(F.split("k", " "), lambda w: w != "").alias("words"))


def leaders(keyed: DataFrame) -> DataFrame:
    """pos, domain, k, s of the rows that open a group."""
    left = stored(keyed.groupBy(*KEYS).agg(F.min("pos").alias("pos")), "company-keys")
    found = left.limit(0)
    for _ in range(PEELED):
        marked = left.withColumn("first", F.lit(True))
        for key in KEYS:
            low = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("low"))
            marked = marked.join(low, key, "left").withColumn("first", F.col("first") & (F.coalesce("low", "pos") == F.col("pos"))).drop("low")
        led = stored(marked.where("first").select(left.columns), "company-leaders")
        found = found.unionByName(led)
        for key in KEYS:
            left = left.join(led.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
        left = stored(left.select(found.columns), "company-keys")
        if left.isEmpty():
            return found
    return found.unionByName(replayed(left))


def replayed(left: DataFrame) -> DataFrame:
    """The leaders among rows of distinct keys, by going through each component of shared keys in order."""
    comp = left.withColumn("c", F.col("pos"))
    while True:
        new = comp.withColumn("old", F.col("c"))
        for key in KEYS:
            low = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("c").alias("m"))
            new = new.join(low, key, "left").withColumn("c", F.least("c", F.coalesce("m", "c"))).drop("m")
        new = stored(new.select("pos", *KEYS, "c", "old"), "company-components")
        comp = new.drop("old")
        if new.where("c < old").isEmpty():
            break

    def run(batches):
        last, taken = None, set()
        for batch in batches:
            leads = []
            for c, *keys in zip(*[batch.column(i).to_pylist() for i in (0, *range(2, 2 + len(KEYS)))]):
                if c != last:
                    last, taken = c, set()
                own = [(tier, v) for tier, v in zip(KEYS, keys) if v is not None]
                leads.append(not any(x in taken for x in own))
                if leads[-1]:
                    taken.update(own)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=["pos", *KEYS]).filter(pa.array(leads, type=pa.bool_()))

    kind = dict(left.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in ("pos", *KEYS))
    return comp.select("c", "pos", *KEYS).repartition("c").sortWithinPartitions("c", "pos").mapInArrow(run, schema).select(left.columns)


def memberships(keyed: DataFrame, led: DataFrame) -> DataFrame:
    """keyed with leader_pos and tier: how the row came to its group, null for leaders."""
    out = keyed
    for key in KEYS:
        low = led.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias(f"by_{key}"))
        out = out.join(low, key, "left")
    earlier = {key: F.when(F.col(f"by_{key}") < F.col("pos"), F.col(f"by_{key}")) for key in KEYS}
    tier = F.coalesce(*[F.when(earlier[k].isNotNull(), F.lit(t)) for k, t in zip(KEYS, TIERS)])
    return out.withColumn("leader_pos", F.coalesce(*earlier.values(), "pos")).withColumn("tier", tier).drop(*[f"by_{k}" for k in KEYS])


def word_sets(words: Column, n: Column) -> Column:
    """All sets of at least n / 2 of some distinct words, each joined to a string."""
    bit = lambda i: F.element_at(F.array(*[F.lit(1 << k) for k in range(SHORT)]), i + 1)
    masks = F.filter(F.sequence(F.lit(1), F.aggregate(words, F.lit(1), lambda a, _: a * 2) - 1), lambda m: 2 * F.bit_count(m) >= n)
    return F.transform(masks, lambda m: F.array_join(F.filter(words, lambda w, i: m.bitwiseAND(bit(i)) > 0), " "))


def weak_matches(named: DataFrame) -> DataFrame:
    """pos, other_pos: the earliest row before it that shares half of the words of the longer name. named has pos and words."""
    sets = named.select("pos", "words", F.size("words").alias("n"), F.array_sort(F.array_distinct("words")).alias("w")).where("n > 0")
    short = sets.where(F.col("n") <= SHORT).select("pos", F.explode(word_sets(F.col("w"), F.col("n"))).alias("set"))
    firsts = short.groupBy("set").agg(F.min("pos").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    by_set = short.join(firsts, "set").where("first < pos").groupBy("pos").agg(F.min("first").alias("other_pos"))
    return by_set.unionByName(by_rare_words(sets)).groupBy("pos").agg(F.min("other_pos").alias("other_pos"))


def by_rare_words(sets: DataFrame) -> DataFrame:
    """Matches that sets of words don't find: of names of more than SHORT words, and of rows that repeat a word."""
    odd = (F.size("w") < F.col("n")) | (F.col("n") > SHORT)
    tokens = sets.select("pos", "words", "n", "w", odd.alias("odd"), F.explode("w").alias("word"))
    frequency = tokens.groupBy("word").agg(F.count("*").alias("f"))
    ranked = tokens.join(frequency, "word").groupBy("pos").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("odd").alias("odd"), F.array_sort(F.collect_list(F.struct("f", "word"))).alias("ranked"))
    times = lambda word: F.size(F.filter("words", lambda x: x == word))
    # a match shares at least half of all words: one of them is among the rarest that leave less than that
    rest = lambda i: F.aggregate(F.slice("ranked", F.lit(1), i), F.lit(0), lambda a, x: a + times(x["word"]))
    prefix = F.filter("ranked", lambda x, i: 2 * (F.col("n") - rest(i)) >= F.col("n"))
    probes = ranked.select("pos", "words", "n", "odd", F.explode(F.transform(prefix, lambda x: x["word"])).alias("word")).alias("a")
    index = tokens.alias("b")
    hit = (F.col("a.word") == F.col("b.word")) & (F.col("b.pos") < F.col("a.pos")) & (F.col("a.odd") | (F.col("b.n") > SHORT)) & (F.col("b.n") <= 2 * F.col("a.n"))
    shared = F.size(F.filter("a.words", lambda x: F.array_contains("b.w", x)))
    close = 2 * shared >= F.greatest("a.n", "b.n")
    return probes.join(index, hit).where(close).select(F.col("a.pos").alias("pos"), F.col("b.pos").alias("other_pos")).groupBy("pos").agg(F.min("other_pos").alias("other_pos"))


def resolve(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, companies, flags) of rows with pos, name and any of website, linkedin, industry, country.

    members: pos, leader_pos, tier (domain, exact, squash; partial for a leader that flags an earlier one, none for others).
    companies: leader_pos, name, the filled columns, n_contacts, flags (of its own, 0 or 1) and flagged_by.
    flags: pos, other_pos, other_name, place: what each leader's list of possible duplicates holds, in order.
    """
    keyed = stored(with_keys(rows), "companies")
    of = stored(memberships(keyed, leaders(keyed)), "company-members")
    heads = of.where("tier IS NULL").select("pos", "name", "words")
    weak = stored(weak_matches(heads), "weak-matches")
    names = heads.select(F.col("pos").alias("other_pos"), F.col("name").alias("other_name"))
    # a leader's own match comes first, as the group is made with it; later ones follow in their order
    both = weak.select("pos", "other_pos", F.lit(-1).cast("long").alias("place")).unionByName(weak.select(F.col("other_pos").alias("pos"), F.col("pos").alias("other_pos"), F.col("pos").cast("long").alias("place")))
    flags = both.join(names, "other_pos").select("pos", "other_pos", "other_name", "place")
    members = of.select("pos", "leader_pos", "tier").join(weak.select("pos", "other_pos"), "pos", "left").select("pos", "leader_pos", F.coalesce("tier", F.when(F.col("other_pos").isNotNull(), "partial"), F.lit("none")).alias("tier"))
    filled = of.groupBy("leader_pos").agg(F.min_by("name", "pos").alias("name"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in FILLED], F.count("*").alias("n_contacts"))
    counts = flags.groupBy(F.col("pos").alias("leader_pos")).agg(F.count_if(F.col("place") < 0).alias("flags"), F.count_if(F.col("place") >= 0).alias("flagged_by"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    companies = filled.join(counts, "leader_pos", "left").select("leader_pos", "name", *FILLED, "n_contacts", zero("flags"), zero("flagged_by"))
    return members, companies, flags
