"""Company merging against a sequential version, on random lists with chains, common words and repeated words."""

import random
import re

import pytest

from granary.operators import companies as C

SCHEMA = "pos long, name string, website string, linkedin string, industry string, country string, tier string"


def by_hand(rows):
    groups, tiers = [], {}
    for pos, name, website, linkedin, industry, country, _ in rows:
        if name is None:
            continue
        k = re.sub(r"\b(?:pvt\.?|private|ltd\.?|limited|inc\.?|incorporated|llc|corp\.?|corporation|co\.?)\b", " ", name.lower(), flags=re.A)
        k = " ".join(re.sub(r"[^A-Za-z0-9_\s-]", " ", k).split())
        s, words = k.replace(" ", ""), k.split()
        domain = None
        if website and " " not in website:
            domain = re.sub(r"^www\.", "", re.split(r"[/?#:]", re.sub(r"^[a-z]+://", "", website.lower()))[0]) or None
        best = (-1, None)
        for g in groups:
            if domain and g["domain"] == domain:
                rank = 3
            elif k == g["k"]:
                rank = 2
            elif s == g["s"] and len(s) >= 5:
                rank = 1
            elif words and g["words"] and sum(w in g["words"] for w in words) / max(len(words), len(g["words"])) >= 0.5:
                rank = 0
            else:
                continue
            if rank > best[0]:
                best = (rank, g)
        fields = [website, linkedin, industry, country]
        if best[0] > 0:
            g = best[1]
            g["fields"] = [a if a is not None else b for a, b in zip(g["fields"], fields)]
            g["n"] += 1
            tiers[pos] = (g["pos"], ["partial", "squash", "exact", "domain"][best[0]])
            continue
        own = {"pos": pos, "name": name, "k": k, "s": s, "words": words, "domain": domain, "fields": fields, "n": 1, "flags": []}
        if best[0] == 0:
            own["flags"].append(best[1]["name"])
            best[1]["flags"].append(name)
        tiers[pos] = (pos, "partial" if best[0] == 0 else "none")
        groups.append(own)
    return groups, tiers


def lists(kind):
    rng = random.Random(kind)
    vocabulary = ["industries", "group", "tata", "steel", "a", "t", "e", "power", "works", "north", "Ltd", "Pvt.", "global-x", "co", "Müller", "india"]
    long = ["north", "east", "south", "west", "steel", "iron", "wire", "rope", "belt", "gear", "axle"]
    rows = []
    for i in range(220):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 5))]
        if kind == 1 and i % 3 == 0:
            words = ["Common", "Industries", f"n{rng.randint(0, 60)}"]
        if kind == 2 and i % 4 == 0:
            words = rng.sample(long, rng.randint(6, 11)) + rng.choice([[], ["steel", "steel"]])
        if kind == 3:
            # chains: domain of the one before, key of the one after
            words = [f"link{(i + 1) // 2}", "chain"]
        website = rng.choice([None, None, f"https://www.d{rng.randint(0, 25)}.com/x", f"d{rng.randint(0, 25)}.com", "not a site", ""])
        if kind == 3:
            website = f"https://c{i // 2}.com"
        rows.append((i * 3, rng.choice([" ", " ", "  "]).join(words) if i % 50 else None, website, *[rng.choice([None, None, f"{c}{i}"]) for c in "lic"], "x"))
    order = list(range(len(rows)))
    if kind == 3:
        rng.shuffle(order)
        rows = [(k * 3, *rows[j][1:]) for k, j in enumerate(order)]
    return rows


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_companies(spark, kind, monkeypatch):
    rows = lists(kind)
    groups, tiers = by_hand(rows)
    if kind == 3:
        monkeypatch.setattr(C, "PEELED", 1)
    members, companies, flags = C.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {r.pos: (r.leader_pos, r.tier) for r in members.collect()} == tiers
    listed = {}
    for r in sorted(flags.collect(), key=lambda r: (r.pos, r.place)):
        listed.setdefault(r.pos, []).append(r.other_name)
    got = {r.leader_pos: (r.name, [r.website, r.linkedin, r.industry, r.country], r.n_contacts, r.flags + r.flagged_by) for r in companies.collect()}
    assert got == {g["pos"]: (g["name"], g["fields"], g["n"], len(g["flags"])) for g in groups}
    assert listed == {g["pos"]: g["flags"] for g in groups if g["flags"]}


def test_no_companies(spark):
    assert [x.count() for x in C.resolve(spark.createDataFrame([], SCHEMA))] == [0, 0, 0]
