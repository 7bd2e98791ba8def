"""Segments and leaders against plain regular expressions over every blob."""

import re

import pytest

from granary.operators import segments as P
from granary.plans import segments as plans

regex = pytest.importorskip("regex")


@pytest.fixture(scope="module")
def blobs(spark):
    texts = [None, "", "  \n", "no mark at all\n### Ram Bhogale\n\n#### Chairman\nheads the Water business of the group."]
    texts += ["--- PAGE: a --- PAGE: b ---\ntext\n[SOURCE: x | tier1 | u]\nmore", "--- PAGE: x ---\n \n--- PAGE: y (u(v)) ---\nz", "--- PAGE: never ended\n[SOURCE: earnings|tier2|v] \n\n  body \n[SOURCE: y | tier3 | w]\n"]
    for i in range(120):
        people, marks = plans._PEOPLE, plans._MARKS
        texts.append(marks[i % 6] + people[i % 10] + "\n" + marks[i // 3 % 6] + people[i // 7 % 10] + plans._SOURCES[i // 2 % 6] + people[i // 11 % 10])
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k long, content string, text string")


def segments_by_hand(content):
    out = []
    for m in re.finditer(P.PAGE_MARK + P.PAGE_HEAD + rf"([\s\S]*?)(?={P.PAGE_MARK}|\Z)", content or "", re.I):
        head, url = m[1].strip(), re.search(r"\(([^)]+)\)", m[1].strip())
        if m[2].strip():
            out.append((url[1] if url else head, m[2].strip()))
    for m in re.finditer(P.SOURCE_MARK + P.SOURCE_HEAD + rf"([\s\S]*?)(?={P.SOURCE_MARK}|\Z)", content or "", re.I):
        if m[4].strip():
            out.append((m[3].strip(), m[4].strip()))
    return out or ([("", content)] if (content or "").strip() else [])


def leaders_by_hand(parts):
    seen, out = set(), []
    for url, text in parts:
        for m in regex.finditer(P.HEADED, text):
            clause = re.search(P.PORTFOLIO, text[m.end() : m.end() + P.WITHIN], re.I)
            if clause and m[1].strip() not in seen:
                seen.add(m[1].strip())
                out.append((m[1].strip(), m[2].strip(), clause[1].strip(), url, "high"))
    for url, text in parts:
        for m in regex.finditer(P.BESIDE, text, regex.M):
            name = m[1].strip()
            words = name.split()
            if name not in seen and 2 <= len(words) <= 4 and not any(w.lower() in P.G.NON_NAME_WORDS for w in words):
                seen.add(name)
                out.append((name, m[2].strip(), "", url, "medium"))
    return sorted(out)


def test_segments_and_leaders(blobs):
    parts, got, people = P.segments(blobs, "k"), {}, {}
    for r in parts.orderBy("k", "seg_no").collect():
        got.setdefault(r.k, []).append((r.url, r.text))
    for r in P.leaders(parts, "k").collect():
        people.setdefault(r.k, []).append((r.name, r.title, r.portfolio, r.url, r.confidence))
    n = 0
    for r in blobs.collect():
        want = segments_by_hand(r.content)
        assert got.get(r.k, []) == want, r.content
        assert sorted(people.get(r.k, [])) == leaders_by_hand(want), r.content
        n += len(people.get(r.k, []))
    assert n > 200


def test_source_tiers(blobs):
    rows = P.segments(blobs.where("k = 6"), "k").collect()
    assert [(r.page_type, r.tier, r.url, r.text) for r in rows] == [("investor", 2, "v", "body")]
