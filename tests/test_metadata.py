"""Metadata of documents against a plain reading of the rules, item by item."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from corpusloom.operators import metadata as M

LONG = "word " * 120
DOCS = {
    1: [("text", 1, 0, "A <i>Study</i> of Rings"), ("text", None, 0, "Ann Lee<sup>1</sup>, Bo Ray* and Cy"), ("text", None, 0, "<sup>1</sup>Institute of Rings, 12 Long Street, Ringtown"), ("text", 2, 0, "ABSTRACT"), ("text", None, 0, "We study."), ("text", None, 0, "Keywords: a, b; c"), ("text", 2, 0, "1 Intro"), ("text", None, 0, LONG)],
    2: [("header", None, 0, "Press 2003 and 2004"), ("text", None, 0, "On bolts"), ("text", None, 0, "A. One, and B. Two. 1999. On Bolts. ACM Press"), ("text", None, 3, "doi:10.1000/ABC.1.")],
    3: [("text", None, 0, "On nuts"), ("text", 2, 0, "Part"), ("text", None, 0, "Ann Lee, Bo Ray"), ("text", None, 0, "Figure 1 " + LONG), ("text", None, 0, LONG + "end 2001 2002 2001 12003"), ("text", None, 0, "Additional Key Words and Phrases: x; y, z")],
    4: [("header", None, 1, "2010"), ("table", None, 0, "no title")],
    5: [("text", 1, 0, "Some title"), ("text", None, 0, ""), ("text", None, 0, "Received 2 May, late"), ("text", None, 0, "Ann Lee, Bo Ray"), ("text", None, 0, "Publication date: 1 May 2015, © 2016")],
    6: [("text", 1, 0, "Copper wires at low heat"), ("text", None, 0, "X. Y. 2001. Copper wires at low heat!. IEEE T"), ("text", 2, 1, "Abstract"), ("text", 3, 1, "Abstract"), ("text", None, 1, "late")],
    7: [("text", 1, 0, "Ties"), ("text", None, 0, "Seen 2005, 2006"), ("text", None, 0, "Ann Lee & Bo Ray"), ("text", None, 0, "Keywords: "), ("text", None, 0, "Keywords: q")],
}


def bare(raw):
    return re.sub(r"\s+", " ", re.sub("<[^>]+>", "", raw)).strip()


def by_hand(rows):
    texts = [bare(r[3]) for r in rows]
    found = next((t for r, t in zip(rows, texts) if r[1] == 1 and t), None) or next((t for r, t in zip(rows, texts) if r[0] == "text" and t), None)
    if found is None:
        return None
    title = found
    for t in texts[:40]:
        m = re.search(M.CITED_TITLE, t)
        if m and SequenceMatcher(None, found.lower(), m[1].lower()).ratio() >= 0.85:
            title = m[1]
            break
    people = None
    for t in texts[:50]:
        m = re.match(M.CITED_AUTHORS, t)
        if title.lower() in t.lower() and m:
            names = [n.strip(" ,.") for n in re.split(r"\s*,\s*(?:and\s+)?|\s+and\s+", m[1])]
            if names and all(2 <= len(n.split()) <= 8 for n in names):
                people = names
                break
    if people is None:
        people, plain = [], [bare(re.sub("(?i)<sup>.*?</sup>", "", r[3])) for r in rows]
        for r, t in list(zip(rows, plain))[plain.index(title) + 1 if title in plain else len(rows) :]:
            if t and (r[1] is not None or re.match(M.BYLINE_ENDS, t)):
                break
            if t and len(t) <= 350 and re.search(r"(?i),|\s(and|&)\s", t):
                people = [n.strip(" ,;*†‡") for n in re.split(r"\s*,\s*|\s+(?:and|&)\s+", t)]
                people = [n for n in people if 2 <= len(n.split()) <= 7 and not re.search(r"\d", n)]
                break
    at = next((i for i, r in enumerate(rows) if r[1] is not None and re.sub(r"^\d+\s+", "", texts[i]).lower() == "abstract"), None)
    block = []
    for r, t in list(zip(rows, texts))[len(rows) if at is None else at + 1 :]:
        if r[1] is not None or t.lower().startswith("keywords:"):
            break
        block += [t] if t else []
    cut = next((i for i, r in enumerate(rows) if r[1] is not None and re.match(M.NUMBERED, texts[i])), len(rows))
    abstract = "\n".join(block) or next((t for r, t in zip(rows[:cut], texts) if r[0] == "text" and len(t) >= 500 and not re.match(M.FIGURE_STARTS, t)), None)
    line = next((t for t in texts if re.match(M.KEYWORD_STARTS, t)), "")
    words = [w.strip() for w in re.split("[;,]" if line.lower().startswith("keywords:") else ",", line.partition(":")[2]) if w.strip()]
    places = [t for r, t in list(zip(rows, texts))[:20] if re.match("(?i)<sup>[a-z0-9]+</sup>", r[3]) and len(r[3]) > 40]
    doi = re.search(M.DOI, "\n".join(r[3] for r in rows))
    common = lambda ys: max(Counter(ys).items(), key=lambda x: (x[1], x[0]))[0] if ys else None
    page = "\n".join(t for r, t in zip(rows, texts) if r[2] == 0)
    margin = re.findall(M.YEAR, "\n".join(t for r, t in zip(rows, texts) if r[2] == 0 and r[0] in ("header", "footer")))
    ruled = next((m[1] for p in M.YEAR_RULES if (m := re.search(p, page))), None)
    year = common(margin) or ruled or common(re.findall(M.YEAR, "\n".join(texts[:cut])))
    return title, people, abstract, words, places, doi and doi[1].lower().rstrip("."), year and int(year)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(d, i, *r, bare(r[3])) for d, rs in DOCS.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "doc long, pos int, kind string, level int, page int, raw string, text string")


def test_metadata(items):
    got = {r["doc"]: tuple(r[c] for c in ("title", "authors", "abstract", "keywords", "affiliations", "doi", "year")) for r in M.document_metadata(items).collect()}
    assert got == {d: h for d, rs in DOCS.items() if (h := by_hand(rs))}
    assert 4 not in got
    assert got[1][1] == ["Ann Lee", "Bo Ray"] and got[5][1] == [] and got[6][0] == "Copper wires at low heat!"


def test_registered_metadata(spark):
    """The registered query over its whole table, by hand."""
    from corpusloom.queries import Tables, papers

    t = Tables(spark, "/root/testdata/sf0.001")
    docs = {}
    for r in sorted(papers.items(t).collect(), key=lambda r: (r["doc"], r["pos"])):
        docs.setdefault(r["doc"], []).append((r["kind"], r["level"], r["page"], r["raw"]))
    got = {r["doc"]: (r["title"], r["authors"], r["abstract"], r["keywords"], r["affiliations"], r["doi"], r["year"]) for r in papers.document_metadata(t).collect()}
    flat = lambda h: (h[0], "|".join(h[1]), h[2], "|".join(h[3]), "|".join(h[4]), h[5], h[6])
    assert got == {d: flat(by_hand(rs)) for d, rs in docs.items()}


def test_no_items(spark, items):
    assert M.document_metadata(items.limit(0)).collect() == []


@pytest.mark.parametrize("query", ["document_metadata", "named_block", "document_years", "affiliations_and_doi"])
def test_no_broadcast(spark, query):
    """Items are far larger than the columns they are made of, by which plans judge them: no table of documents goes to the driver."""
    from corpusloom.queries import Tables, papers

    plan = getattr(papers, query)(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
