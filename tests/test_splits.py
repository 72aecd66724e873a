"""Splits against plain recursive readings of their rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import splits as S


def words(s):
    return len(s.split())


def by_hand(text, a, b, limit):
    """[start, end, kind] by halving at the nearest space, marks of outer cuts written last."""
    if words(text[a:b]) <= limit:
        return [[a, b, "force"]]
    middle = a + (b - a) // 2
    at = next((i for i in range(middle, a, -1) if text[i - 1].isspace() and words(text[a:i]) <= limit), None)
    if at is None:
        at = next((i for i in range(middle, b) if text[i].isspace() and i > a and words(text[a:i]) <= limit), None)
    kind = "force" if at is None else "space"
    at = middle if at is None else at
    left, right = by_hand(text, a, at, limit), by_hand(text, at, b, limit)
    left[-1][2] = right[0][2] = kind
    return left + right


def rows_by_hand(text, limit):
    lines = text.split("\n")
    if words(text) <= limit or len(lines) <= 2:
        return [text]
    parts, now = [], lines[:2]
    for row in lines[2:]:
        if words("\n".join([*now, row])) > limit:
            parts, now = [*parts, "\n".join(now)], [*lines[:2], row]
        else:
            now = [*now, row]
    return [*parts, "\n".join(now)]


def test_forced_pieces():
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice("ab  \nc") for _ in range(r.randint(0, 120)))
        for limit in (1, 3, 7):
            got = S.forced_pieces(text, limit, words)
            assert [list(p) for p in got] == by_hand(text, 0, len(text), limit)
            assert "".join(text[a:b] for a, b, _ in got) == text
    # Characters as tokens: nothing but force helps where there is no space.
    assert [p[2] for p in S.forced_pieces("x" * 40, 10, len)] == ["force"] * 4
    assert S.forced_pieces("xy", 0, len) == [(0, 1, "force"), (1, 2, "force")]


def test_table_parts(spark):
    r = random.Random(6)
    texts = ["\n".join(" ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 9))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", S.table_parts(F.col("text"), 9).alias("p"))
    assert {x["i"]: x["p"] for x in df.collect()} == {i: None if t is None else rows_by_hand(t, 9) for i, t in enumerate(texts)}


def test_registered_splits(spark):
    from corpusloom.queries import Tables, papers

    t = Tables(spark, "/root/testdata/sf0.001")
    texts = {x["doc_id"]: x["text"] for x in t.documents.collect()}
    got = {}
    for x in papers.forced_splits(t).orderBy("doc_id", "piece").collect():
        got.setdefault(x["doc_id"], []).append((x["start"], x["end"]))
    assert set(got) == {d for d, text in texts.items() if text is not None}
    for d, pieces in got.items():
        assert "".join(texts[d][a:b] for a, b in pieces) == texts[d]
        assert all(words(texts[d][a:b]) <= 64 for a, b in pieces)
