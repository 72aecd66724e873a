"""Whole-table graph and phrase queries against brute force on a small fixture."""

from __future__ import annotations

import re

import pytest

from corpusloom.queries import load


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('whole')}"

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")

    put("region", [(0, "R")], "r_regionkey int, r_name string")
    put("nation", [(1, "N1", 0), (2, "N2", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("supplier", [(1, "S1", 1), (2, "S2", 2)], "s_suppkey long, s_name string, s_nationkey int")
    put("customer", [(i, f"C{i}", 1 + i % 2) for i in range(1, 13)], "c_custkey long, c_name string, c_nationkey int")
    # A chain of parts 290 to 320 with quantities other than 50, and one apart.
    put("lineitem", [(p, s, 1 + p % 9) for p in range(290, 321) for s in (p, p + 1)] + [(900, 5, 1)], "l_partkey long, l_suppkey long, l_quantity int")
    put("part", [(i, f"B{i % 2}", size) for i, size in enumerate([45, 44, 41, 50, 48, 42, 40])], "p_partkey long, p_brand string, p_size int")
    put("documents", [(1, "so A b, c d e."), (2, "a b c d f"), (3, "xa b c d e"), (4, "a b c x a b c d e"), (5, "q r"), (6, None)], "doc_id long, text string")
    put("benchmark", [(1, "a b c d e"), (2, "q R"), (3, "..."), (4, None)], "item_id long, text string")
    return path


def run(spark, folder, name):
    return [tuple(r) for r in load()[name].run(spark, folder).collect()]


def test_hops_and_triplets(spark, folder):
    got = dict(run(spark, folder, "khop_decay"))
    want = {"s1": 1.0, "s2": 0.5, "n1": 0.85, "n2": 0.425, "r0": 0.7225}
    want |= {f"c{i}": 0.36125 if i % 2 else 0.7225 for i in range(1, 13)}
    assert got == pytest.approx(want)
    texts = sorted(x[1] for x in run(spark, folder, "triplet_nodes"))
    assert texts == sorted([f"C{i} related to N{1 + i % 2}" for i in range(1, 13)] + ["S1 uses N1", "S2 uses N2"])


def test_components(spark, folder):
    near: dict[int, set[int]] = {}
    for p, s, in [(p, s) for p in range(290, 321) for s in (p, p + 1)] + [(900, 5)]:
        near.setdefault(p, set()).add(-s)
        near.setdefault(-s, set()).add(p)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert dict(run(spark, folder, "merge_components")) == want


def test_survivors(spark, folder):
    parts = [(i, i % 2, size) for i, size in enumerate([45, 44, 41, 50, 48, 42, 40])]
    best = {b: min(((s % 3, s, i) for i, c, s in parts if c == b))[2] for b in (0, 1)}
    assert dict(run(spark, folder, "merge_survivors")) == {i: best[b] for i, b, _ in parts}


def test_phrases(spark, folder):
    words = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = sorted((d, i) for d, t in docs for i, p in items if words(p) and f" {words(p)} " in f" {words(t)} ")
    assert sorted(run(spark, folder, "contains_phrase_join")) == want == [(1, 1), (4, 1), (5, 2)]
