"""Operators that SQL can't express, against brute force and by hand."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph, sequence, workflow
from corpusloom.operators.citations import mentions_of
from corpusloom.plans.engine import Plan, Scope, mentioned_works, resolve_scope
from corpusloom.sources import tables


def cost_of(cuts, tokens, paragraph, section, emergency, target, most):
    total = 0.0
    for a, z in cuts:
        size = sum(tokens[a:z])
        if size > most:
            return float("inf")
        total += (size / target - 1) ** 2 + (0.0 if section[z - 1] else 0.15 if paragraph[z - 1] else 0.35)
        total += max(0.0, (250 - size) / 250) ** 2 * (0.75 if z == len(tokens) else 1.0) + 0.5 * sum(emergency[a:z])
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.booleans(), st.booleans(), st.booleans()), min_size=1, max_size=8))
def test_segmentation_is_cheapest(units):
    tokens, paragraph, section, emergency = (list(c) for c in zip(*units, strict=True))
    found = sequence.best_cuts(tokens, paragraph, section, emergency, 600, 900)
    assert [a for a, _ in found] == [0, *[z for _, z in found[:-1]]] and found[-1][1] == len(tokens)
    every = []
    for n in range(len(tokens)):
        for inner in itertools.combinations(range(1, len(tokens)), n):
            edges = [0, *inner, len(tokens)]
            every.append(cost_of(list(itertools.pairwise(edges)), tokens, paragraph, section, emergency, 600, 900))
    assert cost_of(found, tokens, paragraph, section, emergency, 600, 900) == pytest.approx(min(every))


def test_diversify_caps_and_limit(spark):
    rows = [("q", i, f"c{i}", f"d{i % 2}", f"s{i % 3}", 1.0 / (i + 1), "volume topology" if i == 7 else "text") for i in range(10)]
    df = spark.createDataFrame(rows, "qid string, pos int, cand_id string, doc_id string, section_id string, score double, text string")
    out = sequence.diversified(df, "qid", 4, 2, 2, aspects=lambda q: ["volume"]).orderBy("rank").collect()
    assert out[0].cand_id == "c7" and len(out) == 4
    assert max(sum(r.doc_id == d for r in out) for d in ("d0", "d1")) <= 2


def test_budget(spark):
    df = spark.createDataFrame([("a", i, 900) for i in range(5)], "g string, o int, size int")
    assert [r.batch for r in sequence.budget_batches(df, "g", "o", "size", 2000, 80).orderBy("o").collect()] == [0, 0, 1, 1, 2]


def test_redirects_and_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "loser string, survivor string")
    assert {r.loser: r.survivor for r in graph.chase(df).collect()} == {"a": "d", "b": "d", "c": "d", "x": None, "y": None}


def test_mentions():
    found = mentions_of("See [1, 3–5] and (Smith et al., 2001); Jones and Lee 1999 say x in [0, 1] for [x+y].")
    assert [(k, i) for k, _, _, i in found] == [("bracket", "1, 3–5"), ("parenthesis", "Smith et al., 2001"), ("inline", "Jones and Lee 1999")]


def test_text_rules(spark):
    one = spark.createDataFrame([Row(t="The ABCD-Net for Deep Shape Volume", b="3–5; 7", bad="5-3", a="A. One, B. Two and C. Three")])
    r = one.select(
        T.aliases(F.col("t")).alias("al"), T.citation_atoms(F.col("b")).alias("at"), T.citation_atoms(F.col("bad")).alias("no"), T.split_authors(F.col("a")).alias("au"), T.surnames(F.col("a")).alias("su"),
        T.normalize_text(F.lit(" é  x \r\n\r\n\n\n y ")).alias("n"), T.plain_text(F.lit("a <b>b</b> &amp; c")).alias("p"), T.authors_compatible(F.lit("Ann Lee"), F.lit("A. Lee")).alias("c"),
    ).first()
    assert r.al[:2] == ["abcd net", "and"] or "abcd net" in r.al
    assert r.at == ["3", "4", "5", "7"] and r.no is None
    assert r.au == ["A. One", "B. Two", "C. Three"] and r.su == ["one", "two", "three"]
    assert r.n == "é x\n\ny" and r.p == "a b & c" and r.c


def test_transitions(spark):
    rows = [("j", 1, 1, "pending"), ("j", 2, 2, "parsing"), ("j", 3, 3, "completed"), ("j", 4, 4, "completed")]
    df = spark.createDataFrame(rows, "job string, ts int, id int, state string")
    assert [r.after for r in workflow.invalid_transitions(df, "job", "ts", "id", "state").collect()] == ["completed"]


def test_scope():
    phrases = {"deep shape": "w1", "mesh flow": "w2"}
    works = mentioned_works("Compare Deep Shape and mesh flow", phrases)
    assert sorted(works) == ["w1", "w2"]
    assert resolve_scope("Compare Deep Shape and mesh flow", works).rule == "compare"
    assert resolve_scope("What limits does Deep Shape itself report?", ["w1"]).sources == ("w1",)
    assert resolve_scope("What do later papers say of Deep Shape?", ["w1"]).excluded == ("w1",)
    assert resolve_scope("anything", []) == Scope()
    # Discussion comes before external; external and self take one work only; several works with a source cue have one source.
    assert resolve_scope("Discussion of Deep Shape by other papers", ["w1"]).rule == "discussion"
    assert resolve_scope("What do other papers say of both?", ["w1", "w2"]).rule == "unscoped"
    both = resolve_scope("According to Deep Shape, what of mesh flow?", ["w1", "w2"], titles={"w1": "Deep Shape", "w2": "Mesh Flow of all"})
    assert (both.sources, both.subjects, both.rule) == (("w1",), ("w2",), "source and subject")
    assert resolve_scope("Deep Shape itself: volume and topology", ["w1"], titles={"w1": "Deep Shape"}).topics[:2] == ("volume", "topology")
    assert Plan("truth").per_document() == 12 and Plan("associative").per_document() == 3 and Plan("associative").per_document(explicit=5) == 3


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    tables.write_once(df, path)
    with pytest.raises(Exception):
        tables.write_once(df, path)
    assert tables.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "id int, part string"), path, "id") == 1
    by = f"file://{tmp_path}/p"
    tables.replace_partitions(df, by, "part")
    tables.replace_partitions(spark.createDataFrame([(9, "a")], "id int, part string"), by, "part")
    assert sorted((r.id, r.part) for r in spark.read.parquet(by).collect()) == [(2, "b"), (9, "a")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\n..\n%%EOF\n")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    got = {r.path.rpartition("/")[2]: r.faults for r in tables.read_pdfs(spark, f"file://{tmp_path}/*.pdf").collect()}
    assert got["a.pdf"] == [] and got["b.pdf"] == ["header", "version", "end"]
    (tmp_path / "i.json").write_text('[{"type": "text", "text": "x", "page_idx": 0}, {"type": "text"}]')
    assert tables.read_items(spark, f"file://{tmp_path}/i.json").count() == 1
    names = spark.createDataFrame([("ok/a.txt",), ("../b",), ("C.md",), ("c.md",)], "name string")
    assert {r.name for r in tables.unsafe_members(names, "name").collect()} == {"../b", "C.md", "c.md"}


def test_engine_scores_every_document_in_scope(spark, tmp_path):
    from corpusloom.operators import ranking
    from corpusloom.plans.engine import Engine

    # Long texts of other works fill BM25's list; "subalphabet" holds the query's word, though not as a word.
    rows = [(i, "alpha beta " * 3, f"w{i % 50}") for i in range(300)] + [(900, "alpha " + "filler " * 200, "mine"), (901, "subalphabet betas alpha-beta-gamma", "mine"), (902, None, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    queries = spark.createDataFrame([(n, "alpha gamma alpha beta") for n in range(7)], "query_id long, query string")
    engine = Engine(spark, f"file://{tmp_path}")
    out = engine.query(queries, "comprehensive", Scope(sources=("mine",))).collect()
    assert {r.query_id for r in out} == set(range(7)) and {r.doc_id for r in out} == {900, 901}
    assert {r.doc_id: r.channels for r in out}[901] == "confirmed_knowledge,lexical"
    every = ranking.best_documents(docs, docs, queries, 80)
    ours = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in every.filter("channel = 'lexical'").collect())
    theirs = ranking.bm25(ranking.postings(docs, "doc_id", "text"), "doc_id", queries, "query_id", "query", 80)
    assert ours == sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in theirs.collect())
    first = every.filter("channel = 'confirmed_knowledge' AND query_id = 3 AND rank = 1").first()
    assert (first.doc_id, first.score) == (901, 3.0)
    graph = spark.createDataFrame([(3, 902, 1), (3, 5, 2)], "query_id long, doc_id long, rank int")
    more = engine.query(queries, "comprehensive", Scope(sources=("mine",)), others={"graph": graph}).filter("query_id = 3").collect()
    assert {r.doc_id: r.channels for r in more}[902] == "graph" and len(more) == 3


def test_bm25_topk(spark, monkeypatch):
    """Scores at the scan and by an index are the same, with documents whose score is rounded to nothing; documents aren't exploded."""
    from corpusloom.operators import ranking

    docs = spark.createDataFrame([(i, " ".join(["all"] + [f"w{j}" for j in range(i % 7)] + ["É_1"] * (i % 3) + ["x"] * (i // 50 * 200))) for i in range(60)] + [(99, None), (100, "...")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "all"), (2, "W1, w5 é_1 none"), (3, "nothing"), (4, None), (5, "w6 all")], "item_id long, text string")
    plain = lambda df: sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect())
    best = ranking.bm25_topk(docs, queries, "item_id", 80)
    assert "Generate" not in best._jdf.queryExecution().optimizedPlan().toString()
    got = plain(best)
    monkeypatch.setattr(ranking, "QUERIES_MOST", 2)
    assert got == plain(ranking.bm25_topk(docs, queries, "item_id", 80))
    assert sorted(r[2] for r in got if r[0] == 1) == list(range(60)) and got[59][3] == 0


def test_vector_topk(spark, monkeypatch):
    """Blocks of vectors against single cosines, with ties, missing and odd vectors."""
    import numpy as np
    from pyspark.sql import Window

    from corpusloom.operators import ranking

    made = np.random.default_rng(7).integers(-2, 3, (60, 3)).astype(float).tolist()
    rows = [(i, v, i % 3 if i % 10 else None) for i, v in enumerate(made)] + [(60, None, 0), (61, [1.0, None, 2.0], 0), (62, [1.0, 2.0], 1), (63, [0.0, 0.0, 0.0], 1), (64, [], 2), (65, [float("nan"), 1.0, 1.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = vectors.filter("vec_id % 7 = 0 OR vec_id > 58").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = vectors.crossJoin(queries).filter("vec_id <> query_id").select("query_id", "label", "vec_id", F.round(1.0 / (1.0 + F.greatest(1 - ranking.cosine(F.col("embedding"), F.col("q")), F.lit(0.0))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "vec_id"))
    plain = lambda df: sorted(map(repr, (tuple(r[c] for c in ("query_id", "label", "vec_id", "score", "rank")) for r in df.collect())))
    want = plain(pairs.withColumn("rank", rank).filter("rank <= 5"))
    for blocks in ((20_000, 2_000, 4_000, 1 << 20), (9, 4, 2, 1 << 20), (9, 4, 5, 0)):
        for name, value in zip(("VECTORS", "QUERIES", "AT_ONCE", "QUERY_BYTES"), blocks, strict=True):
            monkeypatch.setattr(ranking, name, value)
        assert plain(ranking.vector_topk(vectors, queries, 5, "label")) == want
    assert "zip_with" not in ranking.vector_topk(vectors, queries, 5, "label")._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_groups(spark):
    """Groups over several Arrow batches, each numbered by itself; columns that nothing needs are not moved."""
    rows = spark.range(400).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 > 0, "x").alias("h"), (400 - F.col("id")).alias("o"), (F.col("id") * 37 % 900).alias("size"), F.repeat(F.lit("long "), F.lit(99)).alias("text"))
    cells = {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        cells.setdefault((r["g"], r["h"]), []).append((r["o"], r["size"]))
    want = set()
    for (g, h), own in cells.items():
        for n, (o, _) in enumerate(own):
            want.add((g, h, o, sum(s for _, s in own[: n + 1])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        df = sequence.numbered(rows, ["g", "h"], "o", ["size"], "sum", lambda sizes: list(itertools.accumulate(sizes)))
        assert {tuple(r) for r in df.collect()} == want and df.count() == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "repeat" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sequence.numbered(rows.limit(0), ["g"], "o", ["size"], "sum", list).count() == 0


def test_citation_atoms(spark):
    """Ranges, mixed and unsound parts; each part's ends are looked for once."""
    cases = {"1-3; 7": ["1", "2", "3", "7"], "1 2–14, a": ["12", "13", "14", "a"], "3-1": None, "1-99": None, "a-b": ["a-b"], "1-21": [str(i) for i in range(1, 22)], "1-22": None, "5-5": None, " ; ,": None, "": None, None: None, "x, 2 — 4;y": ["x", "2", "3", "4", "y"], "1-2-3": ["1-2-3"]}
    df = spark.createDataFrame([(c,) for c in cases], "inner string").select("inner", T.citation_atoms(F.col("inner")).alias("atoms"))
    assert {r["inner"]: r["atoms"] for r in df.collect()} == cases
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2


def test_dealt_parts(spark, monkeypatch):
    """Parts are as many as the rows ask for, and are not merged before the work on them."""
    from corpusloom.operators import relational as R
    from corpusloom.queries import Tables, filters_joins

    monkeypatch.setattr(R, "PART_ROWS", 100)
    assert R.dealt(spark.range(950), "id").rdd.getNumPartitions() == 10
    t = Tables(spark, "/root/testdata/sf0.001")
    assert filters_joins.subset_equality(t).rdd.getNumPartitions() == t.lineitem.count() // 100 + 1
