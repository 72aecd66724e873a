"""Audits over whole tables: line items as claims about parts, orders as facts, events as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import audit as A

from . import query


@query("SELECT p_partkey, kind, kind LIKE 'claim%' OR kind = 'ClaimDataPoint' AS is_claim FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'claim_result' WHEN 2 THEN 'ClaimDataPoint' WHEN 3 THEN 'Claims' ELSE p_type END AS kind FROM part)")
def claim_type_predicate(t):
    m = F.col("p_size") % 5
    kind = F.when(m == 0, "claim").when(m == 1, "claim_result").when(m == 2, "ClaimDataPoint").when(m == 3, "Claims").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", kind.alias("kind")).withColumn("is_claim", A.is_claim(F.col("kind")))


@query("""WITH f AS (SELECT o_orderkey, count(l_orderkey) > 0 AS a, bool_or(l_returnflag = 'R') AS b, bool_or(l_returnflag = 'R' AND l_discount > 0.03) AS c, max(l_quantity) > 45 AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN NOT a THEN 'not extracted' WHEN NOT coalesce(b, false) THEN 'no subject edge' WHEN NOT coalesce(c, false) THEN 'filtered' WHEN NOT coalesce(d, false) THEN 'not ranked' END AS reason FROM f""")
def claim_coverage(t):
    facts = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(
        (F.count("l_orderkey") > 0).alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.03)).alias("c"), (F.max("l_quantity") > 45).alias("d")
    )
    return A.coverage(facts, [F.col(x) for x in "abcd"]).select("o_orderkey", "reason")


@query("""WITH c AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE l_discount > 0.05), b AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem WHERE l_tax < 0.02)
SELECT l_returnflag, count(*) AS facts, count(b.l_partkey) AS shared, count(b.l_partkey) / count(*) AS share FROM c LEFT JOIN b USING (l_returnflag, l_partkey) GROUP BY 1""")
def claim_redundancy(t):
    return A.redundancy(t.lineitem.filter("l_discount > 0.05"), t.lineitem.filter("l_tax < 0.02"), "l_returnflag", "l_partkey")


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'), s AS (SELECT DISTINCT l_orderkey, l_suppkey, l_suppkey % 7 = 0 AS own FROM lineitem WHERE l_linestatus = 'O' OR l_quantity > 20),
g AS (SELECT coalesce(e.l_orderkey, s.l_orderkey) AS l_orderkey, count(e.l_suppkey) AS expected, count(s.l_suppkey) AS stored, count(CASE WHEN e.l_suppkey = s.l_suppkey THEN 1 END) AS matched, count(CASE WHEN own THEN 1 END) AS self_targets FROM e FULL JOIN s ON e.l_orderkey = s.l_orderkey AND e.l_suppkey = s.l_suppkey GROUP BY 1)
SELECT *, CASE WHEN matched = 0 THEN 'MISSING' WHEN matched = expected AND stored = expected THEN 'MATCH' ELSE 'PARTIAL' END AS verdict FROM g""")
def about_audit(t):
    stored = t.lineitem.filter("l_linestatus = 'O' OR l_quantity > 20").withColumn("own", F.col("l_suppkey") % 7 == 0)
    return A.about_audit(t.lineitem.filter("l_returnflag <> 'A'"), stored, "l_orderkey", "l_suppkey", "own")


@query("SELECT event_type, avg((value > 10)::INT) AS has_page, avg((json_extract_string(props, '$.k')::BIGINT > 5)::INT) AS has_source FROM events GROUP BY 1")
def answer_quality(t):
    return A.answer_quality(t.events, "event_type", {"has_page": F.col("value") > 10, "has_source": F.get_json_object("props", "$.k").cast("long") > 5})


@query("""WITH u AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT page_id FROM pages) SELECT id, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM u""")
def benchmark_cases(t):
    return A.unique_cases([t.documents.select(F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id"))], "id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40) THEN 'FIXTURE_COVERED' ELSE 'UNREVIEWED' END AS review FROM lineitem""")
def manual_review(t):
    return A.review_rows(t.lineitem, t.lineitem.filter("l_quantity > 40"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "review")


@query("""WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), x AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.01), y AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.02)
SELECT l_partkey, l_suppkey, CASE WHEN (l_partkey, l_suppkey) NOT IN (SELECT * FROM x) THEN 'resolution' ELSE 'graph' END AS lost_in FROM e WHERE (l_partkey, l_suppkey) NOT IN (SELECT * FROM x) OR (l_partkey, l_suppkey) NOT IN (SELECT * FROM y)""")
def resolution_diagnostics(t):
    return A.lost_edges(t.lineitem, {"resolution": t.lineitem.filter("l_tax > 0.01"), "graph": t.lineitem.filter("l_discount > 0.02")}, ["l_partkey", "l_suppkey"])


@query("""SELECT l_returnflag AS type, count(*) AS edges, count(DISTINCT (l_partkey, l_suppkey)) AS distinct_edges, count(CASE WHEN s_acctbal < 0 AND l_quantity > 25 THEN 1 END) AS fake_provenance, l_returnflag IN ('R', 'N') AS backbone FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def stored_graph_contract(t):
    edges = t.lineitem.select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_quantity") > 25, F.array("l_orderkey")).otherwise(F.array().cast("array<bigint>")).alias("chunks"))
    works = t.supplier.select(F.col("s_suppkey").alias("work"), (F.col("s_acctbal") >= 0).alias("has_document"))
    return A.stored_contract(edges, works, ["R", "N"])


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity < 5 OR l_tax = 0")
def leak_failures(t):
    li = t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", "l_tax")
    return A.distinct_failures(li.filter("l_quantity < 5").select("l_orderkey", "l_returnflag"), li.filter("l_tax = 0").select("l_orderkey", "l_returnflag"))


@query("""SELECT DISTINCT l_orderkey % 100 AS source, s_suppkey AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND l_orderkey % 100 <> s_suppkey""")
def corpus_signature(t):
    refs = t.lineitem.select((F.col("l_orderkey") % 100).alias("source"), "l_suppkey")
    works = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("work"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("document"))
    return A.corpus_edges(refs, works, "source", "l_suppkey", "work", "document")


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 300 THEN 'minimum length' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN quality IS NULL OR quality = 0 THEN 'quality' END], lambda x: x IS NOT NULL)) AS rule FROM documents LEFT JOIN labels USING (doc_id)""")
def expected_structure(t):
    return A.expectations(t.documents.join(t.labels, "doc_id", "left"), "doc_id", {"minimum length": F.col("n_chars") >= 300, "language": F.col("lang") == "en", "quality": F.col("quality") == 1})
