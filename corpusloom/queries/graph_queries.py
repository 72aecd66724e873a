"""Graph operators on whole tables: parts, suppliers, customers and nations as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G

from . import query

EDGES = """SELECT 'n' || n_nationkey AS src, 'IN' AS type, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'USES', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'RELATED_TO', 'n' || c_nationkey FROM customer"""


def edges(t):
    """Edges of nations, suppliers and customers, as in EDGES."""
    n = lambda p, c: F.concat(F.lit(p), c)
    e = t.nation.select(n("n", "n_nationkey").alias("src"), F.lit("IN").alias("type"), n("r", "n_regionkey").alias("dst"))
    e = e.union(t.supplier.select(n("s", "s_suppkey"), F.lit("USES"), n("n", "s_nationkey")))
    return e.union(t.customer.select(n("c", "c_custkey"), F.lit("RELATED_TO"), n("n", "c_nationkey")))


def nodes(t):
    n = lambda p, c: F.concat(F.lit(p), c)
    x = t.nation.select(n("n", "n_nationkey").alias("node"), F.col("n_name").alias("name"))
    x = x.union(t.region.select(n("r", "r_regionkey"), "r_name")).union(t.supplier.select(n("s", "s_suppkey"), "s_name"))
    return x.union(t.customer.select(n("c", "c_custkey"), "c_name"))


@query(f"""WITH e AS (SELECT src AS a, dst AS b FROM ({EDGES}) UNION SELECT dst, src FROM ({EDGES})), s0 AS (SELECT 's1' AS node, 1.0 AS s UNION ALL SELECT 's2', 0.5),
f1 AS (SELECT b AS node, max(s * 0.85) AS s FROM s0 JOIN e ON a = node GROUP BY 1), f2 AS (SELECT b AS node, max(s * 0.85) AS s FROM f1 JOIN e ON a = node GROUP BY 1)
SELECT node, round(max(s), 9)::DOUBLE AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY node""")
def khop_decay(t):
    seeds = t.spark.createDataFrame([("s1", 1.0), ("s2", 0.5)], "node string, score double")
    return G.hops(edges(t), seeds, 2)


@query(f"""SELECT src, dst, 'm' || dst || ',k' || src AS chunks FROM ({EDGES}) WHERE type = 'USES' AND dst IN ('n1', 'n2', 'n3') ORDER BY dst, src LIMIT 500""")
def incoming_typed_edges(t):
    e = edges(t).withColumn("chunks", F.array(F.concat(F.lit("m"), "dst")))
    n = nodes(t).withColumn("chunks", F.array(F.concat(F.lit("k"), "node")))
    targets = t.spark.createDataFrame([("n1",), ("n2",), ("n3",)], "target string")
    return G.incoming(e, n, "USES", targets, 500).select("src", "dst", F.array_join("chunks", ",").alias("chunks"))


@query(f"""SELECT 'triplet_' || left(sha256('corpusloom' || chr(31) || 'triplet' || chr(31) || '1' || chr(31) || src || chr(31) || type || chr(31) || dst || chr(31) || 'm' || dst), 32) AS node, a.name || ' ' || lower(replace(type, '_', ' ')) || ' ' || b.name AS text
FROM ({EDGES}) JOIN (SELECT 'n' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer) a ON a.node = src
JOIN (SELECT 'n' || n_nationkey AS node, n_name AS name FROM nation) b ON b.node = dst WHERE type IN ('USES', 'RELATED_TO')""")
def triplet_nodes(t):
    return G.triplets(edges(t).withColumn("chunks", F.array(F.concat(F.lit("m"), "dst"))), nodes(t)).select("node", "text")


@query("""WITH x AS (SELECT l_partkey % 50 AS src, l_returnflag AS type, l_suppkey % 20 AS dst, l_orderkey * 10 + l_linenumber AS pos, 'o' || (l_orderkey % 30) AS chunk FROM lineitem)
SELECT src, type, dst, array_to_string(list(chunk ORDER BY p), ',') AS chunks FROM (SELECT src, type, dst, chunk, min(pos) AS p FROM x GROUP BY ALL) GROUP BY ALL""")
def consolidate_edges(t):
    x = t.lineitem.select((F.col("l_partkey") % 50).alias("src"), F.col("l_returnflag").alias("type"), (F.col("l_suppkey") % 20).alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.array(F.concat(F.lit("o"), F.col("l_orderkey") % 30)).alias("chunks"))
    return G.consolidate(x).select("src", "type", "dst", F.array_join("chunks", ",").alias("chunks"))


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS loser, (c_custkey // 2)::BIGINT AS survivor FROM customer WHERE c_custkey > 1), c AS (SELECT loser, survivor, 1 AS d FROM r UNION ALL SELECT c.loser, r.survivor, d + 1 FROM c JOIN r ON r.loser = c.survivor)
SELECT loser, arg_max(survivor, d) AS survivor FROM c GROUP BY loser""")
def redirect_chase(t):
    r = t.customer.filter("c_custkey > 1").select(F.col("c_custkey").alias("loser"), F.floor(F.col("c_custkey") / 2).cast("long").alias("survivor"))
    return G.chase(r)


@query()
def merge_components(t):
    """Over all line items; recursive SQL is too slow for them."""
    return G.components(t.lineitem.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct())


@query("""WITH w AS (SELECT p_partkey AS id, p_brand AS b, p_size, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS pr FROM part)
SELECT id AS work_id, first_value(id) OVER (PARTITION BY b ORDER BY pr, p_size, id) AS survivor FROM w""")
def merge_survivors(t):
    w = t.part.select(F.col("p_partkey").alias("work_id"), F.when(F.col("p_size") % 3 == 0, "ingested").when(F.col("p_size") % 3 == 1, "identified").otherwise("provisional").alias("status"), F.col("p_size").alias("created_at"), "p_brand")
    first = w.groupBy("p_brand").agg(F.min("work_id").alias("src"))
    same = w.join(first, "p_brand").filter("work_id <> src").select("src", F.col("work_id").alias("dst"))
    return G.survivors(w.drop("p_brand"), same)


@query("""SELECT doc_id, 'HAS_CHUNK' AS type, 'c' || doc_id AS target FROM documents UNION ALL SELECT doc_id, 'REPRESENTS_WORK', source FROM documents UNION ALL SELECT doc_id, 'HAS_LABEL', 'q' || quality FROM labels""")
def structural_relations(t):
    rel = lambda df, kind, target: df.select("doc_id", F.lit(kind).alias("type"), target.alias("target"))
    r = rel(t.documents, "HAS_CHUNK", F.concat(F.lit("c"), "doc_id")).unionByName(rel(t.documents, "REPRESENTS_WORK", F.col("source")))
    return r.unionByName(rel(t.labels, "HAS_LABEL", F.concat(F.lit("q"), "quality")))


@query("""SELECT l_orderkey, 'DERIVED_FROM' AS type, 'p' || l_partkey AS target FROM lineitem UNION ALL SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'USES' ELSE 'RELATED_TO' END, 's' || l_suppkey FROM lineitem WHERE l_returnflag <> 'A'""")
def semantic_relations(t):
    li = t.lineitem
    derived = li.select("l_orderkey", F.lit("DERIVED_FROM").alias("type"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    typed = li.filter("l_returnflag <> 'A'").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "USES").otherwise("RELATED_TO").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return derived.union(typed)


@query("""SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN trim(p_name) <> '' THEN 'part.name' END, CASE WHEN p_size > 10 THEN 'part.type' END]) AS field FROM part) WHERE field IS NOT NULL GROUP BY field""")
def vector_groups(t):
    fields = F.array_compact(F.array(F.when(F.trim("p_name") != "", "part.name"), F.when(F.col("p_size") > 10, "part.type")))
    return t.part.select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS cited FROM orders GROUP BY 1""")
def work_catalogue(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    three = t.orders.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return three.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("cited"))


@query("""SELECT page_id, i::INT AS pos, CASE WHEN i = 0 THEN 'title' ELSE 'paragraph' END AS kind FROM (SELECT page_id, unnest(range(0, len(regexp_extract_all(html, '<(p|h1)>')))) AS i FROM pages)""")
def element_builder(t):
    marks = F.regexp_extract_all("html", F.lit("<(p|h1)>"), F.lit(1))
    return t.pages.select("page_id", F.posexplode(marks).alias("pos", "tag")).select("page_id", "pos", F.when(F.col("tag") == "h1", "title").otherwise("paragraph").alias("kind"))


@query()
def citation_mentions(t):
    from corpusloom.operators.citations import extract_mentions

    text = F.concat(F.lit("As shown in ["), "p_size", F.lit("–"), F.col("p_size") + 2, F.lit("] and (Smith et al., 2001), "), "p_name", F.lit(" holds; x in [0, 1]."))
    return extract_mentions(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")


@query("""SELECT p_partkey, array_to_string(range(p_size, p_size + 3), ',') AS keys FROM part""")
def bracket_atoms(t):
    return t.part.select("p_partkey", F.array_join(T.citation_atoms(F.concat("p_size", F.lit("-"), F.col("p_size") + 2)), ",").alias("keys"))
