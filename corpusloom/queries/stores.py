"""Snapshots, bundles, tombstones and manifests over orders as snapshots of customers' documents and line items as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import store as S

from . import query

GONE = "SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal < 0"


def gone(t):
    return t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))


def items(t):
    return t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def snapshots_in_order(t):
    return S.snapshots_in_order(t.orders, "o_orderkey", "o_orderdate")


@query("SELECT 'orders' AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'items', count(*), sum(l_linenumber)::BIGINT FROM lineitem WHERE l_orderkey = 7")
def load_bundle(t):
    own = S.bundle({"orders": t.orders.withColumn("id", F.col("o_orderkey")), "items": items(t).withColumn("id", F.col("l_linenumber"))}, "o_orderkey", 7)
    parts = [df.agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids")).withColumn("part", F.lit(name)) for name, df in own.items()]
    return parts[0].unionByName(parts[1]).select("part", "n", "ids")


@query("SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def chunk_projection(t):
    return S.chunk_projection(t.orders.filter("o_orderstatus = 'F'"), items(t), "o_orderkey", ["l_linenumber", "l_partkey"])


@query(f"""WITH n AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS chunks, o_custkey IN ({GONE}) AS deleted FROM n""")
def documents_with_counts(t):
    return S.listing(t.orders, items(t), gone(t), "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority", "chunks", "deleted")


@query("""SELECT o_custkey, array_to_string(list(DISTINCT o_orderkey ORDER BY o_orderkey), ',') AS snapshots, sum(n)::BIGINT AS chunks FROM (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY 1""")
def inspect_documents(t):
    return S.inspect(t.orders, items(t), "o_custkey", "o_orderkey").withColumn("snapshots", F.array_join("snapshots", ","))


@query(f"SELECT c_custkey AS o_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS removed FROM customer c WHERE c_acctbal < 0")
def tombstone_delete(t):
    _, _, report = S.delete(gone(t).limit(0), gone(t), t.orders, "o_custkey")
    return report


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def reprocess_documents(t):
    again = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.restore(t.orders, again, "o_custkey")


@query(f"SELECT DISTINCT o_custkey FROM ({GONE})")
def tombstone_set(t):
    return S.deleted(gone(t), "o_custkey")


@query(f"""WITH n AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS ready FROM n WHERE o_custkey NOT IN ({GONE})""")
def rebuild_selection(t):
    rich = items(t).filter("l_returnflag = 'R'")
    return S.rebuild(t.orders, gone(t), rich, "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", "ready")


@query("""SELECT n_regionkey, '{"nodes":' || nodes || ',"edges":' || coalesce(edges, 0) || ',"types":{' || types || '}}' AS manifest FROM
(SELECT n_regionkey, sum(n)::BIGINT AS nodes, string_agg('"' || seg || '":' || n, ',' ORDER BY seg) AS types FROM (SELECT n_regionkey, c_mktsegment AS seg, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1)
LEFT JOIN (SELECT n_regionkey, count(*) AS edges FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (n_regionkey)""")
def persist_manifest(t):
    nodes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return S.manifest(nodes, edges, "n_regionkey", "c_custkey", "c_mktsegment")


@query("SELECT l_partkey, arg_max(l_suppkey, {'a': l_shipdate, 'b': l_suppkey}) AS l_suppkey FROM lineitem GROUP BY 1")
def manifest_index(t):
    return S.manifest_index(t.lineitem, "l_shipdate", "l_partkey", "l_suppkey")


@query("""WITH n AS (SELECT l_returnflag AS ds, l_partkey AS node, arg_max(l_suppkey, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber}) AS supp FROM lineitem GROUP BY ALL),
e AS (SELECT l_returnflag AS ds, l_partkey AS src, (l_partkey * 7 + l_linenumber) % 250 AS dst FROM lineitem)
SELECT e.ds, src, dst, supp FROM e JOIN n ON n.ds = e.ds AND n.node = e.src WHERE EXISTS (SELECT 1 FROM n m WHERE m.ds = e.ds AND m.node = e.dst)""")
def graph_snapshot(t):
    nodes = t.lineitem.select(F.col("l_returnflag").alias("ds"), F.col("l_partkey").alias("node"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), F.col("l_suppkey").alias("supp"))
    edges = t.lineitem.select(F.col("l_returnflag").alias("ds"), F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 250).alias("dst"))
    own, kept = S.graph_of(nodes, edges, "ds", "node", "at")
    return kept.join(own.select("ds", F.col("node").alias("src"), "supp"), ["ds", "src"]).select("ds", "src", "dst", "supp")


@query("""SELECT lang, source, coalesce(nodes, 0)::BIGINT AS nodes, coalesce(edges, 0)::BIGINT AS edges FROM (SELECT lang, source, count(*) AS nodes FROM documents WHERE n_chars > 200 GROUP BY ALL)
FULL JOIN (SELECT lang, source, count(*) AS edges FROM documents JOIN labels USING (doc_id) GROUP BY ALL) USING (lang, source)""")
def provenance_counts(t):
    return S.provenance_counts(t.documents.filter("n_chars > 200"), t.documents.join(t.labels, "doc_id"), "lang", "source")


@query("SELECT doc_id, 'text' AS field FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'source' FROM documents WHERE source <> '' AND n_chars < 500")
def vector_readback(t):
    want = t.documents.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("text") != "", "text"), F.when(F.col("source") != "", "source")))).alias("field"))
    have = t.labels.select("doc_id", F.lit("text").alias("field")).union(t.documents.filter("n_chars >= 500").select("doc_id", F.lit("source")))
    return S.unindexed(want, have, "doc_id", "field")


@query("SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey WHERE o_custkey IS NULL OR c_acctbal < 0")
def node_readback(t):
    back = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").withColumn("c_name", F.when(F.col("c_acctbal") < 0, F.lit("?")).otherwise(F.col("c_name")))
    return S.changed_nodes(t.customer, back, "c_custkey", "c_name")


@query("SELECT l_suppkey, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS object_ids FROM lineitem GROUP BY 1")
def lexical_ids(t):
    return S.lexical_ids(t.lineitem, "l_suppkey", "l_partkey").withColumn("object_ids", F.array_join("object_ids", ","))


@query("SELECT o_custkey, c_name, c_name IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey * 2 AS o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey")
def point_lookups(t):
    wanted = t.orders.select((F.col("o_custkey") * 2).alias("o_custkey"))
    return S.find_one(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), wanted, "o_custkey")


@query("SELECT * FROM (VALUES ('claims'), ('works')) v(missing)")
def schema_validation(t):
    present = ["region", "nation", "customer", "documents"]
    return t.spark.createDataFrame([(x,) for x in S.missing_tables(present, ["works", "documents", "claims"])], "missing string")


@query("SELECT l_partkey, arg_max(l_orderkey, {'v': l_linenumber, 'c': l_shipdate, 'k': l_orderkey}) AS l_orderkey FROM lineitem GROUP BY 1")
def latest_correction(t):
    return S.latest_correction(t.lineitem, "l_partkey", "l_linenumber", "l_shipdate", "l_orderkey")


@query("""SELECT o_custkey, o_orderkey, (coalesce((SELECT count(*) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_orderstatus = 'F'), 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS version FROM orders o WHERE o_orderstatus <> 'F'""")
def next_versions(t):
    known = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("version"))
    return S.next_versions(t.orders.filter("o_orderstatus <> 'F'"), known, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.col("version").cast("long"))


@query("""SELECT DISTINCT conv_id, 'unknown evidence' AS reason FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT conv_id, 'correction without text' FROM conversations WHERE role = 'system' AND trim(text) = ''""")
def feedback_validation(t):
    one = t.conversations.groupBy("conv_id").agg(F.collect_set(F.concat(F.lit("evidence:"), "conv_id")).alias("evidence"), F.max(F.when((F.col("role") == "system") & (F.trim("text") == ""), 1)).alias("bad"))
    one = one.select("conv_id", "evidence", F.when(F.col("bad") == 1, "correct").otherwise("accept").alias("verdict"), F.lit("").alias("text"))
    return S.check_feedback(one, t.labels, "conv_id", "evidence", "verdict", "text", "doc_id")


@query("SELECT event_id, event_type, replace('failed in /srv/data/' || event_type || ' /srv/data', '/srv/data', '<data>') AS message FROM events")
def public_job_view(t):
    jobs = t.events.select("event_id", "event_type", F.col("props").alias("path"), F.concat(F.lit("failed in /srv/data/"), "event_type", F.lit(" /srv/data")).alias("message"))
    return S.public_jobs(jobs, "/srv/data", "message", ["path"])
