"""Aggregations and evaluation measures on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E

from . import query


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT k.kind, count(event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('figure'), ('table')) k(kind) LEFT JOIN events ON event_type = k.kind GROUP BY k.kind""")
def element_histogram(t):
    kinds = t.spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "figure", "table")], "kind string")
    return kinds.join(t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("c")), "kind", "left").select("kind", F.coalesce("c", F.lit(0)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))""")
def recall_by_config_grouping_sets(t):
    g = t.orders.groupingSets([[], [F.col("o_orderstatus")], [F.col("o_orderstatus"), F.col("o_orderpriority")]], F.col("o_orderstatus"), F.col("o_orderpriority"))
    return g.agg(F.grouping_id().cast("long").alias("level"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))


@query("""SELECT source, lang, round(avg(quality), 6) AS mean, count(quality) AS n, grouping_id(lang, source)::BIGINT AS level FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))""")
def metric_rollup(t):
    return E.rollup_means(t.documents.join(t.labels, "doc_id", "left"), [["lang"], ["lang", "source"]], "quality")


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS delta FROM lineitem GROUP BY l_suppkey""")
def config_deltas_pivot(t):
    return E.pivot_delta(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity", "R", "A")


@query("""WITH f AS (SELECT DISTINCT l_returnflag AS c, l_partkey AS p FROM lineitem) SELECT count(*) AS rescued, (SELECT count(DISTINCT p) FROM f) AS universe, round(count(*) / (SELECT count(DISTINCT p) FROM f), 6) AS rate
FROM f WHERE c = 'R' AND p NOT IN (SELECT p FROM f WHERE c = 'A')""")
def unique_rescue(t):
    return E.rescued(t.lineitem, "l_returnflag", "l_partkey", "R", "A")


@query("""WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k AS o_custkey, CASE WHEN d > 1e-9 THEN 'improved' WHEN d < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS change FROM (SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, 0) - coalesce(b.v, 0) AS d FROM a FULL JOIN b ON a.k = b.k)""")
def privilege_delta(t):
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return E.privilege(side("F"), side("O"), "o_custkey", "v")


@query("""SELECT o_orderpriority, min(m) = max(m) AS saturated FROM (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS m FROM orders GROUP BY ALL) GROUP BY ALL""")
def pool_saturation(t):
    return E.saturated(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("""WITH x AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R')) AS a, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A')) AS b FROM lineitem GROUP BY 1)
SELECT count(*) AS compared, round(avg((a = b)::INT), 6) AS equal FROM x WHERE a IS NOT NULL AND b IS NOT NULL""")
def set_equality_rates(t):
    own = lambda f: F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey"))))
    x = t.lineitem.groupBy("l_orderkey").agg(own("R").alias("a"), own("A").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return x.agg(F.count("*").alias("compared"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("equal"))


@query("""SELECT count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id) / count(*), 4) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enrichment_coverage(t):
    both = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return both.agg(F.count("*").alias("total"), F.count("has").alias("covered"), F.round(F.count("has") / F.count("*"), 4).alias("coverage"))


@query("""WITH m AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS got, [l_orderkey % 200 + 1, l_orderkey % 300 + 1, min(l_partkey)] AS want FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(len(list_intersect(list_distinct(want), got)) / len(list_distinct(want)), 6) AS recall FROM m""")
def concept_recall(t):
    m = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("got"), F.min("l_partkey").alias("one"))
    want = F.array(F.col("l_orderkey") % 200 + 1, F.col("l_orderkey") % 300 + 1, F.col("one"))
    return m.select("l_orderkey", F.round(E.recall(F.col("got"), want), 6).alias("recall"))


@query("""SELECT o_custkey, round(1.0 / min(r), 6) AS mrr FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE o_orderstatus = 'F' GROUP BY 1""")
def mrr_usefulness(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.round(1.0 / F.min("r"), 6).alias("mrr"))


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'resolved' WHEN bool_or(l_returnflag = 'R') THEN 'partially_resolved' ELSE 'unresolved' END AS status, count(*) AS atoms, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS targets FROM lineitem GROUP BY 1""")
def citation_status_rollup(t):
    ok = F.col("l_returnflag") == "R"
    status = F.when(F.bool_and(ok), "resolved").when(F.bool_or(ok), "partially_resolved").otherwise("unresolved")
    return t.lineitem.groupBy("l_orderkey").agg(status.alias("status"), F.count("*").alias("atoms"), F.countDistinct(F.when(ok, F.col("l_partkey"))).alias("targets"))


@query("""SELECT user_id, bool_and(coalesce(value <= prior, true)) AS monotone, bool_and(value > 0) AS positive FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) GROUP BY 1""")
def surface_metrics(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("prior", F.lag("value").over(w))
    return e.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("value") <= F.col("prior"), F.lit(True))).alias("monotone"), F.bool_and(F.col("value") > 0).alias("positive"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY ROLLUP (label)")
def collection_status(t):
    return t.embeddings.rollup("label").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 8), ',') AS first_ids FROM documents GROUP BY 1""")
def raw_hit_summary(t):
    from pyspark.sql import Window

    first = t.documents.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 8").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    own = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    return own.join(first, "source").select("source", "n", "langs", F.array_join("ids", ",").alias("first_ids"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(count(*) FILTER (n_chars > 1000) / count(*), 6) AS long_share FROM documents GROUP BY 1")
def evidence_cost(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.count_if(F.col("n_chars") > 1000) / F.count("*"), 6).alias("long_share"))


@query("""SELECT sum((lang = 'de' AND source = 'src0')::INT)::BIGINT AS wrong_source, sum((text = '')::INT)::BIGINT AS empty, sum((n_chars <> length(text))::INT)::BIGINT AS wrong_size, count(*) AS checked FROM documents""")
def scope_violations(t):
    n = lambda c: F.sum(c.cast("long"))
    return t.documents.agg(n((F.col("lang") == "de") & (F.col("source") == "src0")).alias("wrong_source"), n(F.col("text") == "").alias("empty"), n(F.col("n_chars") != F.length("text")).alias("wrong_size"), F.count("*").alias("checked"))


@query("""SELECT l_suppkey, CASE WHEN n < 5 THEN 'INSUFFICIENT' WHEN g <= 0 AND r >= 0.9 THEN 'REMOVE' WHEN g <= 0.02 THEN 'REDUCE' ELSE 'KEEP' END AS verdict FROM (SELECT l_suppkey, count(*) AS n, avg(l_tax) - 0.03 AS g, avg(l_discount) * 18 AS r FROM lineitem GROUP BY 1)""")
def ablation_verdict(t):
    x = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.avg("l_tax") - 0.03).alias("g"), (F.avg("l_discount") * 18).alias("r"))
    return x.select("l_suppkey", E.verdict(F.col("g"), F.col("r"), F.col("n")).alias("verdict"))


@query("""SELECT n, count(*) AS copies FROM (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) GROUP BY n""")
def duplicate_counts(t):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("copies"))


@query("""SELECT l_partkey, arg_min(flag, pos) FILTER (flag IS NOT NULL) AS description, max(l_tax) AS confidence, array_to_string(list(o ORDER BY p, o), ',') AS sources FROM (
  SELECT l_partkey, min(pos) AS p, l_suppkey AS o, max(l_tax) AS l_tax, arg_min(flag, pos) FILTER (flag IS NOT NULL) AS flag, min(pos) FILTER (flag IS NOT NULL) AS pos FROM (SELECT l_partkey, l_suppkey, l_tax, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem) GROUP BY l_partkey, l_suppkey) GROUP BY l_partkey""")
def merge_extractions(t):
    x = t.lineitem.withColumns({"pos": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))})
    first = F.min(F.when(F.col("flag").isNotNull(), F.struct("pos", "flag")))
    one = x.groupBy("l_partkey", "l_suppkey").agg(F.min("pos").alias("p"), F.max("l_tax").alias("tax"), first.alias("d"))
    merged = one.groupBy("l_partkey").agg(F.min("d").alias("d"), F.max("tax").alias("confidence"), F.array_sort(F.collect_list(F.struct("p", "l_suppkey"))).alias("s"))
    return merged.select("l_partkey", F.col("d.flag").alias("description"), "confidence", F.array_join(F.transform("s", lambda q: q["l_suppkey"].cast("string")), ",").alias("sources"))
