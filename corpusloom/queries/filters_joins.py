"""Sources, filters, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import relational as R

from . import query

LINES = """SELECT doc_id, (i - 1)::INT AS page, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))


@query("SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id")
def scan_latest_per_key(t):
    return R.latest_per_key(t.events, "user_id", ["ts", "event_id"], "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def list_recent_limit(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_tombstones(t):
    return R.without(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("""SELECT d.doc_id, d.source, coalesce(l.toxic, 0) = 1 AS deleted, count(*) OVER (PARTITION BY d.source) AS in_source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def document_listing(t):
    counts = t.documents.groupBy("source").agg(F.count("*").alias("in_source"))
    return t.documents.join(t.labels, "doc_id", "left").join(counts, "source").select("doc_id", "source", (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"), "in_source")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, len(json_keys(props))::INT AS n_keys FROM events")
def json_props_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT doc_id, lang FROM documents WHERE source IN ('src1', 'src3', 'src5') AND lang IN ('en', 'fr') AND source NOT IN ('src5')")
def semi_join_scope(t):
    own = R.within_scope(t.documents, "source", sources=["src1", "src3", "src5"], excluded=["src5"])
    return own.filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("""SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def scope_filter_documents(t):
    good = t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi")
    return R.without(good, t.labels.filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query("""SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn)""")
def left_anti_unprocessed(t):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return t.conversations.join(last, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query(f"""WITH n AS (SELECT doc_id, page, trim(regexp_replace(translate(lower(regexp_replace(line, '<[^>]+>', '', 'g')), '–—‑', '---'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS norm FROM ({LINES}))
SELECT doc_id, page FROM n WHERE norm <> '' AND (doc_id, norm) IN (SELECT doc_id, norm FROM n GROUP BY 1, 2 HAVING count(DISTINCT page) > 1)""")
def repeated_margin(t):
    return R.repeated_margins(lines(t).withColumn("kind", F.lit("line")), "doc_id", "kind", "page", "line").select("doc_id", "page")


@query(f"""SELECT doc_id, page FROM (SELECT doc_id, page, norm, lag(norm) OVER (PARTITION BY doc_id ORDER BY page) AS prior FROM (
  SELECT doc_id, page, trim(regexp_replace(lower(line), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS norm FROM ({LINES})) WHERE norm <> '') WHERE norm = prior""")
def adjacent_duplicates(t):
    return R.adjacent_duplicates(lines(t), "doc_id", "page", "line").select("doc_id", "page")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def provenance_validity(t):
    parts = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    df = t.orders.select("o_orderkey").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.bad_provenance(df, "o_orderkey", "parts", t.part.filter("p_size <= 25"), "p_partkey")


@query("""WITH v AS (SELECT 'chunk_' || sha256(doc_id::VARCHAR) AS v FROM documents), g AS (SELECT DISTINCT left('chunk_' || sha256(doc_id::VARCHAR), 14) AS given FROM documents)
SELECT given, CASE WHEN count(*) = 1 THEN min(v) END AS repaired FROM g JOIN v ON starts_with(v, given) GROUP BY given""")
def prefix_id_repair(t):
    v = t.documents.select(F.concat(F.lit("chunk_"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("v"))
    return R.repair_ids(v.select(F.left("v", F.lit(14)).alias("given")), "given", v, "v", 14)


@query("""WITH v AS (SELECT l_partkey AS key FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10) SELECT key FROM v""")
def validate_foreign_keys(t):
    return R.violations(t.lineitem, "l_partkey", t.part.filter("p_size > 10"), "p_partkey")


@query("""SELECT doc_id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def index_consistency(t):
    return R.differences(t.documents, t.labels, "doc_id")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest, doc_id < 10 AS known FROM documents) SELECT doc_id, digest, digest IN (SELECT digest FROM d WHERE known) OR doc_id > min(doc_id) OVER (PARTITION BY digest) AS duplicate FROM d WHERE NOT known""")
def register_sources(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return R.register(d.filter("doc_id >= 10"), d.filter("doc_id < 10"), "digest", "doc_id").select("doc_id", "digest", "duplicate")


@query("""SELECT 'title' AS object_type, doc_id AS object_id, left(text, 60) AS text FROM documents UNION ALL SELECT 'chunk', doc_id, text FROM documents UNION ALL SELECT 'reference', item_id, text FROM benchmark""")
def fts_records(t):
    d = t.documents
    rows = d.select(F.lit("title").alias("object_type"), F.col("doc_id").alias("object_id"), F.left("text", F.lit(60)).alias("text"))
    rows = rows.unionByName(d.select(F.lit("chunk").alias("object_type"), F.col("doc_id").alias("object_id"), "text"))
    return rows.unionByName(t.benchmark.select(F.lit("reference").alias("object_type"), F.col("item_id").alias("object_id"), "text"))


SPANS = "SELECT user_id AS el, event_id, (floor(epoch(ts))::BIGINT % 1000)::BIGINT AS s FROM events"


@query(f"""WITH e AS ({SPANS}), sp AS (SELECT el, event_id AS span_id, s AS ss, s + 40 + event_id % 60 AS se FROM e WHERE event_id % 3 = 0), p AS (SELECT el, event_id, s, s + 5 AS e FROM e WHERE event_id % 3 = 1)
SELECT p.el, p.event_id, arg_min(span_id, {{'w': se - ss, 'i': span_id}}) AS owner FROM p LEFT JOIN sp ON p.el = sp.el AND ss <= s AND se >= e GROUP BY ALL""")
def span_containment(t):
    e = t.events.select(F.col("user_id").alias("el"), "event_id", (F.unix_timestamp("ts") % 1000).alias("s"))
    spans = e.filter("event_id % 3 = 0").select("el", F.col("event_id").alias("span_id"), F.col("s").alias("ss"), (F.col("s") + 40 + F.col("event_id") % 60).alias("se"))
    return R.owning_span(e.filter("event_id % 3 = 1").withColumn("e", F.col("s") + 5), spans, "el", "s", "e", "ss", "se", "span_id", "event_id")


@query(f"""WITH l AS ({LINES}) SELECT l.doc_id, page FROM l JOIN labels b ON l.doc_id = b.doc_id AND page BETWEEN quality AND quality + 3 WHERE contains(line, 'the')""")
def range_join_pages(t):
    return lines(t).join(t.labels, "doc_id").filter(F.col("page").between(F.col("quality"), F.col("quality") + 3) & F.col("line").contains("the")).select("doc_id", "page")


@query("""SELECT n_name, c_mktsegment, arg_min(c_custkey, c_custkey) AS first_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def identifier_join(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.min_by("c_custkey", "c_custkey").alias("first_id"))


@query(r"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS w FROM part), f AS (SELECT DISTINCT p_partkey, array_to_string(w[1:n], ' ') AS phrase FROM (SELECT p_partkey, w, unnest(range(2, len(w) + 1)) AS n FROM w))
SELECT phrase, min(p_partkey) AS p_partkey FROM f WHERE length(phrase) >= 7 GROUP BY phrase HAVING min(p_partkey) = max(p_partkey)""")
def unique_prefix_mentions(t):
    return R.unique_prefixes(t.part.withColumn("title", F.concat_ws(" ", "p_name", "p_type")), "p_partkey", "title")


@query(r"""WITH f AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS phrase FROM benchmark), d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS s FROM documents)
SELECT DISTINCT doc_id, item_id FROM d JOIN f ON phrase <> '' AND contains(' ' || s || ' ', ' ' || phrase || ' ')""")
def contains_phrase_join(t):
    phrases = t.benchmark.select("item_id", T.scope_normalize(F.col("text")).alias("phrase")).filter("phrase <> ''")
    return R.mentions(t.documents, "doc_id", "text", phrases, "item_id")


@query("""WITH e AS (SELECT p_brand AS scope, p_size AS label, p_partkey AS id, p_type AS ident FROM part), a AS (SELECT DISTINCT p_brand AS scope, n AS label FROM part CROSS JOIN range(1, 51) t(n))
SELECT a.scope, a.label::INT AS label, CASE WHEN count(id) = 1 OR min(ident) = max(ident) THEN arg_min(id, id) END AS entry, CASE WHEN count(id) = 0 THEN 'missing' WHEN NOT (count(id) = 1 OR min(ident) = max(ident)) THEN 'ambiguous' END AS failure
FROM a LEFT JOIN e ON a.scope = e.scope AND a.label = e.label GROUP BY ALL""")
def label_resolution(t):
    atoms = t.part.select(F.col("p_brand").alias("scope")).distinct().withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(50))))
    entries = t.part.select(F.col("p_brand").alias("scope"), F.col("p_size").alias("label"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("ident"))
    return R.resolve_labels(atoms, entries, "scope", "label", "id", "ord", "ident").select("scope", "label", "entry", "failure")


@query("""SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def set_intersection(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("""SELECT o_orderkey, count(DISTINCT l_suppkey) AS n, bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS subset FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def subset_equality(t):
    good = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("ok"))
    lines_ = t.lineitem.select("l_orderkey", "l_suppkey").join(good, "l_suppkey", "left")
    rows = t.orders.select("o_orderkey").hint("merge").join(R.dealt(lines_, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.countDistinct("l_suppkey").alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("subset"))


@query("""SELECT d.doc_id, d.lang, l.quality, count(*) OVER (PARTITION BY d.source) AS siblings FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lookup_join_candidates(t):
    sizes = t.documents.groupBy("source").agg(F.count("*").alias("siblings"))
    return t.documents.join(t.labels, "doc_id", "left").join(sizes, "source").select("doc_id", "lang", "quality", "siblings")


@query()
def fuzzy_title_join(t):
    works = t.part.select(F.col("p_partkey").alias("work_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("author"))
    return R.fuzzy_title_pairs(works)
