"""Scope and channel operators: events as hits of users on documents, parts as works."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import channels as C
from corpusloom.operators import scope as S

from . import query

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
HITS = """SELECT event_type AS q, (user_id * 7 + event_id) % 400 AS node, (ARRAY['Chunk','Entity','Claim','Summary','Entity'])[(event_id % 5)::INT + 1] AS type, (ARRAY['text','name','text','text','description'])[(event_id % 5)::INT + 1] AS field, value AS score FROM events"""
NODES = "SELECT p_partkey AS node, [p_partkey % 90, p_size] AS chunks FROM part"
ALLOWED = "SELECT doc_id AS chunk FROM documents WHERE doc_id % 2 = 0"


def hits(t):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select(
        F.col("event_type").alias("q"), ((F.col("user_id") * 7 + F.col("event_id")) % 400).alias("node"), pick("Chunk", "Entity", "Claim", "Summary", "Entity").alias("type"),
        pick("text", "name", "text", "text", "description").alias("field"), F.col("value").alias("score"),
    )


def nodes(t):
    return t.part.select(F.col("p_partkey").alias("node"), F.array(F.col("p_partkey") % 90, F.col("p_size").cast("long")).alias("chunks"))


def allowed(t):
    return t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk"))


def channel_sql(test: str, limit: int) -> str:
    return f"""WITH h AS (SELECT q, node, max(score) AS score FROM ({HITS}) WHERE {test} GROUP BY ALL), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, node) <= {2 * limit}),
c AS (SELECT q, chunk, max(score) AS score FROM (SELECT q, unnest(chunks) AS chunk, score FROM b JOIN ({NODES}) USING (node)) WHERE chunk IN ({ALLOWED}) GROUP BY ALL)
SELECT q, chunk, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk) AS rank FROM c QUALIFY rank <= {limit}"""


def channel(t, family, limit=30):
    return C.semantic(hits(t), nodes(t), allowed(t), family, "q", "node", "chunk", "score", limit).select("q", "chunk", "score", "rank")


@query(channel_sql("type = 'Chunk'", 30))
def semantic_channel(t):
    return channel(t, "chunks")


@query(channel_sql("type IN ('Entity', 'Claim')", 30))
def entity_claim_channel(t):
    return channel(t, "entity_claim")


@query(channel_sql("type = 'Summary'", 30))
def summary_channel(t):
    return channel(t, "summaries")


@query(channel_sql("type = 'Summary'", 10))
def global_context_channel(t):
    return channel(t, "summaries", 10)


@query("SELECT q, node, score, rank FROM (SELECT q, node, max(score) AS score, row_number() OVER (PARTITION BY q ORDER BY max(score) DESC, node) AS rank FROM (" + HITS + ") GROUP BY q, node) WHERE rank <= 25")
def graph_search(t):
    return C.best_nodes(hits(t), "q", "node", "score", 25).select("q", "node", "score", "rank")


EDGES = "SELECT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'R' THEN 'CITES' ELSE 'RELATED_TO' END AS type, [l_orderkey % 200] AS chunks, l_quantity AS score FROM lineitem"


def edges(t):
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "CITES").otherwise("RELATED_TO").alias("type"), F.array(F.col("l_orderkey") % 200).alias("chunks"), F.col("l_quantity").alias("score"))


@query(f"""WITH s AS (SELECT q, node, max(score) AS score FROM ({HITS}) WHERE type = 'Claim' GROUP BY ALL), own AS (SELECT q, unnest(chunks) AS chunk, score FROM s JOIN ({NODES}) USING (node)),
w AS (SELECT a.q, unnest(e.chunks) AS chunk, greatest(a.score, b.score) AS score FROM ({EDGES}) e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst AND b.q = a.q),
c AS (SELECT q, chunk, max(score) AS score FROM (SELECT * FROM own UNION ALL SELECT * FROM w) WHERE chunk IN ({ALLOWED}) GROUP BY ALL)
SELECT q, chunk, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk) AS rank FROM c QUALIFY rank <= 40""")
def graph_channel(t):
    seeds = C.in_family(hits(t), "claims").groupBy("q", "node").agg(F.max("score").alias("score"))
    return C.graph(seeds, seeds, edges(t), nodes(t), allowed(t), "q", "node", "chunk", "score", 40).select("q", "chunk", "score", "rank")


@query("SELECT user_id AS claim, max(value) AS score FROM events WHERE event_id % 6 < 4 GROUP BY 1")
def claim_vector_boost(t):
    return C.phrase_scores(t.events.select(F.col("user_id").alias("claim"), (F.col("event_id") % 6).alias("phrase"), F.col("value").alias("score")), "claim", "phrase", "score")


@query(f"""WITH c AS (SELECT doc_id AS chunk, lag(doc_id) OVER (ORDER BY doc_id) AS before, lead(doc_id) OVER (ORDER BY doc_id) AS after FROM documents), a AS (SELECT * FROM c WHERE chunk IN (SELECT unnest(chunks) FROM ({EDGES}) WHERE type = 'CITES' AND dst IN (1, 2)))
SELECT chunk, max(score)::DOUBLE AS score FROM (SELECT chunk, 1.25 AS score FROM a UNION ALL SELECT unnest([before, after]), 1.0 FROM a) WHERE chunk IS NOT NULL GROUP BY 1""")
def citation_anchor_channel(t):
    from pyspark.sql import Window

    w = Window.orderBy("doc_id")
    ids = t.documents.select("doc_id").distinct()
    chunks = ids.select(F.col("doc_id").alias("chunk"), F.lag("doc_id").over(w).alias("before"), F.lead("doc_id").over(w).alias("after"))
    return C.anchors(edges(t), [1, 2], chunks, "chunk", "before", "after").withColumn("score", F.col("score").cast("double"))


@query(f"SELECT DISTINCT src AS work FROM ({EDGES}) WHERE type = 'CITES' AND dst IN (3, 4) AND src NOT IN (5) UNION SELECT p_partkey FROM part WHERE p_partkey IN (3, 4)")
def citation_source_scope(t):
    return S.citing_sources(edges(t), [3, 4], t.part.select(F.col("p_partkey").alias("work")), [5], "work")


@query("SELECT q, node, score FROM (" + HITS + ") JOIN (SELECT p_partkey AS node FROM part WHERE p_size > 10) USING (node) WHERE type = 'Claim'")
def recall_context(t):
    seeds = C.in_family(hits(t), "claims").join(nodes(t).join(t.part.filter("p_size > 10").select(F.col("p_partkey").alias("node")), "node"), "node")
    return C.recalled(seeds, "comprehensive", False).select("q", "node", "score")


@query("""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE n_chars < 400),
s AS (SELECT item_id, doc_id, len(list_intersect(list_distinct(b.w), d.w)) / len(list_distinct(b.w)) AS relevance FROM b JOIN d ON doc_id % 10 = item_id % 10)
SELECT item_id, doc_id, round(relevance, 9) AS relevance, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS final_rank FROM s QUALIFY final_rank <= 5""")
def rerank_candidates(t):
    pairs = t.benchmark.select("item_id", F.col("text").alias("said"), (F.col("item_id") % 10).alias("k")).join(t.documents.filter("n_chars < 400").select("doc_id", "text", (F.col("doc_id") % 10).alias("k")), "k")
    return C.rerank(pairs, "item_id", "doc_id", "said", "text", 5).select("item_id", "doc_id", F.round("relevance", 9).alias("relevance"), "final_rank")


@query("""SELECT coalesce(CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'i' || event_id END, CASE WHEN event_id % 2 = 0 THEN 'k' || user_id END) AS id, event_type AS text,
coalesce(CASE WHEN event_id % 4 = 0 THEN value END, CASE WHEN event_id % 4 = 1 THEN 1 / (1 + greatest(value - 20, 0)) END, 1 / (user_id + 1)) AS score FROM events WHERE event_id % 3 < 2 OR event_id % 2 = 0""")
def hit_normalisation(t):
    e, when = F.col("event_id"), lambda c, x: F.when(c, x)
    rows = t.events.select(
        when(e % 3 == 0, F.concat(F.lit("c"), e)).alias("canonical_id"), when(e % 3 == 1, F.concat(F.lit("i"), e)).alias("id"),
        F.when(e % 2 == 0, F.array(F.concat(F.lit("k"), "user_id"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("chunk_ids"), F.col("event_type").alias("text"),
        when(e % 4 == 0, F.col("value")).alias("score"), when(e % 4 == 1, F.col("value") - 20).alias("distance"), (F.col("user_id") + 1).alias("rank"),
    )
    return C.normalised_hits(rows)


@query(f"SELECT node, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(chunks)))), ',') AS chunks FROM (SELECT unnest([src, dst]) AS node, score, chunks FROM ({EDGES})) GROUP BY node")
def public_edge_objects(t):
    return C.edge_ends(edges(t), "score").withColumn("chunks", F.array_join("chunks", ","))


@query(f"SELECT 'pool' AS stage, q, node, score FROM ({HITS})")
def candidate_trace(t):
    return C.trace(hits(t), "pool", ["q", "node", "score"])


@query(f"SELECT unnest(chunks) AS chunk FROM ({NODES}) UNION SELECT unnest(chunks) FROM ({EDGES})")
def chunk_ids_of_graph(t):
    return C.chunk_ids(nodes(t), edges(t))


@query(f"SELECT src, dst, type, score FROM ({EDGES}) WHERE src IN (SELECT node FROM ({HITS})) AND dst IN (SELECT node FROM ({HITS}))")
def graph_records(t):
    return C.neighbourhood(edges(t), hits(t), "node").select("src", "dst", "type", "score")


@query("SELECT p_partkey AS node, p_size % 4 AS priority FROM part ORDER BY priority, node LIMIT 80")
def retrieval_graph_export(t):
    own, _ = C.export(t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("priority")), edges(t), "priority", "node")
    return own


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{k}', '{x}')" for f, pairs in C.FAMILIES.items() for k, x in pairs) + ") v(family, type, field)")
def collection_families(t):
    return C.families(t.spark)


@query("SELECT unnest(['lexical', 'semantic', 'confirmed_knowledge', 'citation_anchor']) AS channel")
def ablation_policy(t):
    policy = C.Ablation.of({"graph": False, "entity_claim": 0, "global_context": False, "citation_anchor": True})
    planned = ("lexical", "semantic", "entity_claim", "graph", "global_context", "confirmed_knowledge")
    return t.spark.createDataFrame([(c,) for c in policy.channels(planned)], "channel string")


@query(f"""WITH p AS (SELECT p_partkey AS work, {NORM.format('unnest([p_name, p_brand])')} AS phrase FROM part) SELECT phrase, min(work) AS work FROM p WHERE phrase <> '' GROUP BY 1 HAVING min(work) = max(work)""")
def mention_index(t):
    return S.mention_index(t.part.withColumnRenamed("p_partkey", "work"), "work", "p_name", identifiers=("p_brand",))


def claims(t):
    return t.orders.select("o_orderkey", "o_orderstatus", F.lit("").alias("text"), F.array(F.col("o_custkey") % 5).alias("own"), F.array(F.col("o_orderkey") % 7).alias("derived"))


@query("""SELECT o_orderkey, array_to_string(list_filter([3, 1, 2], lambda s: s = o_custkey % 5 OR s = o_orderkey % 7), ',') AS proven FROM orders WHERE o_custkey % 5 IN (1, 2, 3) OR o_orderkey % 7 IN (1, 2, 3)""")
def subject_filter(t):
    index = t.spark.createDataFrame([("no such phrase", 1)], "phrase string, work long")
    proven = S.proven_subjects(claims(t), "o_orderkey", "text", "own", "derived", [3, 1, 2], index, "work")
    return S.about_subjects(claims(t), proven, "o_orderkey", "own").join(proven, "o_orderkey").select("o_orderkey", F.array_join("proven", ",").alias("proven"))


@query(f"""SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, {NORM.format('text')} AS s FROM benchmark WHERE item_id < 3) b ON contains(' ' || {NORM.format('d.text')} || ' ', ' ' || b.s || ' ')""")
def subjects_by_mention(t):
    """What texts say of three subjects; the subjects are the operator's parameter."""
    index = t.benchmark.select(S.T.scope_normalize(F.col("text")).alias("phrase"), F.col("item_id").alias("work"))
    rows = t.documents.select("doc_id", "text", F.array().cast("array<bigint>").alias("own"), F.array().cast("array<bigint>").alias("derived"))
    proven = S.proven_subjects(rows, "doc_id", "text", "own", "derived", [0, 1, 2], index, "work")
    return proven.select("doc_id", F.explode("proven").alias("item_id")).distinct()


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderstatus NOT IN ('O') AND (o_custkey % 5 = 2 OR o_orderkey % 7 = 2)""")
def scope_filters_combined(t):
    index = t.spark.createDataFrame([("no such phrase", 1)], "phrase string, work long")
    proven = S.proven_subjects(claims(t), "o_orderkey", "text", "own", "derived", [2], index, "work")
    return S.scoped(claims(t), "o_orderstatus", "o_orderkey", "own", ["F", "O"], [], ["O"], proven).select("o_orderkey")


@query("""SELECT o_orderkey, n > 0 AND NOT hard AND NOT (n = 1 AND comparative) AS locked FROM (SELECT o_orderkey, o_custkey % 3 AS n, o_orderstatus = 'P' AS hard, o_orderpriority LIKE '1%' AS comparative FROM orders)""")
def explicit_document_lock(t):
    docs = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    return t.orders.select("o_orderkey", S.explicit_lock(docs, F.col("o_orderstatus") == "P", F.col("o_orderpriority").like("1%")).alias("locked"))


@query("""SELECT p_partkey, array_to_string(list_filter([p_brand, p_type] , lambda w: p_size % 2 = 0 OR w LIKE 'Brand#1%'), '|') AS works FROM part""")
def explicit_scope_clean(t):
    allowed = F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"Brand#1{i}") for i in range(10)], F.lit("Brand#1")))
    given = F.array("p_brand", "p_type", "p_brand")
    return t.part.select("p_partkey", F.array_join(S.clean_explicit(given, allowed), "|").alias("works"))


@query("SELECT item_id, contains(lower(q), 'compare') OR contains(lower(q), 'versus') OR contains(lower(q), ' vs ') AS several FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Compare ' || text WHEN 1 THEN text || ' VS others' ELSE text END AS q FROM benchmark)")
def multi_document_cue(t):
    q = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Compare "), "text")).when(F.col("item_id") % 3 == 1, F.concat("text", F.lit(" VS others"))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", S.asks_for_several(q).alias("several"))


@query("SELECT p_partkey, trim(p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END) AS text FROM part")
def scoped_search_text(t):
    return t.part.select("p_partkey", S.search_text(F.col("p_name"), F.array("p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")))).alias("text"))


@query(f"""WITH b AS (SELECT item_id, {NORM.format('text')} AS s FROM benchmark), d AS (SELECT doc_id, {NORM.format('text')} AS s FROM documents)
SELECT doc_id, arg_min(item_id, {{'a': -length(b.s), 'b': item_id}}) AS item_id FROM d JOIN b ON b.s <> '' AND contains(' ' || d.s || ' ', ' ' || b.s || ' ') GROUP BY doc_id""")
def source_work_by_title(t):
    return S.source_by_title(t.documents, "doc_id", "text", t.benchmark.withColumnRenamed("text", "title"), "item_id", "title")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ingested FROM customer")
def work_catalogues(t):
    return S.catalogues(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey, r_regionkey AS work, r_regionkey IS NOT NULL AS known FROM (SELECT p_partkey, ['asia', ' Europe ', 'nowhere'][p_size % 3 + 1] AS k FROM part) LEFT JOIN region ON r_name = upper(trim(k))")
def planner_keys(t):
    given = t.part.select("p_partkey", F.element_at(F.array(F.lit("asia"), F.lit(" Europe "), F.lit("nowhere")), (F.col("p_size") % 3 + 1)).alias("key"))
    return S.map_keys(given, "key", t.region.select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("work")), "work").select("p_partkey", "work", "known")
