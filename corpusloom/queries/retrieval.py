"""Retrieval channels, fusion and evidence on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as T
from corpusloom.operators import ranking as K
from corpusloom.operators import sequence as S
from corpusloom.plans import engine

from . import query

BM25 = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
top AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM sc QUALIFY rank <= 10)"""


def lexical(t, k=10):
    return K.bm25_topk(t.documents, t.benchmark, "item_id", k)


def hit_documents(t, k=10):
    """The hits with their documents' columns: hits are few, so documents aren't shuffled to them."""
    return t.documents.join(F.broadcast(lexical(t, k)), "doc_id")


@query(f"WITH {BM25} SELECT item_id, rank, doc_id, score FROM top")
def bm25_topk(t):
    return lexical(t).select("item_id", "rank", "doc_id", "score")


@query(f"WITH {BM25} SELECT item_id, doc_id, round(1.0 / (1 + (item_id % 8) * 20 + rank), 9) AS score FROM top")
def lexical_positional_score(t):
    return lexical(t).select("item_id", "doc_id", F.round(K.positional_score(F.col("item_id") % 8, F.col("rank"), 10), 9).alias("score"))


VEC = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
sv AS (SELECT query_id, label, vec_id, round(1 / (1 + greatest(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 0)), 6) AS score FROM embeddings JOIN q ON vec_id <> query_id),
topv AS (SELECT query_id, label, vec_id, score, (row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id))::INT AS rank FROM sv QUALIFY rank <= 5)"""


def vectors(t):
    q = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return K.vector_topk(t.embeddings, q, 5, "label")


@query(f"WITH {VEC} SELECT * FROM topv")
def vector_topk_per_collection(t):
    return vectors(t).select("query_id", "label", "vec_id", "score", "rank")


@query(f"WITH {VEC} SELECT * FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM topv) WHERE rank <= 10")
def vector_cosine_topk(t):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return vectors(t).withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "vec_id", "score", "rank")


@query("SELECT event_id, round(CASE WHEN value IS NULL THEN 1.0 / rk ELSE 1 / (1 + greatest(value, 0)) END, 6) AS score FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_id + 1 AS rk FROM events)")
def distance_to_score(t):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return t.events.select("event_id", F.round(K.distance_score(v, F.col("event_id") + 1), 6).alias("score"))


HITS = "SELECT user_id % 20 AS qid, event_type AS channel, event_id % 97 AS cand, user_id, event_id, round(value, 4) AS score, (row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY value DESC, event_id))::INT AS rank FROM events"


def hits(t):
    order = Window.partitionBy("qid", "channel").orderBy(F.desc("value"), "event_id")
    e = t.events.select((F.col("user_id") % 20).alias("qid"), F.col("event_type").alias("channel"), (F.col("event_id") % 97).alias("cand"), "user_id", "event_id", "value")
    return e.withColumn("rank", F.row_number().over(order)).withColumn("score", F.round("value", 4))


@query(f"SELECT qid, cand, max(score) AS score, arg_max(event_id, {{'s': score, 'p': -event_id}}) AS event_id FROM ({HITS}) GROUP BY ALL")
def channel_best_per_chunk(t):
    return K.best_per_key(hits(t).withColumn("pos", F.col("event_id")), ["qid", "cand"], "score", "pos", "event_id")


RRF = f"""f AS (SELECT qid, cand, round(sum((CASE channel WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.0 END) / (60 + rank)), 9) AS fused, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM ({HITS}) GROUP BY ALL),
rf AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY fused DESC, cand))::INT AS rank FROM f)"""


def fused(t):
    return K.weighted_rrf(hits(t), "qid", "cand", "channel", "rank", {"click": 2.0, "view": 0.5})


@query(f"WITH {RRF} SELECT * FROM rf")
def weighted_rrf(t):
    return fused(t).select("qid", "cand", "fused", "channels", "rank")


@query(f"""WITH {RRF} SELECT qid, cand % 40 AS chunk, arg_min(cand, {{'a': -(CASE WHEN cand % 3 = 0 THEN '-infinity'::DOUBLE ELSE cand / 10.0 END), 'b': -fused, 'c': cand}}) AS cand_id,
  max(CASE WHEN cand % 3 <> 0 THEN cand / 10.0 END) AS rerank, max(fused) AS fused, min(rank) AS pos FROM rf GROUP BY ALL""")
def chunk_dedup_merge(t):
    c = fused(t).select("qid", (F.col("cand") % 40).alias("chunk"), F.col("cand").alias("cand_id"), F.when(F.col("cand") % 3 != 0, F.col("cand") / 10).alias("rerank"), "fused", F.col("rank").alias("pos"), F.col("channels").alias("channel"))
    return K.merge_by_chunk(c, "qid", "chunk").drop("channels")


@query(f"""WITH {RRF}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, cand % 10 ORDER BY rank) AS n FROM rf) SELECT qid, cand, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INT AS final_rank FROM c WHERE n <= 3 QUALIFY final_rank <= 12""")
def diversify_caps(t):
    return K.capped(fused(t).withColumn("doc", F.col("cand") % 10), "qid", "doc", "rank", 3, 12).select("qid", "cand", "final_rank")


@query(f"WITH {RRF} SELECT qid, cand % 10 AS doc, arg_min(cand, rank) AS cand FROM rf GROUP BY ALL")
def seed_per_document(t):
    return fused(t).groupBy("qid", (F.col("cand") % 10).alias("doc")).agg(F.min_by("cand", "rank").alias("cand"))


@query(f"WITH {RRF} SELECT qid, cand, (row_number() OVER (PARTITION BY qid ORDER BY (cand % 5 = 0)::INT DESC, rank))::INT AS pool_pos FROM rf QUALIFY pool_pos <= 40")
def privileged_prepend(t):
    return K.prepend(fused(t).withColumn("about", (F.col("cand") % 5 == 0).cast("int")), "qid", "about", "rank", 40).select("qid", "cand", "pool_pos")


@query()
def greedy_aspect_cover(t):
    pool = hit_documents(t, 40).select(F.col("item_id").cast("string").alias("qid"), F.col("rank").alias("pos"), F.col("doc_id").alias("cand_id"), F.col("source").alias("doc_id"), (F.col("doc_id") % 3).alias("section_id"), "score", "text")
    return S.diversified(pool, "qid", 12, 3, 2, aspects=lambda q: ["erer", "tion", "ment"], seed=False)


@query(f"WITH {BM25} SELECT 'evidence:' || doc_id AS evidence_id, item_id, rank, source, left(text, 3000) AS text FROM top JOIN documents USING (doc_id)")
def evidence_projection(t):
    return hit_documents(t).select(F.concat(F.lit("evidence:"), "doc_id").alias("evidence_id"), "item_id", "rank", "source", F.left("text", F.lit(3000)).alias("text"))


@query(f"WITH {BM25} SELECT count(*) AS n, count(DISTINCT doc_id) AS documents, bool_and(doc_id IN (SELECT doc_id FROM documents)) AS complete FROM top")
def provenance_complete(t):
    known = t.documents.select("doc_id", F.lit(True).alias("ok"))
    return lexical(t).join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))


@query("""SELECT conv_id, turn, 1 + (contains(lower(text), 'the'))::INT + (contains(lower(text), 'que'))::INT AS score FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'que')""")
def confirmed_knowledge(t):
    n = K.contained_words(F.array(F.lit("the"), F.lit("que"), F.lit("the")), F.col("text"))
    return t.conversations.filter(n > 0).select("conv_id", "turn", (1 + n).alias("score"))


@query()
def about_rank_score(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", F.round(K.claim_score(F.col("p_name"), F.col("p_type"), F.col("p_type"), F.lit("blue large problem"), size / 100, size % 2 == 0, size % 5 == 0), 6).alias("score"))


@query("""SELECT c_custkey, 'WORK_' || lpad((row_number() OVER (ORDER BY c_custkey))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY c_custkey))::VARCHAR))::INT, '0') AS key FROM customer WHERE c_nationkey = 3""")
def scope_catalogue(t):
    w = t.customer.filter("c_nationkey = 3")
    return w.select("c_custkey", F.format_string("WORK_%03d", F.row_number().over(Window.orderBy("c_custkey"))).alias("key"))


@query("""SELECT item_id, 'cache_' || left(sha256('corpusloom' || chr(31) || 'cache' || chr(31) || '1' || chr(31) || text || chr(31) || 'truth' || chr(31) || '1,2,3'), 32) AS key FROM benchmark""")
def query_cache_key(t):
    return t.benchmark.select("item_id", ids.set_id("cache", F.array(F.lit("3"), F.lit("1"), F.lit("2")), F.col("text"), F.lit("truth")).alias("key"))


@query()
def engine_query(t):
    """The whole query path for every benchmark item: two channels, fusion, diversification and evidence."""
    return engine.Engine(t.spark, t.folder).query(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), profile="comprehensive")
