"""Ordered operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import sequence as S

from . import query
from .filters_joins import LINES, lines


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_id, lead(turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_links(t):
    return S.neighbours(t.conversations, "conv_id", "turn", "turn").select("conv_id", "turn", "prev_id", "next_id")


@query(f"SELECT doc_id, page, sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM (SELECT doc_id, page, length(line) AS n FROM ({LINES}))")
def token_prefix_sums(t):
    return S.prefix_sums(lines(t).withColumn("n", F.length("line")), "doc_id", "page", "n").select("doc_id", "page", "prefix")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill_section(t):
    e = t.events.withColumn("sec", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return S.forward_fill(e, "user_id", "event_id", "sec").select("event_id", "filled")


@query("""SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
  SELECT event_id, user_id, CASE WHEN lag(event_id) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR event_id - lag(event_id) OVER w > 50 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def gaps_islands_scope(t):
    return S.islands(t.events, "user_id", "event_id", "event_type", gap=50).select("event_id", "island")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS label FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(label, CASE WHEN a - b = 2 THEN b + 1 END) AS repaired FROM (SELECT *,
  last_value(label IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(label IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM x)""")
def label_repair(t):
    x = t.lineitem.withColumn("label", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")))
    return S.repair_labels(x, "l_orderkey", "l_linenumber", "label").select("l_orderkey", "l_linenumber", "repaired")


def sections(t):
    return t.events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), (F.col("event_id") * 7 % 3 + 1).cast("int").alias("level"), (F.col("event_id") % 1000).alias("page"), F.lit(9999).cast("long").alias("last_page"))


SECTIONS = "SELECT user_id AS doc, event_id AS ord, (event_id * 7 % 3 + 1)::INT AS level, event_id % 1000 AS page FROM events"


@query(f"""WITH s AS ({SECTIONS}) SELECT a.doc, a.ord, (SELECT arg_max(b.ord, b.ord) FROM s b WHERE b.doc = a.doc AND b.ord < a.ord AND b.level < a.level) AS parent_id,
  coalesce((SELECT arg_min(b.page, b.ord) FROM s b WHERE b.doc = a.doc AND b.ord > a.ord AND b.level <= a.level), 9999) AS page_end FROM s a""")
def section_hierarchy(t):
    return S.section_parents(S.page_ends(sections(t), "doc", "ord", "level", "page", "last_page"), "doc", "ord", "level", "ord").select("doc", "ord", "parent_id", "page_end")


@query(f"""WITH RECURSIVE s AS ({SECTIONS}), p AS (SELECT a.ord AS node, (SELECT max(b.ord) FROM s b WHERE b.doc = a.doc AND b.ord < a.ord AND b.level < a.level) AS up FROM s a),
r AS (SELECT node, node AS root, 0 AS depth FROM p UNION ALL SELECT r.node, p.up, depth + 1 FROM r JOIN p ON p.node = r.root WHERE p.up IS NOT NULL)
SELECT node, arg_max(root, depth) AS root, max(depth)::INT AS depth FROM r GROUP BY node""")
def major_section(t):
    s = sections(t).withColumn("node", F.col("ord"))
    return S.roots(S.section_parents(s, "doc", "ord", "level", "node"), "node", "parent_id")


def units(t):
    n = T.count_words(F.col("line")) * 7
    return lines(t).withColumns({"tokens": n, "paragraph_end": F.col("page") % 2 == 1, "subsection_end": F.col("page") % 5 == 4, "emergency": F.lit(False)})


@query()
def dp_chunking(t):
    return S.segment(units(t), ["doc_id"], "page", 800, 1200)


@query()
def budget_batching(t):
    return S.budget_batches(lines(t).withColumn("size", F.length("line")), "doc_id", "page", "size", 20000, 80)


@query()
def sentence_offsets(t):
    return S.sentence_offsets(t.documents, "doc_id", "text")


@query(f"""SELECT doc_id, count(*) AS units, min(n)::INT AS least, median(n) AS middle, round(avg(n), 6) AS mean, max(n)::INT AS most, count(*) FILTER (n < 250) AS tiny FROM (SELECT doc_id, length(line) AS n FROM ({LINES})) GROUP BY doc_id""")
def token_stats(t):
    n = lines(t).select("doc_id", F.length("line").alias("n"))
    return n.groupBy("doc_id").agg(F.count("*").alias("units"), F.min("n").alias("least"), F.median("n").alias("middle"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") < 250).alias("tiny"))


@query("SELECT conv_id, turn, nb FROM (SELECT conv_id, turn, unnest([turn - 1, turn, turn + 1]) AS nb FROM conversations WHERE role = 'assistant') WHERE (conv_id, nb) IN (SELECT conv_id, turn FROM conversations)")
def neighbour_expand(t):
    c = t.conversations
    near = c.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1)).alias("nb"))
    return near.join(c.select("conv_id", F.col("turn").alias("nb")), ["conv_id", "nb"], "left_semi").select("conv_id", "turn", "nb")


@query(f"""SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY page) FILTER (line <> '') AS text, min(page) AS first_page, max(page) AS last_page FROM ({LINES}) GROUP BY doc_id""")
def unit_text_join(t):
    one = F.array_sort(F.collect_list(F.struct("page", "line")))
    return lines(t).groupBy("doc_id").agg(one.alias("u"), F.min("page").alias("first_page"), F.max("page").alias("last_page")).select("doc_id", F.nullif(F.array_join(F.transform(F.filter("u", lambda x: x["line"] != ""), lambda x: x["line"]), "\n\n"), F.lit("")).alias("text"), "first_page", "last_page")
