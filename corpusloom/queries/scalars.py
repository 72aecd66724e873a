"""Scalar rules and identifiers on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as T

from . import query


@query("""SELECT doc_id, 'doc_' || left(sha256('corpusloom' || chr(31) || 'doc' || chr(31) || '1' || chr(31) || doc_id || chr(31) || source || chr(31) || lang), 32) AS id FROM documents""")
def stable_id_hash(t):
    return t.documents.select("doc_id", ids.stable_id("doc", F.col("doc_id"), F.col("source"), F.col("lang")).alias("id"))


@query("""SELECT l_orderkey, 'sem_' || left(sha256('corpusloom' || chr(31) || 'sem' || chr(31) || '1' || chr(31) || l_orderkey || chr(31) || string_agg(p, ',' ORDER BY p)), 32) AS id
FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS p FROM lineitem) GROUP BY l_orderkey""")
def semantic_object_id(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"))
    return sets.select("l_orderkey", ids.set_id("sem", F.col("parts"), F.col("l_orderkey")).alias("id"))


@query(r"""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)""")
def uuid5_projection(t):
    return t.customer.select("c_custkey", ids.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("uuid"))


@query("""SELECT doc_id, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid, regexp_full_match(source, '[0-9a-f]{64}') AS source_valid FROM documents""")
def sha256_validate(t):
    return t.documents.select("doc_id", ids.is_sha256(F.sha2("text", 256)).alias("valid"), ids.is_sha256(F.col("source")).alias("source_valid"))


@query(r"""SELECT page_id, sha256(trim(regexp_replace(translate(lower(regexp_replace(html, '<[^>]+>', '', 'g')), '–—‑', '---'), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS digest FROM pages""")
def normalize_match_text(t):
    return t.pages.select("page_id", F.sha2(T.match_text(F.col("html")), 256).alias("digest"))


@query(r"""SELECT doc_id, len(w)::INT AS n, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)""")
def scope_normalize_tokens(t):
    return t.documents.select("doc_id", F.size(T.scope_tokens(F.col("text"))).alias("n"), F.sha2(T.scope_normalize(F.col("text")), 256).alias("digest"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?;。！？；][\t\n\x0B\f\r ]+[^\t\n\x0B\f\r ]'))::INT + (trim(text, ' ' || chr(10)) <> '')::INT AS n FROM documents""")
def sentence_split(t):
    return t.documents.select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query(r"""SELECT item_id, array_to_string(list_slice(w, 1, 20), '|') AS terms FROM (
  SELECT item_id, CASE WHEN len(a) > 0 THEN a ELSE w END AS w FROM (
    SELECT item_id, w, list_filter(w, lambda x: regexp_full_match(x, '[\x00-\x7F]+')) AS a FROM (
      SELECT item_id, list_filter(all_w, lambda x, i: list_position(all_w, x) = i) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]{2,}') AS all_w FROM benchmark))))""".replace("\\\\", "\\"))
def fts_terms(t):
    return t.benchmark.select("item_id", F.array_join(T.search_terms(F.col("text")), "|").alias("terms"))


PARTS = """SELECT p_partkey, 'https://doi.org/10.' || (1000 + p_partkey % 9000) || '/AB.' || p_partkey || ').' AS raw_doi,
  'doi: 10.' || (1000 + p_partkey % 9000) || '/X' || p_partkey || ',' AS registry, 'arXiv:' || (1000 + p_partkey % 9000) || '.' || (10000 + p_partkey) || 'v' || (p_partkey % 9) AS arx,
  '[' || p_partkey || '] A. ' || p_brand || ' and B. Other. ' || (1950 + p_partkey % 70) || '. ' || p_name || ' study. Press. doi 10.1234/q' || p_partkey || '.' AS ref FROM part"""


def _parts(t):
    key = F.col("p_partkey")
    head = 1000 + key % 9000
    return t.part.select(
        "p_partkey",
        F.concat(F.lit("https://doi.org/10."), head, F.lit("/AB."), key, F.lit(").")).alias("raw_doi"),
        F.concat(F.lit("doi: 10."), head, F.lit("/X"), key, F.lit(",")).alias("registry"),
        F.concat(F.lit("arXiv:"), head, F.lit("."), 10000 + key, F.lit("v"), key % 9).alias("arx"),
        F.concat(F.lit("["), key, F.lit("] A. "), "p_brand", F.lit(" and B. Other. "), 1950 + key % 70, F.lit(". "), "p_name", F.lit(" study. Press. doi 10.1234/q"), key, F.lit(".")).alias("ref"),
    )


@query(f"""SELECT p_partkey, lower(regexp_replace(regexp_replace(raw_doi, '[.,;)\\]}}]+$', ''), '^https?://(dx\\.)?doi\\.org/', '', 'i')) AS doi,
  regexp_replace(lower(trim(regexp_replace(registry, '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '', 'i'))), '[.,;)]+$', '') AS registry_doi,
  regexp_replace(lower(regexp_replace(arx, '^arxiv:\\s*', '', 'i')), 'v\\d+$', '') AS arxiv FROM ({PARTS})""")
def normalize_identifiers(t):
    return _parts(t).select("p_partkey", T.doi(F.col("raw_doi")).alias("doi"), T.registry_doi(F.col("registry")).alias("registry_doi"), T.arxiv(F.col("arx")).alias("arxiv"))


@query(f"""SELECT p_partkey, p_partkey::VARCHAR AS label, 'numeric' AS kind, regexp_extract(ref, ' ((19|20)\\d\\d)\\.', 1)::INT AS year, '10.1234/q' || p_partkey AS doi FROM ({PARTS})""")
def parse_reference(t):
    fields = T.reference_fields(F.col("ref"))
    label = T.reference_label(F.col("ref"))
    return _parts(t).select("p_partkey", label.alias("label"), T.label_kind(label).alias("kind"), fields["year"].alias("year"), fields["doi"].alias("doi"))


@query("""SELECT p_partkey, p_name || ' study' AS title, 'A. ' || p_brand || '|B. Other' AS authors FROM part""")
def infer_reference_identity(t):
    title, authors = T.year_first_identity(F.col("ref"))
    return _parts(t).select("p_partkey", title.alias("title"), F.array_join(authors, "|").alias("authors"))


@query("""SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || '|' || (1950 + p_partkey % 70) || ',' || lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || ' et al|' || (1950 + p_partkey % 70) || ',' ||
  lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || ' and other|' || (1950 + p_partkey % 70) AS keys FROM part""")
def author_year_keys(t):
    return t.part.select("p_partkey", F.array_join(T.author_year_keys(F.concat(F.lit("A. "), "p_brand", F.lit(" and B. Other")), 1950 + F.col("p_partkey") % 70), ",").alias("keys"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 20 THEN array_to_string(range(l_linenumber, l_linenumber * 2 + 1), ',') || ',' || l_partkey END AS atoms FROM lineitem""")
def range_expand_atoms(t):
    inner = F.concat("l_linenumber", F.lit("–"), F.col("l_linenumber") * 2, F.lit("; "), "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(T.citation_atoms(inner), ",").alias("atoms"))


@query()
def work_aliases(t):
    title = F.concat(F.upper(F.substring_index("p_name", " ", 1)), F.lit("-3D for the "), "p_name", F.lit(" of "), "p_type")
    return t.part.select("p_partkey", F.array_join(T.aliases(title), "|").alias("aliases"))


@query()
def topic_queries(t):
    q = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit("drawback ")).otherwise(F.lit("")), "text")
    return t.benchmark.select("item_id", F.array_join(T.topics(q), ",").alias("topics"))


@query("""SELECT p_partkey, trim(regexp_replace('compare with', ' +', ' ', 'g')) || ' ' || lower(p_brand) AS residual FROM part""")
def residual_query_text(t):
    q = F.concat(F.lit("compare "), F.upper("p_name"), F.lit(" with  "), F.lower("p_brand"))
    return t.part.select("p_partkey", T.residual_query(q, F.array("p_name", F.lit(None).cast("string"), F.lit(""))).alias("residual"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'table' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'title' ELSE 'list_item' END WHEN 'purchase' THEN 'figure' ELSE 'other' END AS kind
FROM events""")
def classify_element(t):
    label = F.when(F.col("event_type") == "click", "Table").when(F.col("event_type") == "view", "text").when(F.col("event_type") == "purchase", "image").otherwise(F.col("event_type"))
    return t.events.select("event_id", T.element_kind(label, F.concat(F.lit("1. "), "event_type"), (F.col("event_id") % 3 == 0) & (F.col("event_type") == "view"), F.lit(False)).alias("kind"))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 0.85 THEN 'en' ELSE 'und' END AS language FROM documents""")
def language_detect(t):
    return t.documents.select("doc_id", T.is_english(F.col("text")).alias("language"))


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), p_type) AS element, upper(p_brand) AS label FROM part""")
def element_text(t):
    text = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", T.element_text(F.lit("paragraph"), text, F.col("p_type"), F.lit(""), F.lit("")).alias("element"), T.first_text(F.lit("  "), F.lit(None).cast("string"), F.upper("p_brand")).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN length(s) > 46 THEN left(s, 43) || '...' ELSE s END AS label FROM (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS s FROM documents)""")
def graph_short_label(t):
    return t.documents.select("doc_id", T.shortened(F.col("text"), 46, 43).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')), ' '))::INT END AS tokens FROM documents""")
def whitespace_tokens(t):
    return t.documents.select("doc_id", T.count_words(F.col("text")).alias("tokens"))


@query("""SELECT conv_id, turn, replace('See [' || conv_id || '] and [zz].', '[' || conv_id || ']', '[evidence:' || conv_id || ']') AS answer FROM conversations""")
def citation_rewrite(t):
    answer = F.concat(F.lit("See 【"), "conv_id", F.lit("】 and [zz]."))
    return t.conversations.select("conv_id", "turn", T.link_citations(answer, F.array(F.col("conv_id").cast("string"))).alias("answer"))


@query("""SELECT p_partkey, strip AS heading FROM (SELECT p_partkey, p_name AS strip FROM part)""")
def strip_heading_number(t):
    return t.part.select("p_partkey", T.strip_heading_number(F.concat("p_size", F.lit("."), F.col("p_size") + 1, F.lit(" "), "p_name")).alias("heading"))


@query("""SELECT p_partkey, 'title:' || array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') || '|' || p_size AS key FROM part""")
def work_identity_key(t):
    none = F.lit(None).cast("string")
    return t.part.select("p_partkey", T.identity_key(none, none, F.col("p_name"), F.col("p_size")).alias("key"))


@query()
def title_similarity(t):
    return t.part.select("p_partkey", F.round(T.sequence_ratio("p_name", "p_type"), 6).alias("ratio"))


@query()
def plain_text_pages(t):
    return t.pages.select("page_id", F.sha2(T.plain_text(F.col("html")), 256).alias("digest"))
