"""Identity of works and chunk building: parts as works, line items as references and units, document lines as elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chunks as C
from corpusloom.operators import identity as I

from . import query
from .filters_joins import LINES, lines

WORKS = "SELECT p_partkey AS work_id, p_name AS title, p_size AS year, replace(p_brand, '#', '') AS author, CASE WHEN p_size % 2 = 0 THEN p_type END AS doi, NULL::VARCHAR AS arxiv FROM part"


def works(t):
    return t.part.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("author"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("doi"), F.lit(None).cast("string").alias("arxiv"))


@query(f"""WITH w AS ({WORKS}), r AS (SELECT work_id AS ref_id, CASE WHEN work_id % 9 = 0 THEN '' ELSE title END AS title, CASE WHEN work_id % 7 = 0 THEN NULL ELSE year END AS year, CASE WHEN work_id % 5 = 0 THEN NULL ELSE author END AS author, CASE WHEN work_id % 3 = 0 THEN 'new ' || work_id END AS doi FROM w),
i AS (SELECT doi AS value, min(work_id) AS work_id FROM (SELECT doi, work_id FROM w UNION ALL SELECT 'new ' || work_id, work_id FROM w WHERE work_id % 6 = 0) WHERE doi IS NOT NULL GROUP BY 1),
c AS (SELECT ref_id, count(DISTINCT w.work_id) AS n, min(w.work_id) AS by_title FROM r JOIN w ON r.title <> '' AND r.title = w.title AND coalesce(r.year = w.year, true) AND coalesce(r.author = w.author, true) AND coalesce(r.doi = w.doi, true) GROUP BY 1)
SELECT ref_id, CASE WHEN i.work_id IS NOT NULL THEN 'known' WHEN f AND n = 1 THEN 'title' WHEN f AND coalesce(n, 0) = 0 OR NOT f AND doi IS NOT NULL THEN 'new' END AS way,
CASE WHEN i.work_id IS NOT NULL OR f AND coalesce(n, 0) <= 1 OR NOT f AND doi IS NOT NULL THEN 'resolved' WHEN f THEN 'ambiguous' ELSE 'unresolved' END AS status,
(CASE WHEN i.work_id IS NOT NULL THEN 1.0 WHEN f AND n = 1 THEN 0.92 WHEN f AND n > 1 THEN 0 WHEN doi IS NOT NULL THEN 0.95 WHEN f THEN 0.82 ELSE 0 END)::DOUBLE AS confidence
FROM (SELECT *, title <> '' AND year IS NOT NULL AND author IS NOT NULL AS f FROM r) r LEFT JOIN i ON i.value = r.doi LEFT JOIN c USING (ref_id)""")
def resolve_references(t):
    w = works(t).withColumn("work_id", F.col("work_id").cast("string"))
    k = F.col("work_id").cast("long")
    refs = w.select(k.alias("ref_id"), F.when(k % 9 == 0, "").otherwise(F.col("title")).alias("title"), F.when(k % 7 != 0, F.col("year")).alias("year"), F.when(k % 5 != 0, F.col("author")).alias("author"), F.when(k % 3 == 0, F.concat(F.lit("new "), "work_id")).alias("doi"), "arxiv")
    own = w.select(F.col("doi").alias("value"), "work_id").union(w.filter(k % 6 == 0).select(F.concat(F.lit("new "), "work_id"), "work_id")).filter("value IS NOT NULL")
    ids = own.select(F.lit("doi").alias("kind"), "value", "work_id", F.col("work_id").cast("long").alias("created"))
    got = I.resolve(refs, w, ids)
    way = F.when(F.col("confidence") >= 0.99, "known").when(F.col("confidence") == 0.92, "title").when(F.startswith("work_id", F.lit("work_")), "new")
    return got.select("ref_id", way.alias("way"), "status", "confidence")


@query(f"""SELECT a.work_id AS first_id, b.work_id AS second_id FROM ({WORKS}) a JOIN ({WORKS}) b ON a.title = b.title AND a.work_id < b.work_id
WHERE (a.work_id % 2 = 0) <> (b.work_id % 2 = 0) AND a.title <> '' AND a.year = b.year AND a.author = b.author AND coalesce(a.doi = b.doi, true)""")
def mergeable_duplicates(t):
    return I.mergeable(works(t).withColumn("status", F.when(F.col("work_id") % 2 == 0, "ingested").otherwise("provisional")))


@query("""SELECT l_orderkey AS ref_id, CASE WHEN l_orderkey % 3 = 0 AND p_size > 20 THEN 'w' || p_partkey WHEN l_orderkey % 3 > 0 THEN 'old' END AS work_id, CASE WHEN l_orderkey % 3 = 0 AND p_size > 20 OR l_orderkey % 3 > 0 THEN 'resolved' ELSE 'ambiguous' END AS status FROM (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) JOIN part ON p_partkey = k""")
def reconcile_unresolved(t):
    refs = t.lineitem.groupBy(F.col("l_orderkey").alias("ref_id")).agg(F.min("l_partkey").alias("k"))
    links = refs.select("ref_id", F.when(F.col("ref_id") % 3 > 0, "old").alias("work_id"), F.when(F.col("ref_id") % 3 > 0, "resolved").otherwise("ambiguous").alias("status"))
    again = refs.join(t.part, F.col("k") == F.col("p_partkey")).select("ref_id", F.concat(F.lit("w"), "p_partkey").alias("work_id"), F.when(F.col("p_size") > 20, "resolved").otherwise("unresolved").alias("status"))
    return I.retry(links, again)


@query("""WITH k AS (SELECT p_type AS value, p_partkey AS work_id FROM part WHERE p_size > 25), n AS (SELECT p_type AS value, p_partkey AS work_id FROM part) SELECT 'insert' AS what, work_id, value AS detail FROM (SELECT * FROM n EXCEPT SELECT * FROM k) UNION ALL SELECT 'clash', n.work_id, k.work_id::VARCHAR FROM n JOIN k USING (value) WHERE n.work_id <> k.work_id""")
def attach_identifiers(t):
    own = t.part.select(F.col("p_partkey").alias("work_id"), F.lit("doi").alias("kind"), F.col("p_type").alias("value"), "p_size")
    new, clash = I.attach_identifiers(own, own.filter("p_size > 25"))
    return new.select(F.lit("insert").alias("what"), "work_id", F.col("value").alias("detail")).union(clash.select(F.lit("clash"), "work_id", F.col("owner").cast("string")))


@query("""WITH s AS (SELECT l_partkey AS work_id, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS st, min(CASE WHEN l_returnflag = 'R' THEN 'item ' || l_orderkey END) AS title, min(l_linenumber) AS year, max(l_discount) AS confidence FROM lineitem GROUP BY 1)
SELECT p_partkey AS work_id, ['provisional', 'identified', 'ingested'][greatest(2, coalesce(st, 1))] AS status, coalesce(s.title, p_name) AS title, coalesce(CASE WHEN p_size > 25 THEN p_size END, year)::INT AS year, greatest(0.05, confidence)::DOUBLE AS confidence FROM part LEFT JOIN s ON work_id = p_partkey""")
def promote_works(t):
    seen = t.lineitem.select(F.col("l_partkey").alias("work_id"), F.when(F.col("l_returnflag") == "R", "ingested").when(F.col("l_returnflag") == "N", "identified").otherwise("provisional").alias("status"), F.concat(F.lit("item "), "l_orderkey").alias("title"), F.col("l_linenumber").alias("year"), F.col("l_discount").alias("confidence"))
    known = t.part.select(F.col("p_partkey").alias("work_id"), F.lit("identified").alias("status"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("year"), F.lit(0.05).alias("confidence"))
    return I.promote(known, seen)


@query("SELECT p_partkey AS work_id, p_name AS title, p_size AS year FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def create_works(t):
    wanted = t.part.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))
    return I.create(wanted, t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("work_id")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey > 1 THEN o_custkey // 2 ELSE o_custkey END::BIGINT AS work_id FROM orders")
def work_of_reference(t):
    redirects = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") / 2).cast("long").alias("survivor"))
    return I.work_of(t.orders.select("o_orderkey", F.col("o_custkey").alias("work_id")), redirects, "o_orderkey")


@query("SELECT l_orderkey, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS works FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def works_of_documents(t):
    links = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("work_id"))
    return I.document_works(links, "l_orderkey").withColumn("works", F.array_join("works", ","))


@query("SELECT 'work' AS part, p_partkey::VARCHAR AS id, p_name AS value FROM part UNION ALL SELECT 'link', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders UNION ALL SELECT 'redirect', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier")
def identity_snapshot(t):
    return I.identity_snapshot(works(t), t.orders.select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("work_id")), t.supplier.select(F.col("s_suppkey").alias("loser"), F.col("s_nationkey").alias("survivor")))


KIND = "CASE p_size % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'table' WHEN 3 THEN 'reference' WHEN 4 THEN 'header' ELSE 'formula' END"


def elements(t):
    m = F.col("p_size") % 6
    kind = F.when(m == 0, "title").when(m == 1, "paragraph").when(m == 2, "table").when(m == 3, "reference").when(m == 4, "header").otherwise("formula")
    return t.part.select("p_partkey", F.col("p_brand").alias("doc"), kind.alias("kind"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("text"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") % 4).alias("section"), "p_size", "p_type")


@query(f"SELECT p_partkey, {KIND} AS kind FROM part WHERE {KIND} IN ('title', 'paragraph', 'table', 'formula') AND p_partkey % 11 > 0 AND p_partkey % 4 > 0")
def eligible_elements(t):
    return C.eligible(elements(t), "kind", "text", "section").select("p_partkey", "kind")


@query("""SELECT doc, section, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN section IS NULL THEN 1 ELSE 0 END, -section) AS place FROM (SELECT DISTINCT p_brand AS doc, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS section FROM part)""")
def section_order(t):
    sections = elements(t).filter("section IS NOT NULL").select("doc", "section", (-F.col("section")).alias("ord")).distinct()
    return C.section_order(sections, elements(t), "doc", "section", "ord").select("doc", "section", "place")


@query("""SELECT doc, section, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS chunks, row_number() OVER (PARTITION BY doc ORDER BY section IS NOT NULL, min(p_partkey)) AS place FROM (SELECT p_brand AS doc, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS section, p_partkey FROM part) GROUP BY doc, section""")
def chunks_by_section(t):
    return C.by_section(elements(t).withColumn("ord", F.col("p_partkey")), "doc", "section", "p_partkey", "ord").withColumn("chunks", F.array_join("chunks", ","))


@query(f"""WITH e AS (SELECT p_partkey, p_brand AS doc, {KIND} AS kind, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS section FROM part)
SELECT p_partkey, kind = 'title' OR lead(kind) OVER w IS NULL OR lead(kind) OVER w = 'title' OR section IS DISTINCT FROM lead(section) OVER w AS ends FROM e WINDOW w AS (PARTITION BY doc ORDER BY p_partkey)""")
def subsection_boundary(t):
    return C.subsection_ends(elements(t), "doc", "p_partkey", "kind", "section").select("p_partkey", "ends")


@query("SELECT l_orderkey, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end, min(l_quantity) AS x0, min(l_tax) AS y0, max(l_extendedprice) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY 1")
def page_envelope(t):
    units = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), F.col("l_extendedprice").alias("x1"), F.col("l_discount").alias("y1"))
    return C.envelope(units, "l_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(o_orderkey % 100) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s <= 120")
def overlap_tail(t):
    return C.overlap_tail(t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 100).alias("tokens")), "o_custkey", "o_orderkey", "tokens", 120).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size::DOUBLE END AS x0, CASE WHEN p_size % 3 > 0 THEN p_size + 3.0 END::DOUBLE AS y1, p_name AS latex FROM part")
def box_and_latex(t):
    four = F.array("p_size", F.col("p_size") + 1, F.col("p_size") + 2, F.col("p_size") + 3)
    b = C.box(F.when(F.col("p_size") % 3 > 0, four).otherwise(F.slice(four, 1, 3)))
    return t.part.select("p_partkey", b["x0"].alias("x0"), b["y1"].alias("y1"), C.bare_latex(F.concat(F.lit(" $$ "), "p_name", F.lit(" $$"))).alias("latex"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'references' WHEN 2 THEN 'supplement' ELSE 'main' END AS region, CASE p_size % 4 WHEN 2 THEN 'supplement' ELSE 'main' END AS bibliography FROM part")
def document_region(t):
    m = F.col("p_size") % 4
    near = F.struct(F.when(m == 0, "abstract").when(m == 1, "references").otherwise("body").alias("kind"), F.when(m == 2, F.concat(F.lit("Appendix "), "p_name")).otherwise(F.col("p_brand")).alias("title"))
    path = F.array(near, F.struct(F.lit("body").alias("kind"), F.col("p_brand").alias("title")))
    return t.part.select("p_partkey", C.region(path).alias("region"), C.references_region(path).alias("bibliography"))


@query("SELECT p_partkey, r_regionkey FROM part JOIN region ON CASE WHEN p_size % 4 = 2 THEN r_regionkey = 2 ELSE r_regionkey IN (0, 1) END")
def permitted_scopes(t):
    mentions = t.part.select("p_partkey", F.when(F.col("p_size") % 4 == 2, "supplement").otherwise("main").alias("region"))
    scopes = t.region.select("r_regionkey", F.element_at(F.array(*map(F.lit, ("main", "abstract", "supplement", "references", "other"))), F.col("r_regionkey") + 1).alias("parent"))
    return C.permitted_scopes(mentions, scopes, "region", "r_regionkey", "parent").select("p_partkey", "r_regionkey")


@query("""SELECT p_partkey, 'Paper:' || chr(10) || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Section:' || chr(10) || p_brand ELSE '' END || CASE WHEN p_size > 10 THEN chr(10) || chr(10) || 'Referenced works:' || chr(10) || '[1] = ' || CASE WHEN p_size > 30 THEN repeat('x', 177) || '...' ELSE p_name END ELSE '' END || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_brand) || ' ' || p_name END AS text FROM part""")
def retrieval_text(t):
    line = C.reference_line(F.when(F.col("p_size") <= 30, F.col("p_name")), F.concat(F.lit("[1] "), F.repeat(F.lit("x"), F.lit(300))), F.lit("1"))
    lines_ = F.when(F.col("p_size") > 10, F.array(F.concat(F.lit("[1] = "), line))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_brand"), F.lit(" "), "p_name"))
    return t.part.select("p_partkey", C.retrieval_text(F.col("p_type"), F.col("p_brand"), lines_, body).alias("text"))


@query(f"SELECT l.doc_id, l.page FROM ({LINES}) l LEFT JOIN (SELECT doc_id, min(page) AS f FROM ({LINES}) WHERE regexp_matches(line, '^[A-Z]') GROUP BY 1) h ON h.doc_id = l.doc_id WHERE f IS NULL OR page < f")
def front_matter(t):
    return C.front_matter(lines(t), "doc_id", "page", F.col("line").rlike("^[A-Z]")).select("doc_id", "page")


@query(f"SELECT doc_id, arg_min(found, page) AS found FROM (SELECT doc_id, page, nullif(regexp_extract(line, '[0-9]+\\.[0-9]+'), '') AS found FROM ({LINES})) WHERE found IS NOT NULL GROUP BY 1")
def first_pattern(t):
    return C.first_match(lines(t), "doc_id", "page", "line", r"[0-9]+\.[0-9]+")


@query("""WITH y AS (SELECT source, y, count(*) AS n FROM (SELECT source, unnest([(1990 + n_chars % 7)::VARCHAR, CASE WHEN n_chars % 2 = 0 THEN '2001' END]) AS y FROM documents) WHERE y IS NOT NULL GROUP BY ALL) SELECT source, arg_max(y, {'n': n, 'y': y})::INT AS year FROM y GROUP BY 1""")
def common_year(t):
    said = F.concat_ws(" ", F.lit("In"), (F.lit(1990) + F.col("n_chars") % 7).cast("string"), F.when(F.col("n_chars") % 2 == 0, "and (2001), 20011"))
    return C.common_year(t.documents.select("source", said.alias("line")), "source", "line")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0 OR l_discount = 0")
def cleanup_rows(t):
    return C.dropped_rows(t.lineitem.filter("l_tax = 0"), t.lineitem.filter("l_discount = 0"), "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, lower(p_brand) || ' et al:' || (1950 + p_size) || ',' || lower(p_brand) || ' et al:' || (1960 + p_size) || ',' || 'o''neil:' || (1950 + p_size) || 'a,' || 'o''neil:' || (1950 + p_size) || 'b' AS atoms FROM part""")
def author_year_atoms(t):
    y = lambda n: (F.lit(n) + F.col("p_size")).cast("string")
    inner = F.concat("p_brand", F.lit(" et  al. "), y(1950), F.lit(", "), y(1960), F.lit("; O’Neil "), y(1950), F.lit("a, b"))
    return t.part.select("p_partkey", F.array_join(F.transform(C.author_year_atoms(inner), lambda a: F.concat_ws(":", a["author"], a["year"])), ",").alias("atoms"))


@query("""WITH e AS (SELECT p_brand AS scope, p_size::VARCHAR AS key, p_partkey AS entry, p_type AS ident FROM part), a AS (SELECT l_orderkey AS span, l_linenumber AS pos, p_brand AS scope, (l_quantity::INT)::VARCHAR AS key FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) JOIN part ON p_partkey = l_partkey),
r AS (SELECT a.span, a.pos, a.scope, a.key, CASE WHEN count(entry) = 1 OR min(ident) = max(ident) THEN min(entry) END AS entry, CASE WHEN count(entry) = 0 THEN 'missing' WHEN NOT (count(entry) = 1 OR min(ident) = max(ident)) THEN 'ambiguous' END AS failure FROM a LEFT JOIN e USING (scope, key) GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY span) AS size, CASE WHEN count(entry) OVER (PARTITION BY span) = 0 THEN 'unresolved' WHEN count(entry) OVER (PARTITION BY span) = count(*) OVER (PARTITION BY span) THEN 'resolved' ELSE 'partially_resolved' END AS span_status FROM r""")
def mention_resolution(t):
    entries = t.part.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("entry"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("identity"), F.col("p_size").cast("string").alias("label"), F.lit("").alias("authors"), F.lit(None).cast("int").alias("year"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    atoms = items.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("span"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("scope"), F.col("l_quantity").cast("int").cast("string").alias("key")).distinct()
    return C.resolve_atoms(atoms, C.reference_index(entries)).select("span", "pos", "scope", "key", "entry", "failure", "size", "span_status")


@query("SELECT o_orderkey AS src, 'DERIVED_FROM' AS type, unnest(list_distinct([o_custkey, o_orderkey % 50, o_custkey])) AS dst FROM orders")
def provenance_edges(t):
    return C.derived_from(t.orders.select("o_orderkey", F.array("o_custkey", F.col("o_orderkey") % 50, "o_custkey").alias("s")), "o_orderkey", "s")


@query("SELECT 'u' || s_suppkey AS src_uuid, 'u' || n_nationkey AS dst_uuid, 'IN' AS type, s_suppkey % 3 AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 > 0")
def edge_property_rows(t):
    ids = t.supplier.filter("s_suppkey % 4 > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("canonical"), F.concat(F.lit("u"), "s_suppkey").alias("uuid")).union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("u"), "n_nationkey")))
    edges = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("IN").alias("type"), F.array("s_suppkey").alias("chunks"), F.array(F.col("s_suppkey") % 3).alias("roles"))
    return C.edge_rows(edges, ids).select("src_uuid", "dst_uuid", "type", F.get("properties.roles", F.lit(0)).alias("role"))


@query("SELECT p_partkey AS claim, upper(r_name) AS work_key, CASE WHEN p_size % 2 = 0 THEN 'self' ELSE 'mentioned' END AS role, p_partkey % 10 AS chunk, r_regionkey AS work FROM part JOIN region ON r_regionkey = p_size % 7")
def about_normalisation(t):
    names = F.array(*[F.lit(x) for x in ("africa ", " America", "asia", "Europe", "middle east", "mars", "venus")])
    items = t.part.select(F.col("p_partkey").alias("claim"), F.element_at(names, F.col("p_size") % 7 + 1).alias("work_key"), F.when(F.col("p_size") % 2 == 0, " Self").otherwise("odd").alias("role"), F.array().cast("array<bigint>").alias("chunks"), (F.col("p_partkey") % 10).alias("chunk"))
    return C.about_rows(items, t.region.select(F.col("r_name").alias("work_key"), F.col("r_regionkey").alias("work")), ("self", "comparison_target")).withColumn("chunk", F.get("chunks", F.lit(0))).drop("chunks")


@query("SELECT doc_id, source, n_chars FROM documents WHERE trim(text) <> ''")
def evidence_rows(t):
    return C.evidence_rows(t.documents, "doc_id", "source", "text").join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "source", "n_chars")


@query("SELECT 'part' AS type, p_name AS name, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT 'nation', n_name, NULL, NULL FROM nation")
def node_union(t):
    return C.all_nodes(part=t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("size")), supplier=t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), nation=t.nation.select(F.col("n_name").alias("name"))).select("type", "name", "size", "balance")


@query("SELECT o_custkey, string_agg(s, ' ' ORDER BY o) AS summary FROM (SELECT o_custkey, o_orderstatus, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS s, min(o_orderkey) AS o FROM orders GROUP BY ALL) GROUP BY 1")
def hierarchical_summary(t):
    return C.summarised(t.orders.withColumn("text", F.col("o_orderkey").cast("string")), "o_custkey", "o_orderstatus", "o_orderkey", "text", lambda parts: F.array_join(parts, " "))
