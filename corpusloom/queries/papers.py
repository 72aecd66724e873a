"""Metadata of documents: parts stand for papers, their attributes for the items that a parser reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import metadata as M
from corpusloom.operators import splits as S

from . import query


def items(t):
    """Items of each part: a running line, title, people, place, abstract, keywords, numbered heading, body; which ones varies with size and key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    who = F.translate("p_brand", "#1234567890", " abcdefghij")
    year = (1950 + size).cast("string")
    row = lambda kind, level, page, raw: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), F.lit(page).alias("page"), raw.alias("raw"))
    every = F.array(
        F.when(size % 3 == 0, row("header", None, 0, F.concat(F.lit("Press "), year, F.lit(", no. 12"), year))),
        F.when(size % 5 > 0, row("text", 1, 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b>")))),
        F.when(size % 5 == 0, row("text", None, 0, F.col("p_name"))),
        F.when(size % 4 == 1, row("text", None, 0, F.concat(who, F.lit(" and Ann Lee. "), year, F.lit(". "), F.upper("p_name"), F.lit(". Journal of "), "p_type"))),
        F.when(size % 4 > 1, row("text", None, 0, F.concat(who, F.lit("<sup>1</sup>, Bo Lee*, 3rd One & Solo")))),
        row("text", None, 0, F.concat(F.lit("<sup>a</sup>"), "p_type", F.lit(", "), "p_brand", F.lit(" doi:10.1234/X."), k.cast("string"), F.lit(" x"))),
        F.when(size % 2 == 0, row("text", 2, 0, F.lit("Abstract"))),
        F.when(size % 2 == 0, row("text", None, 0, F.concat(F.lit("On "), "p_type"))),
        F.when(size % 7 == 0, row("text", None, 0, F.repeat("p_type", F.lit(40)))),
        F.when(size % 3 == 1, row("text", None, 0, F.concat(F.lit("Keywords: "), "p_brand", F.lit("; "), "p_type", F.lit(", ")))),
        F.when(size % 3 == 2, row("text", None, 0, F.concat(F.lit("Available online 3 May "), year))),
        row("text", 2, 1, F.lit("1. Introduction")),
        row("text", None, 1, F.concat(F.lit("Since 1999, "), "p_name")),
    )
    flat = t.part.select(k.alias("doc"), F.posexplode(F.array_compact(every)).alias("pos", "i")).select("doc", "pos", "i.*")
    return flat.withColumn("text", T.squeeze(F.regexp_replace("raw", "<[^>]+>", "")))


@query()
def document_metadata(t):
    """No SQL has the sequence ratio: tests/test_metadata.py holds it against brute force."""
    got = M.document_metadata(items(t))
    return got.select("doc", "title", *[F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "affiliations")], "abstract", "doi", "year")


@query("SELECT p_partkey AS doc, array_to_string(list_filter([trim(p_brand), trim(p_type)], lambda x: x <> ''), '|') AS keywords FROM part WHERE p_size % 3 = 1")
def document_keywords(t):
    return M.keywords(items(t)).withColumn("keywords", F.array_join("keywords", "|"))


@query("""SELECT p_partkey AS doc, CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 4 = 1 THEN 1950 + p_size WHEN p_partkey BETWEEN 1900 AND 2099 THEN p_partkey END ELSE 1950 + p_size END::INT AS year FROM part""")
def document_years(t):
    return M.document_year(items(t))


@query("""SELECT p_partkey AS doc, 'On ' || p_type || CASE WHEN p_size % 7 = 0 THEN chr(10) || repeat(p_type, 40) ELSE '' END || CASE WHEN p_size % 3 = 2 THEN chr(10) || 'Available online 3 May ' || (1950 + p_size) ELSE '' END AS block FROM part WHERE p_size % 2 = 0""")
def named_block(t):
    return M.named_block(items(t), "Abstract")


@query("""SELECT p_partkey AS doc, 'a' || p_type || ', ' || p_brand || ' doi:10.1234/X.' || p_partkey || ' x' AS affiliations, '10.1234/x.' || p_partkey AS doi FROM part WHERE length(p_type) + length(p_brand) + length(p_partkey::VARCHAR) + 32 > 40""")
def affiliations_and_doi(t):
    got = M.by_document(M.affiliations(items(t)), M.document_doi(items(t)))
    return got.select("doc", F.array_join("affiliations", "|").alias("affiliations"), "doi")


@query("""WITH p AS (SELECT p_partkey AS doc, CASE WHEN p_size % 4 > 0 THEN p_name END AS text, CASE WHEN p_size % 3 = 0 THEN [] WHEN p_size % 3 = 1 THEN [p_type, p_brand] END AS c, CASE WHEN p_size % 5 = 0 THEN [p_brand] ELSE [] END AS f FROM part),
r AS (SELECT doc, 'main' AS role, NULL::INT AS nth, text, 0 AS o FROM p WHERE text IS NOT NULL OR len(coalesce(c, [])) > 0 OR len(f) > 0
UNION ALL SELECT doc, 'caption', i - 1, c[i], 1 FROM p, LATERAL (SELECT unnest(range(1, len(coalesce(c, [])) + 1)) AS i) UNION ALL SELECT doc, 'footnote', 0, f[1], 2 FROM p WHERE len(f) > 0)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY o, nth) - 1)::INT AS part, role, nth::INT AS nth, text, CASE WHEN o > 0 THEN 0 END AS parent_part FROM r""")
def caption_elements(t):
    m = F.col("p_size")
    none = F.array().cast("array<string>")
    rows = t.part.select(F.col("p_partkey").alias("doc"), F.lit(0).alias("pos"), F.when(m % 4 > 0, F.col("p_name")).alias("text"), F.when(m % 3 == 0, none).when(m % 3 == 1, F.array("p_type", "p_brand")).alias("captions"), F.when(m % 5 == 0, F.array("p_brand")).otherwise(none).alias("footnotes"))
    return M.element_rows(rows).drop("pos")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 13 AS n FROM orders), h AS (SELECT 'key' || chr(10) || '---' AS head),
p AS (SELECT o_orderkey, n, unnest(range(0, CASE WHEN n <= 3 THEN 1 ELSE (n + 2) // 3 END)) AS part FROM o)
SELECT o_orderkey, part::INT AS part, head || coalesce(chr(10) || (SELECT string_agg('r' || i || ' of ' || o_orderkey, chr(10) ORDER BY i) FROM range(1, 13) r(i) WHERE i <= n AND (i - 1) // 3 = part), '') AS text FROM p, h""")
def table_parts(t):
    rows = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 13).cast("int")), lambda i: F.when(i == 0, F.lit("key\n---")).otherwise(F.concat(F.lit("r"), i.cast("string"), F.lit(" of "), "o_orderkey")))
    return t.orders.select("o_orderkey", F.posexplode(S.table_parts(F.array_join(rows, "\n"), 12)).alias("part", "text"))


@query()
def forced_splits(t):
    """Pieces of at most 64 words of whole texts; tests/test_splits.py holds them against brute force."""
    return t.documents.select("doc_id", F.posexplode(S.force_split(64)(F.col("text"))).alias("piece", "p")).select("doc_id", "piece", "p.start", "p.end", "p.kind")
