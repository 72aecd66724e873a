"""Chunks of documents: eligible elements, boundaries, rows, headers and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Kinds of elements that chunks are made of, hints of supplementary parts, kinds of nodes.
PROSE = ("paragraph", "list", "list_item", "title", "caption", "code", "footnote")
SUPPLEMENT_HINTS = ("supplement", "appendix", "supporting information")


def eligible(elements: DataFrame, kind: str, text: str, major: str) -> DataFrame:
    """Elements with text that stand in a major section and are prose, tables or formulas."""
    return elements.filter(F.col(kind).isin(*PROSE, "table", "formula") & F.col(major).isNotNull() & (F.trim(F.coalesce(text, F.lit(""))) != ""))


def section_order(sections: DataFrame, grouped: DataFrame, document: str, section: str, order: str) -> DataFrame:
    """Sections that hold chunks, in the order of the document; those without a section come last: with ``place``."""
    used = grouped.select(document, section).distinct().join(sections.select(document, section, order), [document, section], "left")
    w = Window.partitionBy(document).orderBy(F.asc_nulls_last(order), F.asc_nulls_last(section))
    return used.withColumn("place", F.row_number().over(w))


def by_section(chunks: DataFrame, document: str, section: str, chunk: str, order: str) -> DataFrame:
    """Chunk ids of each section, in order; those without a section first."""
    lists = chunks.groupBy(document, section).agg(F.sort_array(F.collect_list(F.struct(order, chunk))).alias("c"), F.min(order).alias("_first"))
    w = Window.partitionBy(document).orderBy(F.col(section).isNotNull(), "_first")
    return lists.select(document, section, F.transform("c", lambda x: x[chunk]).alias("chunks"), F.row_number().over(w).alias("place"))


def subsection_ends(elements: DataFrame, document: str, order: str, kind: str, section: str) -> DataFrame:
    """Elements with ``ends``: a title, the last one, one before a title, or one before another section."""
    w = Window.partitionBy(document).orderBy(order)
    after, there = F.lead(kind).over(w), F.lead(section).over(w)
    return elements.withColumn("ends", (F.col(kind) == "title") | after.isNull() | (after == "title") | ~F.col(section).eqNullSafe(there))


def envelope(units: DataFrame, *by: str) -> DataFrame:
    """Pages and the box around all units (page, x0, y0, x1, y1) of each chunk."""
    return units.groupBy(*by).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def overlap_tail(units: DataFrame, document: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The last units of each chunk that fit the overlap budget together."""
    back = Window.partitionBy(document).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("_sum", F.sum(tokens).over(back)).filter(F.col("_sum") <= budget).drop("_sum")


def box(c: Column) -> Column:
    """Four numbers as a box; null for anything else."""
    return F.when(F.size(c) == 4, F.struct(*[F.get(c, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def bare_latex(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"^\$\$|\$\$$", ""))


def region(path: Column) -> Column:
    """The part of the document that a chain of sections (nearest first; kind and title) puts an element in."""
    hinted = lambda s: F.exists(F.array(*map(F.lit, SUPPLEMENT_HINTS)), lambda h: F.contains(F.lower(s["title"]), h))
    of = lambda s: F.when(s["kind"] == "abstract", "abstract").when(s["kind"] == "references", "references").when(hinted(s), "supplement")
    return F.coalesce(F.get(F.array_compact(F.transform(F.coalesce(path, F.array()), of)), F.lit(0)), F.lit("main"))


def references_region(path: Column) -> Column:
    """Whether a bibliography belongs to the supplement, by the sections around it."""
    outer = F.filter(F.coalesce(path, F.array()), lambda s: s["kind"] != "references")
    return F.when(F.exists(outer, lambda s: F.exists(F.array(*map(F.lit, SUPPLEMENT_HINTS)), lambda h: F.contains(F.lower(s["title"]), h))), "supplement").otherwise("main")


def permitted_scopes(mentions: DataFrame, scopes: DataFrame, region: str, scope: str, parent: str) -> DataFrame:
    """Each mention with the bibliography scopes it may cite: supplements cite their own, all else main and abstract ones."""
    wanted = mentions.withColumn("_side", F.when(F.col(region) == "supplement", "s").otherwise("m"))
    own = scopes.filter(F.col(parent).isin("supplement", "main", "abstract")).select(scope, F.when(F.col(parent) == "supplement", "s").otherwise("m").alias("_side"))
    return wanted.join(own, "_side").drop("_side")


def redundant_header(header: Column, text: Column) -> Column:
    """Whether a chunk's text says its header already."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"<[^>]+>", "")))
    return F.coalesce((flat(header) == "") | F.startswith(flat(text), flat(header)), F.lit(True))


def reference_line(title: Column, raw: Column, key: Column) -> Column:
    """A reference in one line: its title, else its text without the marker, at most 180 characters; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]+>", ""), r"^\s*(\[[^\]]{1,40}\]|\d{1,4}[.)])\s*", ""))
    cut = F.when(F.length(bare) > 180, F.concat(F.left(bare, F.lit(177)), F.lit("..."))).otherwise(F.nullif(bare, F.lit("")))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), cut)


def retrieval_text(title: Column, header: Column, lines: Column, text: Column) -> Column:
    """What is indexed of a chunk: paper, section where the text doesn't begin with it, cited works, text."""
    parts = F.array(
        F.concat(F.lit("Paper:\n"), title),
        F.when(header.isNotNull() & ~redundant_header(header, text), F.concat(F.lit("Section:\n"), header)),
        F.when(F.size(lines) > 0, F.concat(F.lit("Referenced works:\n"), F.array_join(lines, "\n"))),
        text,
    )
    return F.array_join(F.filter(F.array_compact(parts), lambda p: F.trim(p) != ""), "\n\n")


def front_matter(items: DataFrame, document: str, order: str, heading: Column) -> DataFrame:
    """Items before a document's first heading; all of them where there is none."""
    first = items.filter(heading).groupBy(document).agg(F.min(order).alias("_first"))
    return items.join(first, document, "left").filter(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def first_match(items: DataFrame, document: str, order: str, text: str, pattern: str) -> DataFrame:
    """Of each document the first match of a pattern over its items: a DOI, a keyword line."""
    hit = items.withColumn("found", F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))).filter("found IS NOT NULL")
    return hit.groupBy(document).agg(F.min_by("found", order).alias("found"))


def common_year(items: DataFrame, document: str, text: str) -> DataFrame:
    """The year that a document's items name most often; of equally frequent ones the later."""
    years = items.select(document, F.explode(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))).alias("year")).groupBy(document, "year").agg(F.count("*").alias("n"))
    return years.groupBy(document).agg(F.max_by(F.col("year").cast("int"), F.struct("n", "year")).alias("year"))


def dropped_rows(margins: DataFrame, repeats: DataFrame, *keys: str) -> DataFrame:
    """Rows that cleaning takes out: running margins and adjacent repeats, each once."""
    return margins.select(*keys).union(repeats.select(*keys)).distinct()


def author_key(c: Column) -> Column:
    """An author as a citation names it, in one form."""
    one = F.regexp_replace(F.replace(F.lower(c), F.lit("’"), F.lit("'")), r"\s+", " ")
    return F.trim(F.replace(F.regexp_replace(one, r"\bet\s+al\.?", "et al"), F.lit("."), F.lit("")))


def author_year_atoms(inner: Column) -> Column:
    """(author, year) pairs of a bracket such as "One 2007, 2009; Two et al. 2001a,b"."""
    pattern = r"(?i)^(.+?)[,\s]\s*([12]\d{3}[a-d]?)(?:\s*,\s*(.+))?\s*$"

    def expand(p: Column) -> Column:
        author, year, tail = (F.trim(F.regexp_extract(p, pattern, i)) for i in (1, 2, 3))
        pair = lambda y: F.struct(author_key(author).alias("author"), F.lower(y).alias("year"))
        second = F.when(tail.rlike(r"^[12]\d{3}[a-d]?$"), tail).when(tail.rlike("(?i)^[a-z]$"), F.concat(F.regexp_replace(year, "(?i)[a-z]$", ""), tail))
        return F.when(year == "", F.array().cast("array<struct<author:string,year:string>>")).otherwise(F.when(second.isNull(), F.array(pair(year))).otherwise(F.array(pair(year), pair(second))))

    return F.flatten(F.transform(F.filter(F.transform(F.split(inner, ";"), lambda p: F.trim(p)), lambda p: p != ""), expand))


def reference_index(entries: DataFrame) -> DataFrame:
    """(scope, key, entry, ord, identity) by which brackets find entries(scope, entry, ord, identity, label, authors, year)."""
    base = ["scope", "entry", "ord", "identity"]
    labels = entries.filter("label IS NOT NULL").select(*base, F.col("label").alias("key"))
    names = entries.select(*base, F.explode(T.author_year_keys(F.col("authors"), F.col("year"))).alias("key"))
    return labels.union(names).distinct()


def resolve_atoms(atoms: DataFrame, index: DataFrame) -> DataFrame:
    """Atoms(span, pos, scope, key) with ``entry`` or ``failure``, and the state of their whole span."""
    from corpusloom.operators.relational import resolve_labels

    rows = resolve_labels(atoms, index, "scope", "key", "entry", "ord", "identity")
    spans = rows.groupBy("span").agg(F.count("*").alias("size"), F.count("entry").alias("_r"))
    state = F.when(F.col("_r") == 0, "unresolved").when(F.col("_r") == F.col("size"), "resolved").otherwise("partially_resolved")
    return rows.join(spans, "span").withColumn("span_status", state).drop("_r")


def derived_from(objects: DataFrame, object_id: str, sources: str) -> DataFrame:
    """A DERIVED_FROM edge for each source chunk of an object."""
    return objects.select(F.col(object_id).alias("src"), F.lit("DERIVED_FROM").alias("type"), F.explode(F.array_distinct(sources)).alias("dst"))


def edge_rows(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges with their ends' stored ids and their provenance and roles as one property row; ends without an id go."""
    ids_ = lambda side: node_ids.select(F.col("canonical").alias(side), F.col("uuid").alias(f"{side}_uuid"))
    return edges.join(ids_("src"), "src").join(ids_("dst"), "dst").select("src_uuid", "dst_uuid", "type", F.struct("chunks", "roles").alias("properties"))


def about_rows(items: DataFrame, works: DataFrame, roles: tuple[str, ...], default: str = "mentioned") -> DataFrame:
    """ABOUT items with upper-case work keys, known roles (else ``default``) and their chunk's id where they name none; unknown works go."""
    role = F.lower(F.trim("role"))
    own = items.select("claim", F.upper(F.trim("work_key")).alias("work_key"), F.when(role.isin(*roles), role).otherwise(default).alias("role"), F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(F.array("chunk")).alias("chunks"))
    return own.join(works.select(F.upper("work_key").alias("work_key"), "work"), "work_key")


def evidence_rows(chunks: DataFrame, chunk: str, path: str, text: str) -> DataFrame:
    return chunks.filter(F.trim(text) != "").select(chunk, path, text)


def all_nodes(**kinds: DataFrame) -> DataFrame:
    """Nodes of all kinds under one schema: what a kind lacks is null."""
    out = None
    for kind, df in kinds.items():
        rows = df.withColumn("type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def summarised(chunks: DataFrame, document: str, section: str, order: str, text: str, summarise) -> DataFrame:
    """Document summaries in two steps: sections from their chunks in order, then documents from their sections in order.

    ``summarise`` maps a Column of an array of texts to a text; a model can stand behind it as a Pandas UDF.
    """
    parts = chunks.groupBy(document, section).agg(summarise(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])).alias("_s"), F.min(order).alias("_o"))
    return parts.groupBy(document).agg(summarise(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"])).alias("summary"))
