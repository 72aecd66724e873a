"""Scope of queries: which works evidence may come from, and which works it must be about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import relational as R

# Cues that a query asks about several documents.
SEVERAL_CUES = ("分别", "比较", "连续谱", "这四篇", "三篇", "compare", "versus", " vs ")


def mention_index(works: DataFrame, work: str, title: str, aliases: str | None = None, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """(phrase, work): titles, aliases and identifiers, normalised, that one work alone owns."""
    cells = [F.array(F.col(title), *[F.col(c) for c in identifiers])] + ([F.col(aliases)] if aliases else [])
    phrases = works.select(work, F.explode(F.transform(F.concat(*cells), T.scope_normalize)).alias("phrase")).filter("phrase <> ''")
    return phrases.groupBy("phrase").agg(F.min(work).alias(work), F.max(work).alias("_hi")).filter(F.col(work) == F.col("_hi")).drop("_hi")


def proven_subjects(candidates: DataFrame, candidate: str, text: str, structured: str, derived: str, subjects: list, index: DataFrame, work: str) -> DataFrame:
    """(candidate, proven): subjects that a candidate is provably about, in the order of ``subjects``.

    A subject is proven by the candidate's structured subjects, by what it is derived from, or by a phrase that only the subject owns.
    """
    order = F.array(*[F.lit(s) for s in subjects])
    own = index.filter(F.col(work).isin(subjects))
    said = R.mentions(candidates, candidate, text, own, work).groupBy(candidate).agg(F.collect_set(work).alias("_said"))
    empty = F.array().cast(candidates.schema[structured].dataType)
    found = F.concat(F.coalesce(structured, empty), F.coalesce(derived, empty), F.coalesce("_said", empty))
    return candidates.join(said, candidate, "left").select(candidate, F.filter(order, lambda s: F.array_contains(found, s)).alias("proven"))


def about_subjects(candidates: DataFrame, proven: DataFrame, candidate: str, structured: str) -> DataFrame:
    """Candidates with a proven subject; proven subjects join their structured ones."""
    kept = candidates.join(proven.filter(F.size("proven") > 0), candidate)
    return kept.withColumn(structured, F.array_union(F.coalesce(structured, F.array().cast(candidates.schema[structured].dataType)), "proven")).drop("proven")


def scoped(candidates: DataFrame, work: str, candidate: str, structured: str, sources: list, work_set: list, excluded: list, proven: DataFrame | None) -> DataFrame:
    """Both filters: first where evidence comes from, then what it is about (unless ``proven`` is None, when citations give the scope)."""
    own = R.within_scope(candidates, work, sources, work_set, excluded) if sources or work_set or excluded else candidates
    return own if proven is None else about_subjects(own, proven, candidate, structured)


def explicit_lock(documents: Column, hard_scope: Column, comparative: Column) -> Column:
    """Whether the documents that a query names lock the search to them."""
    n = F.size(documents)
    return (n > 0) & ~hard_scope & ~((n == 1) & comparative)


def clean_explicit(given: Column, allowed: Column) -> Column:
    """Given works without repeats that are allowed; an empty list allows every work."""
    own = F.array_distinct(F.coalesce(given, F.array().cast("array<string>")))
    return F.when(F.size(allowed) == 0, own).otherwise(F.filter(own, lambda w: F.array_contains(allowed, w)))


def asks_for_several(query: Column) -> Column:
    return R.any_of(query, SEVERAL_CUES)


def search_text(query: Column, topics: Column) -> Column:
    """The query with its topics, blank ones left out."""
    return F.trim(F.array_join(F.concat(F.array(query), F.filter(topics, lambda x: F.trim(x) != "")), " "))


def source_by_title(queries: DataFrame, query: str, text: str, works: DataFrame, work: str, title: str) -> DataFrame:
    """Of the works whose whole title stands in a query that with the longest title; ties go to the smaller id."""
    phrases = works.select(work, T.scope_normalize(F.col(title)).alias("phrase")).filter("phrase <> ''")
    hit = R.mentions(queries, query, text, phrases, work).join(phrases, work)
    return hit.groupBy(query).agg(F.min_by(work, F.struct(-F.length("phrase"), F.col(work))).alias(work))


def catalogues(works: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """All works, with ``ingested``: whether a document stands for it."""
    own = links.select(work).distinct().withColumn("ingested", F.lit(True))
    return works.join(own, work, "left").fillna({"ingested": False})


def map_keys(given: DataFrame, key: str, catalogue: DataFrame, work: str) -> DataFrame:
    """A planner's keys, upper-cased, with their works; one that the catalogue lacks has none and is told by ``known``."""
    own = given.withColumn("_k", F.upper(F.trim(key)))
    return own.join(catalogue.select(F.col(key).alias("_k"), work), "_k", "left").withColumn("known", F.col(work).isNotNull()).drop("_k")


def citing_sources(edges: DataFrame, subjects: list, ingested: DataFrame, excluded: list, work: str) -> DataFrame:
    """Works that cite a subject, and ingested subjects themselves, without excluded ones."""
    citing = edges.filter((F.col("type") == "CITES") & F.col("dst").isin(subjects)).select(F.col("src").alias(work))
    own = ingested.select(work).filter(F.col(work).isin(subjects))
    return citing.union(own).distinct().filter(~F.col(work).isin(excluded) if excluded else F.lit(True))
