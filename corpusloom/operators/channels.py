"""Retrieval channels that turn hits on nodes into ranked chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Node types and indexed fields that each search reads.
FAMILIES = {
    "chunks": (("Chunk", "text"),),
    "entities": (("Entity", "name"), ("Entity", "description")),
    "claims": (("Claim", "text"),),
    "entity_claim": (("Entity", "name"), ("Entity", "description"), ("Claim", "text")),
    "associative_seeds": (("Chunk", "text"), ("Entity", "name"), ("Entity", "description"), ("Claim", "text")),
    "graph_seeds": (("Entity", "name"), ("Entity", "description"), ("Claim", "text"), ("Triplet", "text"), ("ConceptRelation", "description")),
    "summaries": (("Summary", "text"),),
}
ANCHOR_SCORE, NEIGHBOUR_SCORE = 1.25, 1.0


@dataclass(frozen=True)
class Ablation:
    """Switches of an evaluation run; all on is the production path."""

    lexical: bool = True
    semantic: bool = True
    entity_claim: bool = True
    graph: bool = True
    global_context: bool = True
    confirmed_knowledge: bool = True
    subject_claim: bool = False
    claim_vectors: bool = False
    citation_anchor: bool = False
    citation_scope: bool = False
    subject_filter: bool = True
    dedupe_pool: bool = False
    dedupe_final: bool = False
    trace: bool = False

    @classmethod
    def of(cls, spec: dict) -> Ablation:
        """Switches from a JSON-like mapping; what it leaves out keeps its default, what it alone has is an error."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(spec) - known):
            raise ValueError(f"unknown switches: {unknown}")
        return cls(**{k: bool(v) for k, v in spec.items()})

    def channels(self, planned: tuple[str, ...]) -> tuple[str, ...]:
        """Planned channels that are on, and the two that only a policy adds."""
        return tuple(c for c in planned if getattr(self, c, True)) + tuple(c for c in ("subject_claim", "citation_anchor") if getattr(self, c))


def families(spark: SparkSession) -> DataFrame:
    """(family, type, field) of every search."""
    return spark.createDataFrame([(name, *pair) for name, pairs in FAMILIES.items() for pair in pairs], "family string, type string, field string")


def in_family(hits: DataFrame, family: str) -> DataFrame:
    """Hits(type, field, ...) on what the family reads."""
    test = F.lit(False)
    for kind, field in FAMILIES[family]:
        test = test | ((F.col("type") == kind) & (F.col("field") == field))
    return hits.filter(test)


def best_nodes(hits: DataFrame, query: str, node: str, score: str, limit: int) -> DataFrame:
    """Of each query the best hit on every node, then the ``limit`` best nodes: with rank."""
    best = hits.groupBy(query, node).agg(F.max(score).alias(score))
    return ranked(best, query, score, node, limit)


def ranked(df: DataFrame, query: str, score: str, tie: str, limit: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def to_chunks(hits: DataFrame, nodes: DataFrame, chunks: DataFrame, query: str, node: str, chunk: str, score: str, limit: int) -> DataFrame:
    """Ranked chunks of a channel: each node lends its score to its source chunks among ``chunks``; a chunk keeps the best."""
    lent = hits.select(query, node, score).join(nodes.select(node, F.explode("chunks").alias(chunk)), node)
    own = lent.join(chunks.select(chunk).distinct(), chunk, "left_semi")
    return ranked(own.groupBy(query, chunk).agg(F.max(score).alias(score)), query, score, chunk, limit)


def semantic(hits: DataFrame, nodes: DataFrame, chunks: DataFrame, family: str, query: str, node: str, chunk: str, score: str, limit: int) -> DataFrame:
    """The semantic, entity-and-claim and summary channels: a family's best nodes at twice the limit, then chunks."""
    best = best_nodes(in_family(hits, family), query, node, score, 2 * limit)
    return to_chunks(best, nodes, chunks, query, node, chunk, score, limit)


def graph(seeds: DataFrame, reached: DataFrame, edges: DataFrame, nodes: DataFrame, chunks: DataFrame, query: str, node: str, chunk: str, score: str, limit: int) -> DataFrame:
    """The graph channel: chunks of seed nodes, and chunks of edges between nodes that traversal reached.

    An edge scores as its better end; a chunk keeps the best of all.
    """
    own = seeds.select(query, node, score).join(nodes.select(node, F.explode("chunks").alias(chunk)), node).select(query, chunk, score)
    at = reached.select(query, node, score)
    ends = lambda side: at.select(query, F.col(node).alias(side), F.col(score).alias(f"_{side}"))
    walked = edges.join(ends("src"), "src").join(ends("dst"), [query, "dst"]).select(query, F.explode("chunks").alias(chunk), F.greatest("_src", "_dst").alias(score))
    every = own.union(walked).join(chunks.select(chunk).distinct(), chunk, "left_semi").select(query, chunk, score)
    return ranked(every.groupBy(query, chunk).agg(F.max(score).alias(score)), query, score, chunk, limit)


def phrase_scores(hits: DataFrame, claim: str, phrase: str, score: str, most: int = 4) -> DataFrame:
    """The best score of each claim over a query's first phrases."""
    return hits.filter(F.col(phrase) < most).groupBy(claim).agg(F.max(score).alias(score))


def anchors(edges: DataFrame, subjects: list, chunks: DataFrame, chunk: str, before: str, after: str) -> DataFrame:
    """Chunks that cite a subject, and the chunks next to them: (chunk, score), the better where both hold."""
    cites = edges.filter((F.col("type") == "CITES") & F.col("dst").isin(subjects)).select(F.explode("chunks").alias(chunk)).distinct()
    at = cites.join(chunks, chunk)
    near = at.select(F.explode(F.array(before, after)).alias(chunk)).filter(F.col(chunk).isNotNull())
    return at.select(chunk, F.lit(ANCHOR_SCORE).alias("score")).union(near.withColumn("score", F.lit(NEIGHBOUR_SCORE))).groupBy(chunk).agg(F.max("score").alias("score"))


def recalled(seeds: DataFrame, profile: str, hard_scope: bool) -> DataFrame:
    """Graph seeds with provenance, for comprehensive queries without a hard scope; else none."""
    return seeds.filter((F.size("chunks") > 0) & F.lit(profile == "comprehensive" and not hard_scope))


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's words that a text holds: the reranker where none is given."""
    from corpusloom.functions import text as T

    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(text))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, query: str, candidate: str, said: str, text: str, limit: int, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """Candidates in the order of a scorer's relevance, from 1: ``final_rank``; ``scorer`` may be a Pandas UDF of a model."""
    rows = candidates.withColumn("relevance", scorer(F.col(said), F.col(text)))
    order = Window.partitionBy(query).orderBy(F.desc("relevance"), candidate)
    return rows.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= limit)


def normalised_hits(hits: DataFrame) -> DataFrame:
    """Hits of three shapes as (id, text, score): a sole source chunk stands in for a missing id; no score is 1 / rank.

    Rows without id or text go.
    """
    sole = F.when(F.size("chunk_ids") == 1, F.get("chunk_ids", F.lit(0)))
    score = F.coalesce(F.col("score"), F.when(F.col("distance").isNotNull(), 1 / (1 + F.greatest(F.col("distance"), F.lit(0.0)))), 1 / F.col("rank"))
    out = hits.select(F.coalesce("canonical_id", "id", sole).alias("id"), F.nullif(F.trim("text"), F.lit("")).alias("text"), score.alias("score"))
    return out.filter("id IS NOT NULL AND text IS NOT NULL")


def edge_ends(edges: DataFrame, score: str) -> DataFrame:
    """Both ends of each returned edge as hits with the edge's score and provenance; the better of a node's hits stays."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), score, "chunks")
    return ends.groupBy("node").agg(F.max(score).alias(score), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))


def trace(candidates: DataFrame, stage: str, columns: list[str]) -> DataFrame:
    """Flat rows of candidates at a stage, for reports."""
    return candidates.select(F.lit(stage).alias("stage"), *columns)


def chunk_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct source chunks of nodes and edges."""
    return nodes.select(F.explode("chunks").alias("chunk")).union(edges.select(F.explode("chunks"))).distinct()


def neighbourhood(edges: DataFrame, reached: DataFrame, node: str) -> DataFrame:
    """Edges between nodes that a traversal reached, sorted."""
    ids = reached.select(node).distinct()
    src, dst = ids.withColumnRenamed(node, "src"), ids.withColumnRenamed(node, "dst")
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").orderBy("dst", "src")


def export(nodes: DataFrame, edges: DataFrame, priority: str, node: str, most_nodes: int = 80, most_edges: int = 160) -> tuple[DataFrame, DataFrame]:
    """A graph to look at: the nodes of the least priority numbers, and edges between them."""
    own = nodes.groupBy(node).agg(F.min(priority).alias(priority)).orderBy(priority, node).limit(most_nodes)
    return own, neighbourhood(edges, own, node).limit(most_edges)
