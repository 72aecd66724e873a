"""Query planning and the query path over document tables.

Scope is resolved on the driver from cues in the query (it is a handful of strings); everything after
it is one lazy DataFrame.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ranking as K
from corpusloom.operators import relational as R
from corpusloom.operators import sequence as S

# Channels of each profile and cues of the scope rules.
CHANNELS = {
    "truth": ("lexical", "semantic", "confirmed_knowledge"),
    "associative": ("semantic", "entity_claim", "graph", "global_context", "confirmed_knowledge"),
    "comprehensive": ("lexical", "semantic", "entity_claim", "graph", "global_context", "confirmed_knowledge"),
}
COMPARE_CUES = ("比较", "对比", "差异", "compare", "versus", " vs ", "difference", "differences")
SELF_CUES = ("自己报告", "自己承认", "自身", "itself", "self-reported", "self reported", "own limitation", "own limitations")
DISCUSSION_CUES = ("现有论文", "有哪些评价", "评价或讨论", "评价", "讨论", "existing papers", "what do papers say", "how do papers discuss", "discussion of", "comments on")
EXTERNAL_CUES = ("后来论文", "其他论文", "别的论文", "后续论文", "指出的问题", "later papers", "other papers", "subsequent papers", "critic", "limitation pointed", "problems pointed")
SOURCE_CUES = ("只根据", "仅根据", "只依据", "仅依据", "原文", "according to", "based only on", "only from", "only using")


@dataclass(frozen=True)
class Plan:
    profile: str = "truth"
    top_k: int = 12
    pool: int = 40
    depth: int = 2
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def channels(self) -> tuple[str, ...]:
        return CHANNELS[self.profile]

    def per_document(self, explicit: int = 0, work_set: int = 0) -> int:
        """How many results a document may give: all of them for truth, else an even share or three."""
        if self.profile == "truth":
            return self.top_k
        parts = explicit or work_set
        return -(-self.top_k // parts) if parts else 3


@dataclass(frozen=True)
class Scope:
    sources: tuple = ()
    excluded: tuple = ()
    subjects: tuple = ()
    work_set: tuple = ()
    rule: str = "unscoped"
    topics: tuple = ()


#: Rules in their order: name, cues, least and most works that it takes, which roles all works get, topics where the text gives none.
RULES = (
    ("compare", COMPARE_CUES, 2, None, ("work_set",), ()),
    ("self", SELF_CUES, 1, 1, ("sources", "subjects"), ("limitations",)),
    ("discussion", DISCUSSION_CUES, 1, None, ("subjects",), ("discussion",)),
    ("external", EXTERNAL_CUES, 1, 1, ("subjects", "excluded"), ("limitations", "problems")),
    ("source", SOURCE_CUES, 1, 1, ("sources",), ()),
)


def topics_of(query: str, titles: list[str]) -> tuple[str, ...]:
    """Labels whose cues occur in the query without the titles, then up to four of its further words."""
    for title in sorted(filter(None, titles), key=len, reverse=True):
        query = re.sub(re.escape(title), " ", query, flags=re.I)
    low = query.casefold()
    labels = [label for label, cues in T.TOPIC_LABELS if any(c in low for c in cues)]
    words = [w for w in re.findall(r"[A-Za-z]{4,}|[\u4e00-\u9fff]{2,}", query) if w.lower() not in T.TITLE_STOP_WORDS]
    return tuple([*labels, *(w for w in words[:4] if w.lower() not in labels)][:6])


def resolve_scope(query: str, mentioned: list[str], explicit: Scope | None = None, planner: Callable[[str], Scope] | None = None, titles: dict[str, str] | None = None) -> Scope:
    """Explicit scope, else the first cue rule that holds, else a planner's, else none.

    ``titles`` of the mentioned works are taken out of the query before topics are read.  With a source cue and several works
    the work with the longest whole title in the query is the source, the others are subjects.
    """
    if explicit is not None:
        return explicit
    low, titles = query.casefold(), titles or {}
    works = tuple(sorted(set(mentioned)))
    topics = topics_of(query, [titles.get(w, "") for w in works])
    for name, cues, least, most, roles, default in RULES:
        if least <= len(works) <= (most or len(works)) and any(c in low for c in cues):
            return Scope(**{role: works for role in roles}, rule=name, topics=(topics_of(query, []) if name == "compare" else topics) or default)
    if len(works) > 1 and any(c in low for c in SOURCE_CUES):
        flat = " ".join(re.findall("[a-z0-9]+", low))
        plain = {w: " ".join(re.findall("[a-z0-9]+", titles.get(w, "").casefold())) for w in works}
        said = [w for w in works if plain[w] and plain[w] in flat]
        if said:
            source = min(said, key=lambda w: (-len(plain[w]), w))
            every = tuple(dict.fromkeys([*topics_of(query, []), *topics]))
            return Scope(sources=(source,), subjects=tuple(w for w in works if w != source), rule="source and subject", topics=every or ("limitations", "problems"))
    return planner(query) if planner else Scope()


def mentioned_works(query: str, phrases: dict[str, str]) -> list[str]:
    """Works whose unique phrases stand in the query, longest phrase first."""
    flat = f" {' '.join(re.findall('[a-z0-9]+', query.casefold()))} "
    return list(dict.fromkeys(work for phrase, work in sorted(phrases.items(), key=lambda kv: (-len(kv[0]), kv[1])) if phrase and f" {phrase} " in flat))


class Engine:
    """Queries over a folder of tables: documents are chunks, their source is the work."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def cache_key(self, query: str, plan: Plan, snapshots: list[str]) -> str:
        return hashlib.sha256("\x1f".join([query, repr(plan), *sorted(snapshots)]).encode()).hexdigest()

    def query(self, queries: DataFrame, profile: str = "truth", scope: Scope | None = None, plan: Plan | None = None, others: dict[str, DataFrame] | None = None) -> DataFrame:
        """queries(query_id, query) -> query_id, rank, evidence_id, doc_id, source, channels, score, text.

        The lexical and confirmed-knowledge channels score every document in scope.  ``others`` holds ranked lists
        (query_id, doc_id, rank) of channels that need more than documents: query vectors, a graph, summaries.
        """
        plan, scope = plan or Plan(profile), scope or Scope()
        docs = self.spark.read.parquet(f"{self.folder}/documents.parquet")
        chunks = R.within_scope(docs, "source", list(scope.sources), list(scope.work_set), list(scope.excluded)) if scope != Scope() else docs
        hits = K.best_documents(docs, chunks, queries, 2 * plan.pool, plan.channels).select("query_id", "doc_id", "channel", "rank")
        for channel, ranked in (others or {}).items():
            if channel in plan.channels:
                own = ranked.join(chunks.select("doc_id"), "doc_id", "left_semi")
                again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
                hits = hits.union(own.select("query_id", "doc_id", F.lit(channel), again.alias("rank")).filter(F.col("rank") <= 2 * plan.pool))
        pool = K.weighted_rrf(hits, "query_id", "doc_id", "channel", "rank", plan.weights).filter(F.col("rank") <= plan.pool)
        rows = pool.join(docs.select("doc_id", "source", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
        cands = rows.select("query_id", "query", F.col("rank").alias("pos"), F.col("doc_id").alias("cand_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("section_id"), F.lit(0.0).alias("score"), "text")
        top = S.diversified(cands, "query_id", plan.top_k, plan.per_document(work_set=len(scope.work_set)), 2, aspects=lambda said: re.findall("[a-z0-9]+", (said or "").casefold()), seed=plan.profile != "truth", said="query")
        chosen = top.select("query_id", F.col("cand_id").alias("doc_id"), F.col("rank").alias("final_rank")).join(rows, ["query_id", "doc_id"])
        return chosen.select("query_id", F.col("final_rank").alias("rank"), F.concat(F.lit("evidence:"), "doc_id").alias("evidence_id"), "doc_id", "source", "channels", F.col("fused").alias("score"), F.left("text", F.lit(3000)).alias("text"))
