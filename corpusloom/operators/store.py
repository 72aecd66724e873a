"""Versioned documents: snapshots, bundles, tombstones, rebuilds, manifests and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshots_in_order(snapshots: DataFrame, snapshot: str, created: str) -> DataFrame:
    """Every snapshot from the oldest on, with its place; numbered by range partitions' sizes, not in one task."""
    return snapshots.select(snapshot, created).orderBy(created, snapshot)


def bundle(tables: dict[str, DataFrame], key: str, snapshot) -> dict[str, DataFrame]:
    """The rows of one snapshot in each table; on partitioned tables only its partition is read."""
    return {name: df.filter(F.col(key) == F.lit(snapshot)) for name, df in tables.items()}


def chunk_projection(snapshots: DataFrame, chunks: DataFrame | None, key: str, columns: list[str]) -> DataFrame:
    """Derived chunks of the given snapshots; none, under the same schema, where no chunks were ever saved."""
    if chunks is None:
        return snapshots.select(key).limit(0).select(key, *[F.lit(None).cast("string").alias(c) for c in columns])
    return chunks.join(snapshots.select(key).distinct(), key, "left_semi").select(key, *columns)


def listing(snapshots: DataFrame, chunks: DataFrame, tombstones: DataFrame, document: str, snapshot: str, created: str, title: str) -> DataFrame:
    """The newest snapshot of each document with its number of chunks and whether the document is deleted."""
    newest = snapshots.groupBy(document).agg(F.max_by(F.struct(snapshot, title), F.struct(created, snapshot)).alias("n")).select(document, "n.*")
    counts = chunks.groupBy(snapshot).agg(F.count("*").alias("chunks"))
    gone = tombstones.select(document).distinct().withColumn("deleted", F.lit(True))
    return newest.join(counts, snapshot, "left").join(gone, document, "left").fillna({"chunks": 0, "deleted": False})


def inspect(snapshots: DataFrame, chunks: DataFrame, document: str, snapshot: str) -> DataFrame:
    """Each document with all its snapshot ids, in order, and its chunks over all of them."""
    counts = chunks.groupBy(snapshot).agg(F.count("*").alias("c"))
    return snapshots.join(counts, snapshot, "left").groupBy(document).agg(F.sort_array(F.collect_set(snapshot)).alias("snapshots"), F.sum(F.coalesce("c", F.lit(0))).alias("chunks"))


def deleted(tombstones: DataFrame, document: str) -> DataFrame:
    return tombstones.select(document).distinct()


def delete(tombstones: DataFrame, documents: DataFrame, index: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tombstones with the documents, the index without their rows, index rows that go by document); evidence stays."""
    new = documents.select(document).distinct()
    rows = index.join(new, document, "left_semi").groupBy(document).agg(F.count("*").alias("removed"))
    report = new.join(rows, document, "left").fillna({"removed": 0})
    return tombstones.select(document).union(new).distinct(), index.join(new, document, "left_anti"), report


def restore(tombstones: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """Tombstones without the documents that are processed again."""
    return tombstones.select(document).distinct().join(documents.select(document).distinct(), document, "left_anti")


def rebuild(snapshots: DataFrame, tombstones: DataFrame, enriched: DataFrame, document: str, snapshot: str, created: str, history: bool = False, refresh: bool = False) -> DataFrame:
    """Snapshots that a rebuild replays: the newest of each document, or all, without deleted documents.

    ``ready`` tells whether a snapshot may be replayed: it is enriched, or enrichment is done anew (``refresh``).
    """
    chosen = snapshots
    if not history:
        newest = snapshots.groupBy(document).agg(F.max_by(snapshot, F.struct(created, snapshot)).alias(snapshot)).select(snapshot)
        chosen = snapshots.join(newest, snapshot, "left_semi")
    live = chosen.join(deleted(tombstones, document), document, "left_anti")
    done = enriched.select(snapshot).distinct().withColumn("ready", F.lit(True))
    return live.join(done, snapshot, "left").withColumn("ready", F.coalesce("ready", F.lit(refresh)))


def manifest(nodes: DataFrame, edges: DataFrame, group: str, node: str, kind: str) -> DataFrame:
    """For each group its counts of nodes and edges and of nodes by type, as one JSON text."""
    by_kind = nodes.groupBy(group, kind).agg(F.count("*").alias("n"))
    types = by_kind.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("types"), F.sum("n").alias("nodes"))
    lines = edges.groupBy(group).agg(F.count("*").alias("edges"))
    return types.join(lines, group, "left").select(group, F.to_json(F.struct("nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "types")).alias("manifest"))


def manifest_index(manifests: DataFrame, at: str, uuid: str, canonical: str) -> DataFrame:
    """uuid -> canonical id over all manifests; where manifests disagree the last one written counts."""
    return manifests.groupBy(uuid).agg(F.max_by(canonical, F.struct(at, canonical)).alias(canonical))


def graph_of(nodes: DataFrame, edges: DataFrame, data_set: str, node: str, written: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, of each id the one written last, and the edges of the same data set between such nodes."""
    own = nodes.groupBy(data_set, node).agg(F.max_by(F.struct([c for c in nodes.columns if c not in (data_set, node)]), written).alias("x")).select(data_set, node, "x.*")
    ids = own.select(data_set, node)
    src, dst = ids.withColumnRenamed(node, "src"), ids.withColumnRenamed(node, "dst")
    return own, edges.join(src, [data_set, "src"], "left_semi").join(dst, [data_set, "dst"], "left_semi")


def provenance_counts(nodes: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """Nodes and edges of each data set and data item; one that has only either is listed too."""
    n, e = nodes.groupBy(*by).agg(F.count("*").alias("nodes")), edges.groupBy(*by).agg(F.count("*").alias("edges"))
    return n.join(e, list(by), "full").fillna(0, ["nodes", "edges"])


def unindexed(expected: DataFrame, stored: DataFrame, node: str, field: str) -> DataFrame:
    """(node, field) of expected vectors that aren't stored."""
    return expected.select(node, field).distinct().join(stored.select(node, field).distinct(), [node, field], "left_anti")


def changed_nodes(expected: DataFrame, stored: DataFrame, node: str, canonical: str) -> DataFrame:
    """Nodes that read back with another canonical id, or not at all."""
    back = stored.select(node, F.col(canonical).alias("_back"))
    return expected.select(node, canonical).join(back, node, "left").filter(~F.col(canonical).eqNullSafe(F.col("_back"))).drop("_back")


def lexical_ids(index: DataFrame, document: str, object_id: str) -> DataFrame:
    """The index ids of each document, in order."""
    return index.groupBy(document).agg(F.sort_array(F.collect_set(object_id)).alias("object_ids"))


def find_one(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for wanted keys; one that is missing is told by ``found`` = false, not left out."""
    return wanted.select(key).distinct().join(df.withColumn("found", F.lit(True)), key, "left").fillna({"found": False})


def missing_tables(present: list[str], required: list[str]) -> list[str]:
    """Required tables that are not there."""
    return sorted(set(required) - set(present))


def latest_correction(corrections: DataFrame, target: str, version: str, created: str, value: str) -> DataFrame:
    """Of each target the correction of the highest version, of equal versions the newest."""
    return corrections.groupBy(target).agg(F.max_by(value, F.struct(version, created, value)).alias(value))


def next_versions(new: DataFrame, known: DataFrame, target: str, order: str) -> DataFrame:
    """New rows with the versions that follow the highest known one of their target."""
    base = known.groupBy(target).agg(F.max("version").alias("_base"))
    at = F.row_number().over(Window.partitionBy(target).orderBy(order))
    return new.join(base, target, "left").withColumn("version", F.coalesce("_base", F.lit(0)) + at).drop("_base")


def check_feedback(feedback: DataFrame, chunks: DataFrame, feedback_id: str, evidence: str, verdict: str, text: str, chunk: str) -> DataFrame:
    """Feedback that is not sound, with the reason: evidence that leads to no retained chunk, or a correction without text."""
    cited = feedback.select(feedback_id, F.explode(evidence).alias("_e")).withColumn(chunk, F.regexp_replace("_e", "^evidence:", ""))
    lost = cited.join(chunks.select(F.col(chunk).cast("string").alias(chunk)).distinct(), chunk, "left_anti").select(feedback_id).distinct().withColumn("reason", F.lit("unknown evidence"))
    blank = feedback.filter((F.col(verdict) == "correct") & (F.trim(F.coalesce(text, F.lit(""))) == "")).select(feedback_id, F.lit("correction without text").alias("reason"))
    return lost.unionByName(blank)


def public_jobs(jobs: DataFrame, root: str, message: str, hidden: list[str]) -> DataFrame:
    """Jobs as callers may see them: without hidden columns, the data folder's path replaced in messages."""
    return jobs.drop(*hidden).withColumn(message, F.replace(F.col(message), F.lit(root), F.lit("<data>")))
