"""Property graph as node and edge tables: typed edges, traversal, redirects, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.sources.tables import checkpointed

DECAY = 0.85
SEARCHABLE = ("RELATED_TO", "USES", "EXTENDS", "COMPARES_WITH", "EVALUATES", "CONTRADICTS", "SUPPORTS", "PART_OF", "IS_A")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).filter("a <> b").distinct()


def hops(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = DECAY) -> DataFrame:
    """(node, score): the best seed score times decay for each hop, over all edges in both directions.

    A frontier join and a maximum for each hop; depth is small, so the plan is unrolled.
    """
    near, scores = both_ways(edges), seeds.select("node", "score")
    frontier = scores
    for _ in range(depth):
        reached = frontier.join(near, frontier.node == near.a).groupBy("b").agg(F.max(F.col("score") * decay).alias("score")).select(F.col("b").alias("node"), "score")
        scores = scores.union(reached).groupBy("node").agg(F.max("score").alias("score"))
        frontier = reached
    return scores.withColumn("score", F.round("score", 9))


def incoming(edges: DataFrame, nodes: DataFrame, kind: str, targets: DataFrame, limit: int) -> DataFrame:
    """Edges of a type into the targets with the union of edge and source-node chunks; edges without chunks go."""
    hit = edges.filter(F.col("type") == kind).join(targets, edges.dst == targets.target, "left_semi")
    own = hit.join(nodes.select(F.col("node").alias("src"), F.col("chunks").alias("own")), "src", "left")
    every = own.withColumn("chunks", F.array_union(F.coalesce("chunks", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>")))).drop("own")
    return every.filter(F.size("chunks") > 0).orderBy("dst", "src", F.array_join("chunks", ",")).limit(limit)


def chase(redirects: DataFrame) -> DataFrame:
    """(loser, survivor) at the end of each chain, by doubling; what a cycle holds keeps no survivor.

    No chain is longer than there are redirects, so what is open after that many steps is a cycle.
    """
    out, open_ = redirects.select("loser", "survivor"), redirects.select(F.col("loser").alias("survivor")).distinct()
    out = checkpointed(out)
    for _ in range(out.count().bit_length() + 1):
        out = checkpointed(out)
        if out.join(open_, "survivor", "left_semi").isEmpty():
            return out
        step = out.select(F.col("loser").alias("survivor"), F.col("survivor").alias("beyond"))
        out = out.join(step, "survivor", "left").select("loser", F.coalesce("beyond", "survivor").alias("survivor"))
    looped = out.join(open_, "survivor", "left_semi").select("loser").distinct().withColumn("cycle", F.lit(True))
    return out.join(looped, "loser", "left").select("loser", F.when(F.col("cycle").isNull(), F.col("survivor")).alias("survivor"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, by minima over neighbours and over the component's own label.

    Rounds go on until no label changes; labels are written out by checkpoint() each round.
    """
    near = both_ways(edges)
    near = checkpointed(near)
    labels = near.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        least = near.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(least.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("via"))
        further = step.select(F.col("node").alias("via"), F.col("via").alias("further"))
        new = step.join(further, "via").select("node", "was", F.least("via", "further").alias("component"))
        new = checkpointed(new)
        labels = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            break
    return labels


def consolidate(edges: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst) with the chunks of all, in order of first sight."""
    # Positions are explicit, as a shuffle keeps no order.
    one = edges.select("src", "type", "dst", "pos", F.posexplode_outer("chunks").alias("i", "chunk")).groupBy("src", "type", "dst", "chunk").agg(F.min(F.struct("pos", "i")).alias("at"))
    lists = one.groupBy("src", "type", "dst").agg(F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("at", "chunk")))).alias("c"))
    return lists.select("src", "type", "dst", F.transform("c", lambda x: x["chunk"]).alias("chunks"))


def triplets(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = SEARCHABLE) -> DataFrame:
    """A searchable node for each edge of the listed types: id and text "source relation target"."""
    s = nodes.select(F.col("node").alias("src"), F.col("name").alias("src_name"))
    t = nodes.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    kept = edges.filter(F.col("type").isin(*kinds)).join(s, "src").join(t, "dst")
    return kept.select(ids.set_id("triplet", F.col("chunks"), F.col("src"), F.col("type"), F.col("dst")).alias("node"), F.concat_ws(" ", "src_name", F.lower(F.replace("type", F.lit("_"), F.lit(" "))), "dst_name").alias("text"), "src", "dst")


def survivors(works: DataFrame, same: DataFrame) -> DataFrame:
    """(work_id, survivor) of works that edges same(src, dst) join: by status, then age, then id."""
    member = components(same).withColumnRenamed("node", "work_id").join(works, "work_id")
    rank = F.struct(F.when(F.col("status") == "ingested", 0).when(F.col("status") == "identified", 1).otherwise(2).alias("s"), "created_at", "work_id")
    best = member.groupBy("component").agg(F.min_by("work_id", rank).alias("survivor"))
    return member.join(best, "component").select("work_id", "survivor")
