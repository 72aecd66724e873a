"""Checks of extracted claims, edges and answers, and reports for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.relational import dealt

#: Reasons why a fact is not covered, from the first stage that loses it on.
COVERAGE = ("not extracted", "no subject edge", "filtered", "not ranked")


def is_claim(kind: Column) -> Column:
    """Whether an object's type is a claim, by its name or that of its class."""
    return F.coalesce(kind.rlike("^claim") | (F.lower(F.regexp_replace(kind, "DataPoint$", "")) == "claim"), F.lit(False))


def coverage(facts: DataFrame, stages: list[Column]) -> DataFrame:
    """Facts with ``reason``: null if covered, else the first stage that lost it (one Column for each of ``COVERAGE``)."""
    out = None
    for reason, passed in zip(COVERAGE, stages, strict=True):
        lost = ~F.coalesce(passed, F.lit(False))
        out = F.when(lost, reason) if out is None else out.when(lost, reason)
    return facts.withColumn("reason", out)


def redundancy(claims: DataFrame, baseline: DataFrame, by: str, fact: str) -> DataFrame:
    """For each ``by``: facts that claims support, those that the baseline has too, and their share."""
    c, b = claims.select(by, fact).distinct(), baseline.select(by, fact).distinct().withColumn("_b", F.lit(1))
    return c.join(b, [by, fact], "left").groupBy(by).agg(F.count("*").alias("facts"), F.count("_b").alias("shared"), (F.count("_b") / F.count("*")).alias("share"))


def about_audit(expected: DataFrame, stored: DataFrame, claim: str, target: str, own: str) -> DataFrame:
    """Each claim's expected targets against its stored ones: counts, stored ones of its own document, and a verdict."""
    e, s = (dealt(df.select(claim, target, *more), claim, target).distinct().withColumn(flag, F.lit(1)) for df, more, flag in ((expected, (), "_e"), (stored, (own,), "_s")))
    both = e.join(s, [claim, target], "full")
    sums = both.groupBy(claim).agg(F.count("_e").alias("expected"), F.count("_s").alias("stored"), F.count(F.when(F.col("_e").isNotNull() & F.col("_s").isNotNull(), 1)).alias("matched"), F.count(F.when(F.col(own), 1)).alias("self_targets"))
    verdict = F.when(F.col("matched") == 0, "MISSING").when((F.col("matched") == F.col("expected")) & (F.col("stored") == F.col("expected")), "MATCH").otherwise("PARTIAL")
    return sums.withColumn("verdict", verdict)


def answer_quality(evidence: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """Shares of evidence rows that pass each check, for each ``by``."""
    return evidence.groupBy(by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in checks.items()])


def unique_cases(cases: list[DataFrame], case: str) -> DataFrame:
    """All cases of several files with ``duplicate``: the id occurs more than once."""
    every = cases[0]
    for more in cases[1:]:
        every = every.unionByName(more)
    counts = every.groupBy(case).agg((F.count("*") > 1).alias("duplicate"))
    return every.join(counts, case)


def review_rows(edges: DataFrame, fixtures: DataFrame, keys: list[str]) -> DataFrame:
    """Edges labelled FIXTURE_COVERED or UNREVIEWED."""
    seen = fixtures.select(*keys).distinct().withColumn("_f", F.lit(True))
    return edges.join(seen, keys, "left").withColumn("review", F.when(F.col("_f"), "FIXTURE_COVERED").otherwise("UNREVIEWED")).drop("_f")


def lost_edges(expected: DataFrame, layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Expected edges that the last layer lacks, with the first layer that lost them."""
    out, reason = expected.select(*keys).distinct(), None
    for name, df in layers.items():
        out = out.join(df.select(*keys).distinct().withColumn(f"_{name}", F.lit(True)), keys, "left")
        gone = F.col(f"_{name}").isNull()
        reason = F.when(gone, name) if reason is None else reason.when(gone, name)
    return out.withColumn("lost_in", reason).filter("lost_in IS NOT NULL").select(*keys, "lost_in")


def stored_contract(edges: DataFrame, works: DataFrame, backbone: list[str]) -> DataFrame:
    """Per edge type: edges, distinct ones, those to works without documents that still claim provenance; and whether it is backbone."""
    outside = works.filter("NOT has_document").select(F.col("work").alias("dst"), F.lit(True).alias("_out"))
    return edges.join(outside, "dst", "left").groupBy("type").agg(
        F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("distinct_edges"), F.count(F.when(F.col("_out") & (F.size("chunks") > 0), 1)).alias("fake_provenance")
    ).withColumn("backbone", F.col("type").isin(backbone))


def distinct_failures(*records: DataFrame) -> DataFrame:
    """Failure records of several stages, each once."""
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates()


def corpus_edges(references: DataFrame, works: DataFrame, source: str, key: str, work: str, document: str) -> DataFrame:
    """Citation edges between documents of the corpus: references whose work is itself a document's."""
    own = works.select(key, F.col(work).alias("target_work"), F.col(document).alias("target")).filter("target IS NOT NULL")
    return references.join(own, key).filter(F.col(source) != F.col("target")).select(source, "target").distinct()


def expectations(subject: DataFrame, subject_id: str, rules: dict[str, Column]) -> DataFrame:
    """(subject, rule) of each expectation that does not hold; what is unknown doesn't hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return subject.select(subject_id, F.explode(failed).alias("rule"))
