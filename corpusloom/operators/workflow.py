"""Feedback, versions, jobs and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of an ingestion job and what may follow each.
FOLLOWING = {
    "pending": ("validating", "parsing", "failed", "cancelled"),
    "validating": ("pending", "parsing", "failed", "cancelled"),
    "parsing": ("normalizing", "failed", "cancelled"),
    "normalizing": ("writing", "failed", "cancelled"),
    "writing": ("indexing", "failed", "cancelled"),
    "indexing": ("postprocessing", "failed", "cancelled"),
    "postprocessing": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": ("pending",),
    "cancelled": (),
}


def allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another; staying is no transition, and a job begins as pending."""
    table = F.array(*[F.lit(f"{a}>{b}") for a, bs in FOLLOWING.items() for b in bs])
    return F.when(before.isNull(), after == "pending").otherwise((before == after) | F.array_contains(table, F.concat(before, F.lit(">"), after)))


def latest_states(events: DataFrame, job: str, ts: str, event: str, state: str) -> DataFrame:
    return events.groupBy(job).agg(F.max_by(state, F.struct(ts, event)).alias(state))


def invalid_transitions(events: DataFrame, job: str, ts: str, event: str, state: str) -> DataFrame:
    w = Window.partitionBy(job).orderBy(ts, event)
    return events.withColumn("before", F.lag(state).over(w)).filter(~allowed(F.col("before"), F.col(state))).select(job, event, "before", F.col(state).alias("after"))


def attempts(events: DataFrame, job: str, ts: str, event: str, state: str) -> DataFrame:
    """How often each job went from failed back to pending."""
    w = Window.partitionBy(job).orderBy(ts, event)
    retry = (F.lag(state).over(w) == "failed") & (F.col(state) == "pending")
    return events.withColumn("retry", F.coalesce(retry, F.lit(False)).cast("long")).groupBy(job).agg(F.sum("retry").alias("attempts"))


def next_pending(jobs: DataFrame, created: str, job: str) -> DataFrame:
    """The oldest pending job."""
    return jobs.filter("state = 'pending'").orderBy(created, job).limit(1)


def improvements(feedback: DataFrame, done: DataFrame, known: DataFrame) -> DataFrame:
    """Unprocessed feedback(feedback_id, target, kind, created) as versioned improvements.

    Accepting, confirming and correcting kinds are confirmed, all others rejected; versions go on from the known ones.
    """
    new = feedback.join(done.select("feedback_id"), "feedback_id", "left_anti")
    base = known.groupBy("target").agg(F.max("version").alias("base"))
    w = Window.partitionBy("target").orderBy("created", "feedback_id")
    return new.join(base, "target", "left").select(
        "feedback_id", "target", F.when(F.col("kind").isin("accept", "confirm", "correct"), "user_confirmed").otherwise("rejected").alias("status"), (F.coalesce("base", F.lit(0)) + F.row_number().over(w)).cast("long").alias("version")
    )


def health(parts: DataFrame, status: str) -> DataFrame:
    return parts.agg(F.when(F.bool_and(F.col(status).isin("healthy", "disabled")), "healthy").otherwise("degraded").alias("status"))
