"""Jobs, feedback and streams on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import workflow as W
from corpusloom.streaming import jobs as streams

from . import query

STATES = ("pending", "parsing", "normalizing", "failed", "completed")
EVENTS = "SELECT event_id, user_id, ts, ['pending', 'parsing', 'normalizing', 'failed', 'completed'][(event_id % 5) + 1] AS state FROM events"
ALLOWED = "[" + ", ".join(f"'{a}>{b}'" for a, bs in W.FOLLOWING.items() for b in bs) + "]"


def job_events(t):
    return t.events.select("event_id", "user_id", "ts", F.get(F.array(*map(F.lit, STATES)), (F.col("event_id") % 5).cast("int")).alias("state"))


@query(f"SELECT user_id, arg_max(state, {{'t': ts, 'e': event_id}}) AS state FROM ({EVENTS}) GROUP BY 1")
def job_state_latest(t):
    return W.latest_states(job_events(t), "user_id", "ts", "event_id", "state")


@query(f"""SELECT user_id, event_id, before, state AS after FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ({EVENTS})) WHERE NOT (CASE WHEN before IS NULL THEN state = 'pending' ELSE before = state OR list_contains({ALLOWED}, before || '>' || state) END)""")
def job_invalid_transitions(t):
    return W.invalid_transitions(job_events(t), "user_id", "ts", "event_id", "state")


@query(f"""SELECT user_id, sum((before = 'failed' AND state = 'pending')::INT)::BIGINT AS attempts FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM ({EVENTS})) GROUP BY 1""")
def job_attempts(t):
    return W.attempts(job_events(t), "user_id", "ts", "event_id", "state")


@query(f"""SELECT user_id, ts FROM (SELECT user_id, max(ts) AS ts, arg_max(state, {{'t': ts, 'e': event_id}}) AS state FROM ({EVENTS}) GROUP BY 1) WHERE state = 'pending' ORDER BY ts, user_id LIMIT 1""")
def job_claim(t):
    e = job_events(t)
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return W.next_pending(jobs, "ts", "user_id").select("user_id", "ts")


FEEDBACK = "SELECT conv_id * 1000 + turn AS feedback_id, conv_id % 50 AS target, CASE role WHEN 'user' THEN 'confirm' WHEN 'assistant' THEN 'reject' ELSE 'correct' END AS kind, turn AS created FROM conversations"


@query(f"""WITH f AS ({FEEDBACK}), k AS (SELECT target, count(*) AS base FROM f WHERE feedback_id % 3 = 0 GROUP BY 1)
SELECT feedback_id, f.target, CASE WHEN kind IN ('accept', 'confirm', 'correct') THEN 'user_confirmed' ELSE 'rejected' END AS status, (coalesce(base, 0) + row_number() OVER (PARTITION BY f.target ORDER BY created, feedback_id))::BIGINT AS version FROM f LEFT JOIN k ON k.target = f.target WHERE feedback_id % 3 <> 0""")
def improvement_versions(t):
    kind = F.when(F.col("role") == "user", "confirm").when(F.col("role") == "assistant", "reject").otherwise("correct")
    f = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("feedback_id"), (F.col("conv_id") % 50).alias("target"), kind.alias("kind"), F.col("turn").alias("created"))
    done = f.filter("feedback_id % 3 = 0")
    known = done.groupBy("target").agg(F.count("*").alias("version"))
    return W.improvements(f, done, known)


@query("SELECT CASE WHEN bool_and(event_type IN ('healthy', 'disabled')) THEN 'healthy' ELSE 'degraded' END AS status FROM events")
def health_rollup(t):
    return W.health(t.events, "event_type")


@query("""SELECT doc_id, 'empty' AS rule FROM documents WHERE trim(text) = '' UNION ALL SELECT doc_id, 'too_long' FROM documents WHERE n_chars > 20000 UNION ALL SELECT doc_id, 'wrong_size' FROM documents WHERE n_chars <> length(text)""")
def chunk_invariants(t):
    rule = lambda name, c: t.documents.filter(c).select("doc_id", F.lit(name).alias("rule"))
    return rule("empty", F.trim("text") == "").union(rule("too_long", F.col("n_chars") > 20000)).union(rule("wrong_size", F.col("n_chars") != F.length("text")))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_daily_counts(t):
    """A stream of the events, read as micro-batches, in tumbling windows of a day."""
    return streams.run_to_table(streams.daily_counts(streams.source(t.spark, t.folder)), "daily").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def stream_job_states(t):
    """A stateful stream that keeps each job's state and reports transitions that aren't allowed."""
    return streams.run_to_table(streams.job_states(streams.source(t.spark, t.folder)), "job_states")
