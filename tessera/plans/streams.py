"""Streaming jobs, run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import jobs


def _events(v):
    return jobs.files(v.spark, f"{v.dir}/events.parquet")


def _audit(e):
    action = F.when(F.col("event_id") % 50 == 0, " ").otherwise(F.col("event_type"))
    actor = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "None").otherwise(F.col("user_id").cast("string"))
    # a watermark needs a time with a zone; the times are UTC, whatever the session's zone, and go out as they came
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), actor.alias("actor"), F.col("props").alias("details_json"))


@query("c09_audit_stream", "SELECT event_id, action, nullif(nullif(trim(actor), ''), 'None') AS actor FROM v_audit WHERE trim(action) <> ''")
def c09(v):
    to = jobs.shared_folder(v.spark, "audit")
    jobs.audit_stream(_audit(_events(v)), to)
    return jobs.result(v.spark, to).select("event_id", "action", "actor")


@query("c10_replay_counts_once", "SELECT count(*) AS n FROM v_audit WHERE trim(action) <> ''")
def c10(v):
    """A second run from the same checkpoint finds nothing new."""
    to = jobs.shared_folder(v.spark, "audit")
    for _ in range(2):
        jobs.audit_stream(_audit(_events(v)), to)
    return jobs.result(v.spark, to).agg(F.count("*").alias("n"))


@query("c18_conversation_stream", "SELECT user_id AS conversation_id, count(*) AS message_count FROM events GROUP BY 1")
def c18s(v):
    to = jobs.shared_folder(v.spark, "conversations")
    jobs.conversation_stream(_events(v).select(F.col("user_id").alias("conversation_id"), "ts"), to)
    return jobs.newest(v.spark, to, "conversation_id").select("conversation_id", "message_count")


@query("c01_minute_stream", "SELECT user_id % 20 AS key, count(*) AS requests, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM events GROUP BY 1")
def c01s(v):
    to = jobs.shared_folder(v.spark, "minutes")
    jobs.minute_counts(_events(v).select((F.col("user_id") % 20).alias("key"), F.col("ts").cast("timestamp").alias("ts")), to)
    return jobs.newest(v.spark, to, "key", "minute").groupBy("key").agg(F.sum("n").alias("requests"), F.count("*").alias("minutes"))


@query("c07_sliding_window_stream")
def c07s(v):
    to = jobs.shared_folder(v.spark, "limits")
    jobs.sliding_window_stream(_events(v).select((F.col("user_id") % 20).alias("key"), "event_id", "ts"), to, 3_600_000, 1)
    return jobs.result(v.spark, to)


@query("s12_stream_source", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def s12(v):
    to = jobs.shared_folder(v.spark, "source")
    jobs.drain(_events(v).select("event_id"), to, jobs.numbered(to))
    return jobs.result(v.spark, to).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s13_retention", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def s13(v):
    return jobs.retained(v.table("events"), 500, "ts", "event_id").select("event_id")
