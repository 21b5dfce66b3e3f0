"""Structured Streaming: the audit stream, usage and conversation sinks, limits with state.

Each job takes a stream and leaves tables under a folder; runs go on from their checkpoint, so a batch that was not finished is
read again. Sinks write a batch under its number, so that a batch that is written twice counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names for checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a table, which may be one file: a pattern finds it either way."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs over all that is there now."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def numbered(folder: str) -> Callable[[DataFrame, int], None]:
    return lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/data/batch={n}")


def newest(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    """The last state of each key, of batches that hold what changed."""
    rows = spark.read.parquet(f"{folder}/data")
    own = [c for c in rows.columns if c not in key and c != "batch"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*own), "batch").alias("row")).select(*key, "row.*")


def result(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data").drop("batch")


def audit_rows(events: DataFrame) -> DataFrame:
    """Rows of the audit log: blank actions are dropped, blank and `None` actors are null, details default to an empty object."""
    actor = F.nullif(F.nullif(F.trim("actor"), F.lit("")), F.lit("None"))
    return events.where(F.trim("action") != "").select("event_id", "ts", "action", actor.alias("actor"), F.coalesce("details_json", F.lit("{}")).alias("details_json"))


def audit_stream(stream: DataFrame, folder: str, late: str = "30 days") -> None:
    """Audit rows, each event once within the watermark."""
    drain(audit_rows(stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])), folder, numbered(folder))


def conversation_stream(stream: DataFrame, folder: str, days: int = 90) -> None:
    """A row for each conversation that a batch changes: first and last message, count, expiry. `newest` by conversation_id is the table; no batch replaces another's files."""
    g = stream.groupBy("conversation_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_message_at"), F.count("*").alias("message_count"))
    g = g.withColumn("expires_at", F.col("last_message_at") + F.make_dt_interval(days=F.lit(days)))
    drain(g, folder, numbered(folder), "update")


def minute_counts(stream: DataFrame, folder: str, late: str = "30 days") -> None:
    """Requests of each key and minute, as batches change them; `newest` by key and minute is the table. Minutes before the watermark leave the state."""
    g = stream.withWatermark("ts", late).groupBy("key", F.window("ts", "1 minute").alias("w")).count().select("key", F.col("w.start").alias("minute"), F.col("count").alias("n"))
    drain(g, folder, numbered(folder), "update")


def sliding_window_stream(stream: DataFrame, folder: str, window_ms: int, limit: int) -> None:
    """The sliding-window limiter with its log of admitted times, of `limit` entries at most, as state."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        out = []
        for t in rows["ms"].tolist():
            log = [x for x in log if x > t - window_ms]
            go = len(log) < limit
            if go and not (log and log[-1] == t):
                log.append(t)
            out.append(go)
        state.update((log,))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "ms": rows["ms"], "allowed": out})

    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts)")
    e = stream.select("key", "event_id", ms.alias("ms"))
    done = e.groupBy("key").applyInPandasWithState(admit, "key long, event_id long, ms long, allowed boolean", "log array<long>", "append", "NoTimeout")
    drain(done, folder, numbered(folder))


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose content differs from the snapshot before, or that are new."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    return now.join(digest(now).join(digest(before), [key, "h"], "left_anti").select(key), key, "left_semi")


def retained(events: DataFrame, most: int, *order: str) -> DataFrame:
    """The newest `most` events of a log."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(most)

