"""Rate limits, quotas, budgets and caches over event logs.

What an event's own order decides is a window. What depends on which earlier events were admitted is a fold over
one key's events, with only what is still inside its window as state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import times


def fixed_window(events: DataFrame, key: list[str], bucket: Column, limit: int, *order: str) -> DataFrame:
    """Adds n (the event's number within its key and bucket; refused events count) and allowed. A limit of 0 is none."""
    n = F.row_number().over(W.partitionBy(*key, bucket).orderBy(*order)).cast("long")
    return events.withColumn("n", n).withColumn("allowed", (F.lit(limit) == 0) | (F.col("n") <= limit))


def minute_limits(events: DataFrame, user_limit: int, tenant_limit: int) -> DataFrame:
    """Counters by minute of the user (where there is one) and of the tenant; the first that is exceeded is the reason."""
    minute = times.minute_key(F.col("ts"))
    e = fixed_window(events, ["key", "user_id"], minute, user_limit, "ts", "event_id").withColumnsRenamed({"n": "user_n", "allowed": "user_ok"})
    e = fixed_window(e, ["key"], minute, tenant_limit, "ts", "event_id").withColumnsRenamed({"n": "tenant_n", "allowed": "tenant_ok"})
    user_ok = F.col("user_id").isNull() | F.col("user_ok")
    return e.withColumn("reason", F.when(~user_ok, "user_rate").when(~F.col("tenant_ok"), "tenant_rate")).withColumn("allowed", F.col("reason").isNull())


def running_budget(events: DataFrame, budget: int) -> DataFrame:
    """Monthly running cost by key, its percentage of the budget and its state; before is the sum that a gate sees."""
    from tessera.functions import money

    w = W.partitionBy("key", times.month_key(F.col("ts"))).orderBy("ts", "event_id")
    upto = F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))
    e = events.withColumn("spent", upto).withColumn("before", F.col("spent") - F.col("cost"))
    pct = money.budget_percent(F.col("spent"), F.lit(budget))
    return e.withColumn("pct", pct).withColumn("state", money.budget_state(pct)).withColumn("blocked", money.budget_percent(F.col("before"), F.lit(budget)) >= 100)


def admit(times_ms: list[int], window_ms: int, limit: int) -> list[bool]:
    """Sliding-window log: an event is admitted if fewer than `limit` admitted ones lie in the window before it. Admitted events of one millisecond are one entry."""
    log: deque[int] = deque()
    out = []
    for t in times_ms:
        while log and log[0] <= t - window_ms:
            log.popleft()
        go = len(log) < limit
        if go and not (log and log[-1] == t):
            log.append(t)
        out.append(go)
    return out


def sliding_window(events: DataFrame, key: str, window_ms: int, limit: int) -> DataFrame:
    """(key, event_id, ms, allowed): what `admit` says of each key's events (event_id, ts), in order of time and id.

    A key's history is cut into buckets of one window. An event with no more than `limit` in the window that it ends is admitted whatever came
    before; a bucket of such events is settled by a count. What is left are islands of buckets with more. An island's events, after those of
    the settled bucket before it, are streamed through a log of `limit` entries at most: nothing earlier is inside its first event's window. So a key
    is spread over its buckets, and only a stretch that is over the limit without a pause is one task's.
    """
    e = events.select(F.col(key).cast("long").alias("own"), "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("ms"))
    e = e.withColumn("bucket", F.floor(F.col("ms") / window_ms))
    # every event counts in its own bucket and in the next, so each bucket sees all that its windows reach
    seen = e.select("own", "ms", "bucket", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("part"))
    n = F.count("*").over(W.partitionBy("own", "part").orderBy("ms").rangeBetween(1 - window_ms, 0))
    over = seen.withColumn("n", n).where((F.col("bucket") == F.col("part")) & (F.col("n") > limit)).select("own", "bucket").distinct()
    islands = over.withColumn("island", F.col("bucket") - F.row_number().over(W.partitionBy("own").orderBy("bucket")))
    before = islands.groupBy("own", "island").agg((F.min("bucket") - 1).alias("bucket")).select("own", "bucket", "island", F.lit(True).alias("settled"))
    marks = islands.withColumn("settled", F.lit(False)).unionByName(before)
    named = lambda df: df.withColumnsRenamed({"own": "o", "bucket": "b"})
    same = F.col("own").eqNullSafe(F.col("o")) & (F.col("bucket") == F.col("b"))
    marked = e.join(named(marks), same).select("own", "island", "event_id", "ms", "settled")
    replayed = marked.repartition("own", "island").sortWithinPartitions("own", "island", "ms", "event_id").mapInPandas(_replay(window_ms, limit), "own long, event_id long, ms long, allowed boolean")
    calm = e.join(named(islands.select("own", "bucket")), same, "left_anti")
    return calm.select("own", "event_id", "ms", F.lit(True).alias("allowed")).unionByName(replayed).withColumnRenamed("own", key)


def _replay(window_ms: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log: deque[int] = deque()
        now = None
        for batch in batches:
            out = []
            owners = [None if pd.isna(k) else int(k) for k in batch["own"]]
            for k, island, t in zip(owners, batch["island"].tolist(), batch["ms"].tolist(), strict=True):
                if (k, island) != now:
                    now, log = (k, island), deque()
                while log and log[0] <= t - window_ms:
                    log.popleft()
                go = len(log) < limit
                if go and not (log and log[-1] == t):
                    log.append(t)
                out.append(go)
            done = batch.assign(allowed=out)
            yield done.loc[~done["settled"], ["own", "event_id", "ms", "allowed"]]

    return run


def floored_counter(events: DataFrame, key: str) -> DataFrame:
    """(key, n) of signed steps (delta, in order ts, event_id) whose sum never falls below zero.

    The end is the largest sum of the last steps, or of none: the total less the least running sum (0 included).
    """
    run = F.sum("delta").over(W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("run", run).groupBy(key).agg((F.sum("delta") - F.least(F.lit(0), F.min("run"))).cast("long").alias("n"))


def ttl_lookups(events: DataFrame, ttl_ms: int) -> DataFrame:
    """From events (key, ms, event_id, op: get or put): hit of each get of a sliding TTL cache, in which a put or a hit renews the entry.

    A get hits if each gap since the last put, over gets in between, is within the TTL: so if its own gap is, and the
    event before it was a put or a hit. Runs of events without a longer gap, from a put on, are live.
    """
    w = W.partitionBy("key").orderBy("ms", "event_id")
    gap = F.coalesce(F.col("ms") - F.lag("ms").over(w) > ttl_ms, F.lit(True))
    e = events.withColumn("run", F.sum(gap.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy("key", "run").orderBy("ms", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("hit", F.coalesce(F.max((F.col("op") == "put").cast("int")).over(before), F.lit(0)) == 1).where("op = 'get'").drop("run")


def tiered(requests: DataFrame, *tiers: tuple[str, DataFrame, str]) -> DataFrame:
    """First hit of several caches (name, entries (key, answer), key column of requests), with the tier's name."""
    r, answers, names = requests, [], []
    for i, (name, entries, key) in enumerate(tiers):
        a = f"answer_{i}"
        r = r.join(entries.select(F.col("key").alias(f"key_{i}"), F.col("answer").alias(a)), F.col(key) == F.col(f"key_{i}"), "left").drop(f"key_{i}")
        answers.append(F.col(a))
        names.append(F.when(F.col(a).isNotNull(), name))
    return r.withColumn("answer", F.coalesce(*answers)).withColumn("tier", F.coalesce(*names, F.lit("miss"))).drop(*[f"answer_{i}" for i in range(len(tiers))])


def first_failing(gates: list[tuple[str, Column]], otherwise: str = "retrieve") -> Column:
    """Name of the first gate whose condition holds."""
    return F.coalesce(*[F.when(c, name) for name, c in gates], F.lit(otherwise))
