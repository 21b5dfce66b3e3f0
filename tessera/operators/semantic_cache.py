"""A semantic cache over time: lookups by the nearest live entry of a tenant, where a hit renews the entry.

Events are puts (an entry's vector) and gets (a query's). A put and a hit make an entry live for `ttl_ms`; a get takes the nearest live entry, if its cosine distance is within
the threshold. Which entry is the nearest depends on which are live, and that on earlier hits, so the events of a tenant are folded in order. The fold's state
is the live entries alone. After a pause of a tenant longer than the time to live nothing is live, so its history is cut there into parts that don't depend on
each other: buckets of one time to live without an event end a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Live:
    """Live entries of one tenant. Equal distances go to the smaller entry id."""

    def __init__(self, ttl_ms: int, threshold: float):
        self.ttl, self.threshold = ttl_ms, threshold
        self.entries: dict[int, tuple[np.ndarray, int]] = {}  # id: vector of length 1 (or 0), end

    def step(self, ms: int, op: str, entry: int | None, vector) -> int | None:
        """The entry that a get hits."""
        self.entries = {k: x for k, x in self.entries.items() if x[1] > ms}
        v = np.asarray(vector, float)
        size = np.linalg.norm(v)
        v = v / size if size else v
        if op == "put":
            self.entries[int(entry)] = (v, ms + self.ttl)
            return None
        best = min(((round(1 - float(x @ v), 6) if len(x) == len(v) else 1.0, k) for k, (x, _) in self.entries.items()), default=None)
        if best is None or best[0] > self.threshold:
            return None
        self.entries[best[1]] = (self.entries[best[1]][0], ms + self.ttl)
        return best[1]


def parts(events: DataFrame, ttl_ms: int) -> DataFrame:
    """Events with `part`: of a tenant, parts are independent of each other."""
    e = events.withColumn("bucket", F.floor(F.col("ms") / ttl_ms))
    used = e.select("tenant", "bucket").distinct()
    used = used.select(F.col("tenant").alias("t"), F.col("bucket").alias("b"), (F.col("bucket") - F.row_number().over(W.partitionBy("tenant").orderBy("bucket"))).alias("part"))
    return e.join(used, F.col("tenant").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("b"))).drop("t", "b", "bucket")


def lookups(events: DataFrame, ttl_ms: int, threshold: float) -> DataFrame:
    """(tenant, event_id, hit) of each get in events (tenant long, ms, event_id, op: put or get, entry, vector), in order of ms and event_id; hit is null for a miss."""
    e = parts(events.select(F.col("tenant").cast("long").alias("tenant"), F.col("ms").cast("long").alias("ms"), F.col("event_id").cast("long").alias("event_id"), "op", F.col("entry").cast("long").alias("entry"), F.col("vector").cast("array<double>").alias("vector")), ttl_ms)
    ordered = e.repartition("tenant", "part").sortWithinPartitions("tenant", "part", "ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, live = None, None
        for b in batches:
            out = []
            for tenant, ms, event, op, entry, vector, part in b[["tenant", "ms", "event_id", "op", "entry", "vector", "part"]].itertuples(index=False):
                owner = (None if pd.isna(tenant) else int(tenant), part)
                if live is None or owner != now:
                    now, live = owner, Live(ttl_ms, threshold)
                hit = live.step(int(ms), op, entry, vector)
                if op == "get":
                    out.append((owner[0], event, hit))
            yield pd.DataFrame(out, columns=["tenant", "event_id", "hit"]).astype({"tenant": "Int64", "event_id": "int64", "hit": "Int64"})

    return ordered.mapInPandas(run, "tenant long, event_id long, hit long")


def stream_lookups(stream: DataFrame, ttl_ms: int, threshold: float) -> DataFrame:
    """The same of a stream (tenant, ts: a time with a watermark, ms, event_id, op, entry, vector) whose batches come in order. A tenant's state is its live entries; a timer on the last one's end removes it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = Live(ttl_ms, threshold)
        if state.exists:
            live.entries = {k: (np.asarray(x, float), end) for k, x, end in zip(*state.get, strict=True)}
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        out = []
        for ms, event, op, entry, vector in rows[["ms", "event_id", "op", "entry", "vector"]].itertuples(index=False):
            hit = live.step(int(ms), op, entry, vector)
            if op == "get":
                out.append((key[0], event, hit))
        state.update(([*live.entries], [x.tolist() for x, _ in live.entries.values()], [end for _, end in live.entries.values()]))
        ends = [end for _, end in live.entries.values()]
        state.setTimeoutTimestamp(max([*ends, state.getCurrentWatermarkMs() + 1]))
        yield pd.DataFrame(out, columns=["tenant", "event_id", "hit"]).astype({"event_id": "int64", "hit": "Int64"})

    return stream.groupBy("tenant").applyInPandasWithState(run, "tenant long, event_id long, hit long", "ids array<long>, vectors array<array<double>>, ends array<long>", "append", "EventTimeTimeout")
