"""Throttled progress: which updates of a task's log go out, cut into any number of pieces.

An update goes out if it is a task's first, has another stage than the last that went out, is `step` points or more above that, or is at an end (100 and more, 0
and less). An update that stays back has the stage of the last that went out, so a new stage shows by the update just before. What is left to know is the percentage that went out
last, and a stretch of a log is a function of it: that decides only which update above it is the first to go out, and all that follows is the same. Stretches are
cut where the rows lie after a sort by range; each finds its function by itself, the functions are folded along a task in order, one short row for
each stretch, and each stretch then marks its rows from the percentage it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.folders import checkpoint_folder

#: Rows of a stretch.
BLOCK = 512


def _at_end(p: float) -> bool:
    return p >= 100 or p <= 0


def _last_at_least(keys: list[float], bound: float) -> int:
    """Keys fall; the last place whose key is `bound` or more, -1 if none is."""
    low, high = 0, len(keys)
    while low < high:
        mid = (low + high) // 2
        if keys[mid] >= bound:
            low = mid + 1
        else:
            high = mid
    return low - 1


def _summary(stages: list, percents: list[float], step: float) -> tuple[list, list, list, int, float]:
    """A stretch as a function: (percentages that fall, updates that go out and the last percentage if the first to go out is there), and both if its first update goes out in any case."""
    n = len(percents)
    counts, exits = [0] * n, [0.0] * n
    ahead, keys = [], []  # places to the right that can be the next to go out: the nearer, the lower
    for i in reversed(range(n)):
        k = _last_at_least(keys, percents[i] + step)
        after = ahead[k] if k >= 0 else None
        counts[i] = 1 if after is None else 1 + counts[after]
        exits[i] = percents[i] if after is None else exits[after]
        if _at_end(percents[i]) or i and stages[i] != stages[i - 1]:
            ahead, keys = [i], [float("inf")]
        else:
            while keys and keys[-1] <= percents[i]:
                ahead.pop()
                keys.pop()
            ahead.append(i)
            keys.append(percents[i])
    return keys, [counts[i] for i in ahead], [exits[i] for i in ahead], counts[0], exits[0]


def _stretches(step: float, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, g in b.groupby("key", sort=False, dropna=False):
                for at in range(0, len(g), block):
                    part = g.iloc[at : at + block]
                    stages, percents = part["stage"].tolist(), part["percent"].tolist()
                    out.append((key, part["at"].iloc[0], part["event_id"].tolist(), stages, percents, stages[0], stages[-1], *_summary(stages, percents, step)))
            yield pd.DataFrame(out, columns=["key", "block", "ids", "stages", "percents", "first", "last", "keys", "counts", "exits", "count", "exit"])

    return run


def _entries(step: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stage, percent, fresh = None, None, 0.0, True
        for b in batches:
            out = []
            for key, block, first, last, keys, counts, exits, exit_ in b[["key", "block", "first", "last", "keys", "counts", "exits", "exit"]].itertuples(index=False):
                if fresh or key != now:
                    now, stage, percent, fresh = key, None, None, False
                out.append((key, block, None if percent is None or stage != first else percent))
                if percent is None or stage != first:
                    percent = exit_
                elif (k := _last_at_least(list(keys), percent + step)) >= 0:
                    percent = exits[k]
                stage = last
            yield pd.DataFrame(out, columns=["key", "block", "since"]).astype({"since": "float64"})

    return run


def _marked(step: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, ids, stages, percents, since in b[["key", "ids", "stages", "percents", "since"]].itertuples(index=False):
                last = None if pd.isna(since) else since
                for i, (event, p) in enumerate(zip(ids, percents, strict=True)):
                    go = last is None or i > 0 and stages[i] != stages[i - 1] or p - last >= step or _at_end(p)
                    last = p if go else last
                    out.append((key, event, go))
            yield pd.DataFrame(out, columns=["key", "event_id", "emitted"])

    return run


def throttled(updates: DataFrame, step: float = 5.0, block: int = BLOCK) -> DataFrame:
    """(key, event_id, emitted) of updates (key string, ts, event_id long, stage string, percent double), of a key in order of ts and event_id. A null percentage counts as 0; null keys and stages are ones of their own."""
    u = updates.select(F.col("key").cast("string").alias("key"), "ts", "event_id", F.col("stage").cast("string").alias("stage"), F.coalesce(F.col("percent").cast("double"), F.lit(0.0)).alias("percent"))
    u = u.withColumn("key", F.coalesce(F.concat(F.lit("="), "key"), F.lit(""))).withColumn("stage", F.coalesce(F.concat(F.lit("="), "stage"), F.lit("")))
    u = u.repartitionByRange("key", "ts", "event_id").sortWithinPartitions("key", "ts", "event_id").withColumn("at", F.monotonically_increasing_id())
    lists = "ids array<long>, stages array<string>, percents array<double>, first string, last string, keys array<double>, counts array<long>, exits array<double>, count long, exit double"
    checkpoint_folder(updates.sparkSession)
    blocks = u.drop("ts").mapInPandas(_stretches(step, block), f"key string, block long, {lists}").checkpoint()
    folded = blocks.select("key", "block", "first", "last", "keys", "counts", "exits", "exit").repartition("key").sortWithinPartitions("key", "block").mapInPandas(_entries(step), "key string, block long, since double")
    done = blocks.select("key", "block", "ids", "stages", "percents").join(folded, ["key", "block"]).mapInPandas(_marked(step), "key string, event_id long, emitted boolean")
    return done.withColumn("key", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)))
