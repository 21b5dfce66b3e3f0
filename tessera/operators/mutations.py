"""Changes as tables: a new state from an old one and what is to change. Nothing is updated in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(base: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of keys that `new` has go, `new` comes."""
    return base.join(new.select(*key).distinct(), list(key), "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def delete(base: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    return base.join(gone.select(*key).distinct(), list(key), "left_anti").select(*base.columns)


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns that `changes` (one row a key) supplies, where not null, over those of `base`."""
    names = [c for c in changes.columns if c != key]
    p = changes.select(key, *[F.col(n).alias(f"new_{n}") for n in names])
    j = base.join(p, key, "left")
    return j.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in base.columns])


def upsert_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def insert_missing(base: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    return base.unionByName(seeds.join(base.select(key), key, "left_anti").select(*base.columns))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def transition(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Status changes (id, status, progress, message) of documents that aren't deleted; progress 0..100, messages cut to 500."""
    c = changes.select("id", F.col("status").alias("to"), clamp(F.col("progress"), 0, 100).alias("progress"), F.substring("message", 1, 500).alias("message"))
    j = docs.join(c, "id", "left")
    live = F.col("deleted_at").isNull() & F.col("to").isNotNull()
    return j.select("id", F.when(live, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(live, F.col("progress")).alias("progress"), F.when(live, F.col("message")).alias("message"))


def activate(providers: DataFrame, key: str, chosen: Column, group: str) -> DataFrame:
    """One active row in each group that has a chosen one; other groups stay."""
    has = providers.groupBy(group).agg(F.max(chosen).alias("has"))
    return providers.join(has, group).withColumn("is_active", F.when(F.col("has"), chosen).otherwise(F.col("is_active"))).drop("has")


def consistency(sections: DataFrame, vectors: DataFrame, *key: str) -> DataFrame:
    """Totals, vectors without a section, sections without a vector."""
    s, v = sections.select(*key).distinct(), vectors.select(*key)
    total = sections.agg(F.count("*").alias("sections")).crossJoin(vectors.agg(F.count("*").alias("vectors")))
    lost = v.join(s, list(key), "left_anti").agg(F.count("*").alias("orphan_vectors"))
    bare = s.join(v.distinct(), list(key), "left_anti").agg(F.count("*").alias("bare_sections"))
    return total.crossJoin(lost).crossJoin(bare)


def left_over(gone: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """For each deleted key the rows that each table still has of it, and whether that is none (`clean`)."""
    out = gone.select(key).distinct()
    for name, table in tables.items():
        n = table.join(gone.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias(name))
        out = out.join(n, key, "left")
    return out.na.fill(0, list(tables)).withColumn("clean", reduce(lambda a, b: a & b, [F.col(n) == 0 for n in tables], F.lit(True)))
