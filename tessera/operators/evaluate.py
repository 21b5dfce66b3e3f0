"""Retrieval evaluation: target matches, hits, reciprocal ranks, recall, verdicts, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_match(code: Column, title: Column, target: Column) -> Column:
    """The target is the code, or its prefix up to a point, or in the title."""
    return F.coalesce((code == target) | F.startswith(code, F.concat(target, F.lit("."))), F.lit(False)) | F.contains(F.lower(title), F.lower(target))


def keyword_recall(text: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))) / F.greatest(F.size(keywords), F.lit(1))


def first_ranks(hits: DataFrame, relevant: Column) -> DataFrame:
    """Rank of each query's first relevant hit; 0 if there is none. Whether a hit is relevant, its own columns say."""
    return hits.groupBy("query_id").agg(F.coalesce(F.min(F.when(relevant, F.col("rank"))), F.lit(0)).alias("rank"))


def case_metrics(rank: Column) -> list[Column]:
    hit = lambda k: ((rank >= 1) & (rank <= k)).cast("int").alias(f"hit{k}")
    return [hit(1), hit(3), hit(5), F.when(rank >= 1, 1.0 / rank).otherwise(0.0).alias("rr")]


def verdict(rank: Column, recall: Column) -> Column:
    return F.when((rank == 1) & (recall >= 0.7), "PASS").when((rank <= 3) & (recall >= 0.5), "ACCEPTABLE").otherwise("FAIL")


def trap_passed(text: Column, entities: Column) -> Column:
    return ~F.exists(entities, lambda e: F.contains(F.lower(text), F.lower(e)))


def scorecard(cases: DataFrame) -> DataFrame:
    """Mean metrics by category, and overall as category null, in one pass."""
    g = cases.rollup("category").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit3", "hit5", "rr", "recall")])
    return g


def upper_rank_percentiles(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """Value at index floor(n * p) of the sorted values, for each p.

    Values are counted by distinct value first; running counts are taken over ranges of values, so no task sorts all rows.
    """
    from pyspark.sql import Window as W

    counts = values.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    ranges = counts.withColumn("r", F.floor(F.log2(F.abs(F.col("x")) + 1) * F.signum("x") * 4).cast("long"))
    before = ranges.groupBy("r").agg(F.sum("c").alias("rc")).withColumn("base", F.coalesce(F.sum("rc").over(W.partitionBy(F.lit(0)).orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("r", "base")
    upto = ranges.join(F.broadcast(before), "r").withColumn("upto", F.col("base") + F.sum("c").over(W.partitionBy("r").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    n = counts.agg(F.sum("c").alias("n"))
    p = values.sparkSession.createDataFrame([(s,) for s in shares], "p double").crossJoin(n).select("p", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1).alias("at"))
    return upto.crossJoin(F.broadcast(p)).where("upto > at").groupBy("p").agg(F.min("x").alias(column))
