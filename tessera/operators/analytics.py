"""Usage, cost and feedback analytics: group-bys, zero-filled joins, pivots with fixed keys, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.sources.folders import checkpoint_folder

MODEL_TYPES = ("llm", "embedding", "reranker")


def whole_mean(column: str) -> Column:
    """The mean of doubles, cut to a whole number.

    Doubles are summed as the decimals that they are written as, so that a mean that is whole isn't cut to the number below by the order of the sum. Values that aren't
    finite or don't fit (20 digits before the point, 18 after it) take the mean of doubles.
    """
    decimal = f"try_cast({column} AS decimal(38, 18))"
    exact = F.expr(f"try_sum({decimal}) div nullif(count({column}), 0)")
    return F.coalesce(F.when(F.expr(f"count({decimal}) = count({column})"), exact), F.avg(column).cast("long"))


def measures() -> list[Column]:
    """Requests, tokens, cost and mean latency (cut to a whole number), zero where there is nothing."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("requests"),
        whole("prompt_tokens").alias("prompt_tokens"),
        whole("completion_tokens").alias("completion_tokens"),
        whole("total_tokens").alias("total_tokens"),
        whole("cost_micros_vnd").alias("cost_micros"),
        F.coalesce(whole_mean("latency_ms"), F.lit(0)).cast("long").alias("avg_latency_ms"),
    ]


def totals(usage: DataFrame) -> DataFrame:
    return usage.agg(*measures())


def by_model_type(usage: DataFrame, types: tuple[str, ...] = MODEL_TYPES) -> DataFrame:
    """One row for each of the fixed types, zero-filled; other types are left out."""
    dim = usage.sparkSession.createDataFrame([(t,) for t in types], "model_type string")
    got = usage.where(F.col("model_type").isin(*types)).groupBy("model_type").agg(*measures())
    return dim.join(got, "model_type", "left").na.fill(0)


def daily(usage: DataFrame) -> DataFrame:
    """By local day; days without usage are not generated."""
    return usage.groupBy(times.local_day(F.col("created_at")).alias("day")).agg(*measures())


def daily_by_model_type(usage: DataFrame, types: tuple[str, ...] = MODEL_TYPES) -> DataFrame:
    """A row for each day that has usage, with tokens and cost of each fixed type."""
    day = times.local_day(F.col("created_at"))
    g = usage.groupBy(day.alias("day")).pivot("model_type", list(types)).agg(F.sum("total_tokens").cast("long").alias("tokens"), F.sum("cost_micros_vnd").cast("long").alias("cost_micros"), F.count(F.lit(1)).alias("requests"))
    return g.na.fill(0)


def summary_for(dim: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Every row of `dim`, with its usage: aggregated first, joined after, zero-filled."""
    got = usage.where(F.col(key).isNotNull()).groupBy(key).agg(*measures(), F.count_if(F.col("model_type") == "llm").alias("questions"))
    names = [c for c in got.columns if c != key]
    return dim.join(got, key, "left").select(*dim.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def feedback_by_tenant(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("tenant_id").pivot("feedback_type", ["like", "dislike"]).count().na.fill(0, ["like", "dislike"])


def dislike_rate(likes: Column, dislikes: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(dislikes, likes + dislikes), 4), F.lit(0.0))


def top_disliked(citations: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Keys most cited by dislikes, with likes, dislikes, rate, and the newest title (or one made from the key)."""
    g = citations.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col("feedback_type") == "dislike").alias("dislikes"),
        F.count_if(F.col("feedback_type") == "like").alias("likes"),
        F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("created_at", "id", "pos"))).alias("title"),
    )
    named = F.coalesce("title", F.concat(F.lit("Document "), F.col(key).cast("string")))
    return g.where("dislikes > 0").select(key, named.alias("title"), "likes", "dislikes", dislike_rate(F.col("likes"), F.col("dislikes")).alias("rate")).orderBy(F.desc("dislikes"), key).limit(k)


def windows(usage: DataFrame, now: Column, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Usage of several windows that end now, in one pass over the widest."""
    u = usage.where(times.since(F.col("created_at"), now, max(days)))
    size = F.explode(F.array(*[F.when(times.since(F.col("created_at"), now, d), F.lit(d)) for d in days]))
    return u.withColumn("days", size).where("days IS NOT NULL").groupBy("days").agg(*measures())


def recent(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def merged_citations(citations: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, title, pages of citations (by, order, title, page_range): the first title, and the union of page ranges as `3-5, 7`; empty where there are none.

    A range is its first and its last part between hyphens; what isn't two whole numbers is left out, and one that ends before it begins has no
    page. Ranges are joined by the furthest end so far, so no page becomes a row.
    """
    part = lambda k: F.expr("try_cast(trim(%s) AS int)" % f"element_at(split(page_range, '-', -1), {k})")
    spans = citations.select(*by, part(1).alias("a"), part(-1).alias("b")).where("a <= b")
    before = W.partitionBy(*by).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("a") > F.max("b").over(before) + 1, F.lit(True))
    runs = spans.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(W.partitionBy(*by).orderBy("a", "b").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy(*by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    pages = runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"]), ", ").alias("pages"))
    # Fixed value: the title of what has none.
    titles = citations.groupBy(*by).agg(F.min_by(F.coalesce("title", F.lit("Tài liệu")), F.struct(*order)).alias("title"))
    other = pages.withColumnsRenamed({c: f"{c}_2" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in by]
    return titles.join(other, same, "left").select(*by, "title", F.coalesce("pages", F.lit("")).alias("pages"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their number in a total order, from 1. Rows are sorted in ranges; the numbers before a range come from counts, one for each range, so no task sorts all."""
    checkpoint_folder(rows.sparkSession)
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).withColumn("range", F.shiftright("at", 33)).checkpoint()
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "range").withColumn(name, F.col("before") + local + 1).drop("at", "range", "before")
