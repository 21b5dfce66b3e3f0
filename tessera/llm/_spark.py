"""Small Spark helpers of the operators: cutting lineage and connected components."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import checkpoint_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame, hubs: bool = False) -> DataFrame:
    """(id, component): for each id in `links` (a, b; of any type that has an order), the smallest id that it reaches.

    Alternates the large-star and small-star steps over min-labels: both aggregate first (map-side) and join back,
    so a centre with many links is only a skewed join, which Spark splits. Lineage is cut in each round; the driver
    sees two numbers a round. hubs: ids with very many links are to be expected, so the aggregate that they join is written first;
    Spark splits only joins of plain exchanges.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if hubs:
            least = checkpointed(least)
        # large star: every larger neighbour of a goes to the least around a
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("a").alias("x"), "m").where("a <> m"))
        edges = checkpointed(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(roots)



def saved(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet files in the shared checkpoint folder; for what is too large to keep row by row. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark.sparkContext, path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished queries once the driver has collected its garbage, which may be after all is done. After a `saved` that ends a
    large shuffle, this has it do so now, so that what follows doesn't need disk on top. Twice, and half a second apart, as a single pass was seen to leave the files of the latest query."""
    for wait in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def _remove(context, path: str) -> None:
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended, and its folder with it
        return
