"""Sources and sinks: tables, blobs, text files, vectors, reports. Paths go to Spark's readers and writers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import uuid_or_null


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("uri"))


def existing(keys: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Keys with whether the listing has them."""
    found = listing.select(key).distinct().withColumn("found", F.lit(True))
    return keys.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def write_blobs(df: DataFrame, path: str, key: str, body: str) -> None:
    """Bodies as rows of Parquet, in files of a size that Spark chooses; rows are balanced, whatever their keys."""
    df.select(key, body).hint("rebalance").write.mode("overwrite").parquet(path)


def usage_rows(requests: DataFrame) -> DataFrame:
    """Usage log rows: the total is the sum, ids that are no UUID become null."""
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return requests.withColumn("total_tokens", total).withColumn("request_uuid", uuid_or_null(F.col("request_uuid")))


def upsert_vectors(store: DataFrame, new: DataFrame, key: str = "node_id") -> DataFrame:
    """Vectors by key: new ones replace old ones."""
    return store.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def attach_sparse(store: DataFrame, sparse: DataFrame, key: str = "node_id") -> DataFrame:
    return store.join(sparse, key, "left")


def report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A JSON report in one file; a table of more than `most` rows is refused, since one task writes it."""
    few = df.limit(most + 1)
    if few.count() > most:
        raise ValueError(f"a report has {most} rows at most")
    few.coalesce(1).write.mode("overwrite").json(path)
