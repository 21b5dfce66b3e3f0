"""A store of blobs with a manifest: puts and prefix deletes that readers see whole or not at all.

Bodies are written once, in a batch of their own; a version of the manifest lists the live keys, each with its batch. A change writes its bodies, then the next version in full, and a version
counts from when Spark marks it as complete. So a reader that began with a version keeps it, one that begins later sees the next, and a change that was
broken off leaves only files that nobody lists; they go with `vacuum`, as do batches without a live key. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTING = "key string, length long, batch string"


class BlobStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def version(self) -> int:
        """The last complete version; 0 if there is none."""
        done = [int(n[2:]) for n in self._names("listing") if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/listing/{n}/_SUCCESS"))]
        return max(done, default=0)

    def listing(self, version: int | None = None) -> DataFrame:
        """key, length and batch of the live blobs of a version."""
        v = self.version() if version is None else version
        return self.spark.read.schema(_LISTING).parquet(f"{self.root}/listing/v={v}") if v else self.spark.createDataFrame([], _LISTING)

    def read(self, version: int | None = None) -> DataFrame:
        """key and body of the live blobs of a version."""
        live = self.listing(version).select("key", "batch")
        batches = [r[0] for r in live.select("batch").distinct().collect()]
        if not batches:
            return self.spark.createDataFrame([], "key string, body string")
        bodies = self.spark.read.schema("key string, body string, batch string").option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/batch={b}" for b in batches])
        return bodies.join(live, ["key", "batch"], "left_semi").select("key", "body")

    def _commit(self, listing: DataFrame, after: int) -> int:
        # a version that was broken off has its number and no mark; it is written anew
        listing.write.mode("overwrite").parquet(f"{self.root}/listing/v={after + 1}")
        return after + 1

    def put(self, blobs: DataFrame) -> int:
        """Adds blobs (key, body; keys once), which replace those of their keys; the new version."""
        now, batch = self.version(), uuid.uuid4().hex
        blobs.select("key", "body").write.parquet(f"{self.root}/data/batch={batch}")
        new = self.spark.read.schema("key string, body string").parquet(f"{self.root}/data/batch={batch}")
        new = new.select("key", F.octet_length("body").cast("long").alias("length"), F.lit(batch).alias("batch"))
        return self._commit(self.listing(now).join(new.select("key"), "key", "left_anti").select("key", "length", "batch").unionByName(new), now)

    def delete(self, gone: Column) -> int:
        """A version without the keys for which a condition on `key` holds."""
        now = self.version()
        return self._commit(self.listing(now).where(~F.coalesce(gone, F.lit(False))), now)

    def delete_prefix(self, prefix: str) -> int:
        """A version without the keys that begin so. An empty prefix is refused."""
        if not prefix:
            raise ValueError("a prefix is needed")
        return self.delete(F.startswith("key", F.lit(prefix)))

    def vacuum(self) -> list[str]:
        """Removes earlier versions and what no live key needs; readers of earlier versions have to be done. The batches that went."""
        now = self.version()
        live = {f"batch={r[0]}" for r in self.listing(now).select("batch").distinct().collect()}
        gone = [n for n in self._names("data") if n.startswith("batch=") and n not in live]
        old = [f"listing/{n}" for n in self._names("listing") if n != f"v={now}"]
        for name in [*[f"data/{n}" for n in gone], *old]:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return gone
